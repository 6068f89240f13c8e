"""Toxicity as a linear classifier of character n-grams, scaled by their naive Bayes log-count ratios.

A text is the set of its words; a feature is a hashed n-gram of characters of `<word>`, and its value the number of times it
stands in the text's distinct words. Each value is multiplied by the log ratio of the n-gram's document frequencies in the
two classes, and logistic regression learns the weights. Fitting reads a bounded sample of the labelled rows; scoring
reads every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import LONGEST, U64, batched, few_by_hash, mix, rows_of, saved

BUCKETS = 1 << 18
SIZES = (3, 4, 5, 6)
#: Labelled rows that a model is fitted on, at most: those of the smallest hashes of their ids.
FIT_ROWS = 20_000
#: Values of weighted n-grams that the weights are learned from, at most: 8 bytes each on their way to the driver, so that long
#: texts don't fill it. Rows beyond, in the order of their ids' hashes, count for the ratios only.
FIT_VALUES = 1 << 25
#: Added to the counts of both classes together; keeps n-grams of a few documents from having large ratios by chance.
SMOOTHING = 20.0
#: N-grams whose log ratio is closer to 0 have no weight.
LEAST_RATIO = 1.0
STEPS, STEP, RIDGE = 200, 0.05, 1e-4
#: Words whose score a worker remembers.
CACHE = 250_000
#: Texts that are scored together.
TEXTS = 128
#: Characters whose n-grams are computed together.
CHUNK = 1 << 16

_APART = bytes.maketrans(bytes(i for i in range(128) if not chr(i).isalnum()), b" " * sum(not chr(i).isalnum() for i in range(128)))


def distinct_words(text: str | None) -> set[bytes]:
    """Runs of letters and digits, A-Z in lower case; all characters beyond ASCII count as letters."""
    return set(text.encode("utf-8", "surrogatepass").lower().translate(_APART).split()) if text else set()


def ngrams(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owner (index of the word) and bucket of each n-gram of `<word>`, in chunks of whole words."""
    held: list[str] = []
    first = size = 0
    for i, w in enumerate(words):
        s = f"<{w.decode('utf-8', 'surrogatepass').lower()}>"
        held.append(s)
        size += len(s)
        if size >= CHUNK:
            yield _hashed(held, first)
            held, first, size = [], i + 1, 0
    if held:
        yield _hashed(held, first)


def _hashed(words: list[str], first: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(first, first + len(words)), lengths)
    owners, buckets = [], []
    rolled = np.zeros(len(codes), U64)
    for n in range(1, max(SIZES) + 1):
        rolled = rolled[: len(codes) - n + 1] * U64(0x100000001B3) + codes[n - 1 :]
        if n in SIZES:
            inside = np.flatnonzero(np.arange(len(rolled)) + n <= ends[: len(rolled)])
            owners.append(owner[inside])
            buckets.append((mix(rolled[inside] + U64(n)) >> U64(64 - 18)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the buckets (the ratio times the learned weight) and the bias."""

    weights: np.ndarray
    bias: float

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for owner, bucket in ngrams(words):
            out += np.bincount(owner, weights=self.weights[bucket], minlength=len(words))
        return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a bucket, summed over the task."""
    seen = np.zeros((2, BUCKETS), dtype=np.int64)
    for label, text in rows_of(batches, "label", "text"):
        for _, bucket in ngrams(sorted(distinct_words(text))):
            seen[label][np.unique(bucket)] += 1
    at = np.flatnonzero(seen.any(axis=0))
    if len(at):
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n0": pa.array(seen[0][at]), "n1": pa.array(seen[1][at])})


def _values(ratios):
    """Kept buckets of each document and their values."""
    schema = pa.schema([("hash", pa.int64()), ("label", pa.int32()), ("held", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ratios.value != 0

        def rows() -> Iterator[tuple]:
            for key, label, text in rows_of(batches, "hash", "label", "text"):
                found = [b[kept[b]] for _, b in ngrams(sorted(distinct_words(text)))]
                at, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
                yield key, label, len(at), at.astype("<i4").tobytes(), n.astype("<i4").tobytes()

        yield from batched(rows(), schema, 64)

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_values: int = FIT_VALUES) -> ToxicityModel:
    """Fit on at most fit_rows of the labelled documents, and on at most fit_values values of theirs.

    Labels other than 0 and 1 (null too) are ignored; an id with both counts as toxic. Without labelled rows of both classes
    no n-gram has a weight, and every text gets the smoothed share of toxic rows, 0.5 where there are none.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = few_by_hash(known, F.xxhash64("label_id"), fit_rows)  # bounds what is broadcast and collected
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fit = saved(texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("hash", "label", "text"), "labelled")
    sizes = {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not (n0 and n1):
        return ToxicityModel(np.zeros(BUCKETS), math.log((n1 + 0.5) / (n0 + 0.5)))
    counts = fit.mapInArrow(_frequencies, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    share, ratios = n1 / (n0 + n1), np.zeros(BUCKETS)
    p, q = (counts["n1"] + SMOOTHING * share) / n1, (counts["n0"] + SMOOTHING * (1 - share)) / n0
    ratios[counts["bucket"]] = np.log(p / q)
    ratios[np.abs(ratios) < LEAST_RATIO] = 0
    held = saved(fit.mapInArrow(_values(spark.sparkContext.broadcast(ratios)), "hash long, label int, held long, buckets binary, counts binary"), "values")
    rows = _within(held, fit_values).select("label", "buckets", "counts").toPandas()
    if rows.empty:
        return ToxicityModel(np.zeros(BUCKETS), math.log((n1 + 0.5) / (n0 + 0.5)))
    rows = rows.sort_values(["label", "buckets", "counts"], ignore_index=True)
    at = [np.frombuffer(b, "<i4") for b in rows["buckets"]]
    bucket, row = np.concatenate(at), np.repeat(np.arange(len(at)), [len(x) for x in at])
    value = np.concatenate([np.frombuffer(b, "<i4") for b in rows["counts"]]) * ratios[bucket]
    weights, bias = _logistic(row, bucket, value, rows["label"].to_numpy(float))
    return ToxicityModel(weights * ratios, bias)


def _within(held: DataFrame, most: int) -> DataFrame:
    """Rows of the smallest hashes whose column `held` sums up to no more than `most`; rows of one hash stay or go together."""
    total = held.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    if total <= most:
        return held
    by_hash = held.groupBy("hash").agg(F.sum("held").alias("own"))  # a row for each of at most fit_rows ids
    last = by_hash.withColumn("so_far", F.sum("own").over(Window.orderBy("hash"))).where(F.col("so_far") <= most).agg(F.max("hash")).first()[0]
    return held.where(F.lit(False) if last is None else F.col("hash") <= last)


def _logistic(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by full-batch Adagrad."""
    n, w, b = len(label), np.zeros(BUCKETS), 0.0
    gw2, gb2 = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.bincount(row, weights=value * w[bucket], minlength=n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / n
        gw, gb = np.bincount(bucket, weights=value * g[row], minlength=BUCKETS) + RIDGE * w, g.sum()
        gw2 += gw * gw
        gb2 += gb * gb
        w -= STEP * gw / np.sqrt(gw2)
        b -= STEP * gb / np.sqrt(gb2) * 4
    return w, float(b)


def _scorer(shared):
    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, known = shared.value, {}
        for part in parts:
            out = []
            for at in range(0, len(part), TEXTS):
                words = [distinct_words(t) for t in part.slice(at, TEXTS).to_pylist()]
                if len(known) > CACHE:
                    known.clear()
                new = list({w for ws in words for w in ws if w not in known})
                known.update(zip(new, model.word_scores(new).tolist()))
                out += [math.fsum(map(known.__getitem__, ws)) + model.bias for ws in words]
                for w in new:
                    if len(w) > LONGEST:
                        del known[w]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -700, 700))))

    return score


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column score_col (0 to 1, higher: more likely toxic) in place of any of that name.

    Null and empty texts get the score of a text without words. Repeated rows get a score each. Only the text is read. An
    empty table gives an empty result.
    """
    return docs.withColumn(score_col, _scorer(docs.sparkSession.sparkContext.broadcast(model))(F.col(text_col)))
