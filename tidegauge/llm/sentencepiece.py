"""SentencePiece encoding and decoding by a single-pass Viterbi search over an Aho-Corasick automaton.

The automaton of all pieces reads a text once. Wherever pieces end, its output links list them, longest first, and each
relaxes the best score of its end. Characters that no piece has become their UTF-8 bytes.

A unigram model's ids are those of the segmentation with the highest sum of scores; of equal sums the one whose last piece
is longer. In a byte-pair model scores are merge ranks, and a segmentation comes from the merges just when each two
neighbours in it do: there a piece may relax its end only from a piece that it is stable beside, and the search finds the
one segmentation that the merges give.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import LONGEST

SPACE = "▁"
#: Words whose ids a worker remembers.
CACHE = 1_000_000
TEXTS = 128
#: An unknown character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0


class PieceModel:
    """Pieces, scores and types of a SentencePiece model file, whose own encoder isn't used.

    A space is written as U+2581, and a text begins with one more of it. U+2581 in a text itself becomes bytes, so that
    decoding gives every text back as it was.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        size = own.get_piece_size()
        self.byte_id = {int(own.id_to_piece(i)[3:5], 16): i for i in range(size) if own.is_byte(i)}
        normal = [i for i in range(size) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
        self.pieces = {own.id_to_piece(i): (i, len(own.id_to_piece(i)), own.get_score(i)) for i in normal}
        self.characters = {p for p in self.pieces if len(p) == 1}
        self.unknown_score = min(s for _, _, s in self.pieces.values() if s > -1e8) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, value in self.pieces.items():
            self.automaton.add_word(piece, value)
        self.automaton.make_automaton()
        self.as_bytes = [b""] * size
        for piece, (i, _, _) in self.pieces.items():
            self.as_bytes[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.byte_id.items():
            self.as_bytes[i] = bytes([byte])
        self.words: dict[str, bytes] = {}
        ranks = [s for _, _, s in self.pieces.values() if s > -1e8]
        self.by_merges = len(ranks) > 1 and all(s == int(s) for s in ranks) and len(set(ranks)) == len(ranks)
        self.beside: dict[int, bool] = {}  # by the pair of ids

    def _merged(self, parts: list[str]) -> list[str]:
        """Characters after all merges: the pair of the best score first, of equal scores the left one."""
        while len(parts) > 1:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                if (found := self.pieces.get(parts[k] + parts[k + 1])) and found[2] > best:
                    best, at = found[2], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, left: str, right: str) -> bool:
        """Whether merges leave these two pieces (or the right one alone) apart and whole."""
        return self._merged([*left, *right]) == [p for p in (left, right) if p]

    def best(self, text: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation of a text that is written with U+2581 for spaces."""
        n, many = len(text), len(self.as_bytes)
        score, back, sizes = [0.0] + [-np.inf] * n, [-1] * (n + 1), [0] * (n + 1)
        known, at, free, beside = self.characters, 0, not self.by_merges, self.beside
        if len(beside) > CACHE:
            beside.clear()
        for end, (i, size, own) in self.automaton.iter(text):
            while at <= end:  # characters that no piece covers, up to here
                if text[at] not in known:
                    score[at + 1], back[at + 1], sizes[at + 1] = score[at] + self.unknown_score, -1, 1
                at += 1
            end += 1
            start = end - size
            if (s := score[start] + own) > score[end]:
                if not free:
                    # the piece before, -1 at the start and after an unknown character, and this one
                    pair = back[start] * many + i
                    fits = beside.get(pair)
                    if fits is None:
                        fits = beside[pair] = self.stable(text[start - sizes[start] : start] if back[start] >= 0 else "", text[start:end])
                    if not fits:
                        continue
                score[end], back[end], sizes[end] = s, i, size
        for at in range(at, n):
            if text[at] not in known:
                score[at + 1], back[at + 1], sizes[at + 1] = score[at] + self.unknown_score, -1, 1
        ids: list[int] = []
        at = n
        while at:
            ids += [back[at]] if back[at] >= 0 else [self.byte_id[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
            at -= sizes[at]
        return ids[::-1], score[n]

    def chunk(self, text: str) -> bytes:
        """Ids of a part of a text that begins with a space; U+2581 in it stays itself, as bytes."""
        if SPACE not in text:
            return np.array(self.best(text.replace(" ", SPACE))[0], dtype="<i4").tobytes()
        out: list[int] = []
        for k, part in enumerate(text.split(SPACE)):
            out += [self.byte_id[b] for b in SPACE.encode()] * bool(k) + (self.best(part.replace(" ", SPACE))[0] if part else [])
        return np.array(out, dtype="<i4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers.

        No piece has a space after another character, so texts may be cut before each run of spaces, and a chunk's ids don't
        depend on the text around it.
        """
        if len(self.words) > CACHE:
            self.words.clear()
        known, out, long_ = self.words, [], []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            words = text.split(" ")
            if "" in words:  # runs of spaces: a chunk is a run and the word after it
                words, run = [], " "
                for w in text.split(" "):
                    if w:
                        words.append(run[1:] + w)
                        run = " "
                    else:
                        run += " "
                if len(run) > 1:
                    words.append(run[2:])
            for w in words:
                if w not in known:
                    known[w] = self.chunk(" " + w)
                    if len(w) > LONGEST:  # isn't remembered beyond its text
                        long_.append(w)
            out.append(b"".join(map(known.__getitem__, words)))
            for w in long_:
                del known[w]
            long_.clear()
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control pieces are empty."""
        text = b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.cache
def piece_model(path: str) -> PieceModel:
    """One model for each Python worker."""
    return PieceModel(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids = model.encode_all([t or "" for t in part.column(1).to_pylist()])
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))], names=["id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = [model.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *part.columns[2:]], names=["id", "text", *part.schema.names[2:]])

    return run


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, ids (array of int).

    Null and empty texts have no ids. Repeated rows get a row each, null ids stay null. Other columns aren't read. An empty
    table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_encode(model_path), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of encoded: id_col, text, and the columns named in keep. Null or empty ids give the empty text."""
    source = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"), *(F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)))
    kinds = dict(encoded.dtypes)
    schema = ", ".join(["id long", "text string", *(f"kept_{k} {kinds[c]}" for k, c in enumerate(keep))])
    decoded = source.mapInArrow(_decode(model_path), schema)
    return decoded.select(F.col("id").alias(id_col), "text", *(F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)))
