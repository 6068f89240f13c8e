"""The queries of this subpackage: each applies its operator to a whole table and derives the columns that are compared."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.chat_format import chat_windows, window_digests
from tidegauge.llm.conversation_repair import damaged, repair_edits, repair_report
from tidegauge.llm.embedding_dedup import near_vectors
from tidegauge.llm.exact_dedup import exact_duplicates
from tidegauge.llm.html_extract import extract_main_text, fit_labeller
from tidegauge.llm.length_buckets import decompose_documents
from tidegauge.llm.line_dedup import drop_repeated_lines
from tidegauge.llm.lm_score import fit_ngram_model, lm_scores
from tidegauge.llm.minhash_dedup import near_duplicates
from tidegauge.llm.packing import pack_documents
from tidegauge.llm.sentencepiece import decode_ids, encode_texts
from tidegauge.llm.toxicity import fit_toxicity, with_toxicity
from tidegauge.llm.vector_codes import compress_vectors, with_label_error


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents")).drop("text_print")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85).drop("class_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return window_digests(chat_windows(turns.unionByName(own), public_tokenizers.path("byte_bpe_50k.json")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings")).drop("class_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, path).withColumn("n_ids", F.size("ids").cast("long")).withColumn("ids_xxhash64", F.xxhash64("ids"))
    decoded = decode_ids(encoded, path, keep=("n_ids", "ids_xxhash64"))
    return decoded.select("doc_id", "n_ids", "ids_xxhash64", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return extract_main_text(pages, fit_labeller(pages)).select("page_id", "url", "text", "n_chars")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = lm_scores(docs, fit_ngram_model(docs.where(~held_out), 3))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit_toxicity(docs, labels.where(~held_out))
    return with_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = compress_vectors(_table(spark, sf_dir, "embeddings"), keep=("label",))
    return with_label_error(codes.rows).select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    report = repair_report(repair_edits(damaged(conversations))).withColumnRenamed("conv_id", "own")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(report, F.col("conv_id").eqNullSafe(F.col("own")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = decompose_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_embedding_dedup, op3_sentencepiece, op4_html_extract, op5_lm_score, op6_toxicity, op7_minhash_dedup, op8_best_fit_packing, op9_line_dedup, op10_chat_format, op11_vector_codes, op12_conversation_repair, op13_packing)}


def _repair_sql() -> str:
    """The dynamic program as a recursion over turns, its candidates as nine digits of cost and the letters of the edits."""
    more = lambda at, cost, letter: f"lpad(CAST(CAST(left({at}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({at}, 10) || '{letter}'"

    def candidates(own: str, sources: tuple[str, ...], initial: str) -> str:
        found = [more(own, 2, "D")]
        for source in sources:
            found.append(f"CASE WHEN live AND ini = '{initial}' THEN {more(source, 'extra', 'K')} END")
            if initial in "ua":
                found.append(f"CASE WHEN live AND ini <> '{initial}' THEN {more(source, 'extra + 1', 'R')} END")
        return f"least({', '.join(found)})"

    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    return f"""
        WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
        d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
              FROM src CROSS JOIN (VALUES (1), (2)) c(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, trim(text, {white}) AS bare FROM d),
        f AS (SELECT *, left(role, 1) AS ini, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
        t AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS live, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra FROM f),
        r AS (SELECT conv_id, 0 AS i, repeat('0', 9) AS q0, CAST(NULL AS VARCHAR) AS qs, '000000005I' AS qu, '000000010II' AS qa FROM (SELECT DISTINCT conv_id FROM t)
              UNION ALL
              SELECT conv_id, i, q0, qs, u, least(qa, {more("u", 5, "I")})
              FROM (SELECT *, least(qu, {more("q0", 5, "I")}, {more("qs", 5, "I")}, {more("qa", 5, "I")}) AS u
                    FROM (SELECT t.conv_id, t.i, {more("q0", 2, "D")} AS q0, {candidates("qs", ("q0",), "s")} AS qs, {candidates("qu", ("q0", "qs", "qa"), "u")} AS qu, {candidates("qa", ("qu",), "a")} AS qa
                          FROM r JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.i = r.i + 1))),
        n AS (SELECT conv_id, max(i) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                     count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE was || ini NOT IN ('su', 'ua', 'au')) AS illegal
              FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM f) GROUP BY conv_id),
        b AS (SELECT n.*, least(q0, qa) AS best FROM n JOIN r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = n.last),
        p AS (SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS edit, unnest(range(1, length(best) - 8)) AS pos FROM b),
        g AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS i, count(*) FILTER (WHERE edit <> 'D') OVER w AS place FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
        e AS (SELECT g.conv_id, g.pos, g.edit, g.place, t.role, t.text, coalesce(max(CASE WHEN g.place = 1 AND g.edit = 'K' AND t.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g.conv_id), 0) AS shift
              FROM g LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM g.conv_id AND t.i = g.i AND g.edit <> 'I'),
        x AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos) FILTER (WHERE edit <> 'D') AS repaired FROM e GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM c.conv_id"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Each round as a pair of tables: the parts with their nearest entry, and the next codebooks."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        a{k} AS MATERIALIZED (SELECT id, label, p, x, arg_min(entry, (square, entry)) AS entry, min(square) AS square
              FROM (SELECT x.*, b.entry, list_sum(list_transform(list_zip(x.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS square FROM x JOIN b{k} b USING (p)) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""
        m{k} AS (SELECT p, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT p, entry, i, sum(c)::BIGINT AS s, count(*) AS n FROM (SELECT p, entry, unnest(x) AS c, unnest(range(len(x))) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL),
        b{k + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (p, entry))""")
    return f"""
        WITH v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(4096 * x)::BIGINT) AS e, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id FROM embeddings
              WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        x AS MATERIALIZED (SELECT id, label, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS x FROM v CROSS JOIN range({parts}) r(p)),
        b0 AS MATERIALIZED (SELECT p, id - 1 AS entry, x FROM x WHERE id <= {entries}), {",".join(steps)},
        c AS (SELECT id, label, string_agg(lpad(printf('%x', entry), 2, '0'), '' ORDER BY p) AS code, sum(square)::BIGINT AS error FROM a{rounds} GROUP BY id, label)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY c.label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, entry)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN v USING (id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_vector_codes": _codes_sql(),
        "op12_conversation_repair": _repair_sql(),
        "op2_embedding_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
            n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
            p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.len > 0 AND b.len > 0 AND list_inner_product(a.e, b.e) / (a.len * b.len) >= 0.93),
            r AS (SELECT vec_id AS node, vec_id AS reached FROM v UNION SELECT p.b, r.reached FROM r JOIN p ON p.a = r.node),
            c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node),
            k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
            SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept
            FROM v JOIN c ON c.node = v.vec_id LEFT JOIN k ON k.a = v.vec_id""",
        "op1_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY t)""",
        "op7_minhash_dedup": r"""
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
            u AS (SELECT doc_id, unnest(sh) AS g FROM s), z AS (SELECT doc_id, len(sh) AS n FROM s),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
            l AS (SELECT p.a, p.b FROM p JOIN z x ON x.doc_id = p.a JOIN z y ON y.doc_id = p.b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
            r AS (SELECT doc_id AS node, doc_id AS reached FROM z UNION SELECT l.b, r.reached FROM r JOIN l ON l.a = r.node),
            c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
            SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM z JOIN c ON c.node = z.doc_id""",
        "op9_line_dedup": r"""
            WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
            l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
            k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
            r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
            f AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r USING (key))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
            FROM f GROUP BY doc_id""",
    }
