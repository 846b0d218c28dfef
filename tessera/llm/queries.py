"""The queries ``opN_<name>`` with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest text that a model of 2,048 tokens reads whole.
TOKEN_LIMIT = 2048
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quotes import link_quotations

    return link_quotations(table(spark, sf_dir, "conversations"))


def quotation_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op1 on all conversations as mail would have them, each message under two levels of quotations."""
    from tessera.llm.quotes import link_quotations, with_replies_quoted

    out = link_quotations(with_replies_quoted(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "role", F.md5("text").alias("text"), "max_level", "n_quotes", "n_linked", "parent_turn", "thread_turn", "reply_depth")


def op2_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import archive_and_read

    return archive_and_read(table(spark, sf_dir, "pages"), with_payload=False).drop("url")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), TOKEN_LIMIT)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the labels of two thirds of the ids, held out on the last third; a null id teaches nothing."""
    from tessera.llm.language_id import fit, identify

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    model = fit(docs.where("not held_out"))
    return identify(docs, model, keep=("doc_id", "held_out"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.permutation_index import search

    return search(table(spark, sf_dir, "embeddings"), 10, lambda i: i % 100 == 0)


def op7_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pigeonhole import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_index import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, with_ids=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)} | {"quotation_replies": quotation_replies, "pipeline": pipeline}


#: SQL for the operators it can express. The others hash with XXH64, run a tokenizer or a model, or scan bytes; tests hold
#: them against brute force, exact round trips or held-out labels.
ORACLE_SQL = {
    "quotation_replies": r"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS n FROM conversations),
q AS (SELECT m.*, coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2 FROM m LEFT JOIN m a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1 LEFT JOIN m b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2)
SELECT conv_id, turn, role, md5(trim(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS text, CAST(CASE WHEN n2 > 0 THEN 2 WHEN n1 > 0 THEN 1 ELSE 0 END AS INT) AS max_level, CAST(n1 + n2 AS INT) AS n_quotes, CAST(n1 + n2 AS INT) AS n_linked,
 CASE WHEN n1 > 0 THEN turn - 1 WHEN n2 > 0 THEN turn - 2 END AS parent_turn, min(turn) OVER (PARTITION BY conv_id) AS thread_turn, CAST(rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS reply_depth FROM q""",
    "op2_capture_index": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM p),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(i * 5 + j + 1 AS BIGINT), 1) AS INT) * CAST(2 ** (4 - j) AS INT))) AS BIGINT), 1)), '') AS payload_digest, max(page_id) OVER (PARTITION BY h) AS largest FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to FROM d""",
    "op7_pigeonhole": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, least.y), vec_id) AS component_id, vec_id = coalesce(least(vec_id, least.y), vec_id) AS kept FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN least ON least.x = vec_id""",
    "op9_suffix_index": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, CAST(i AS BIGINT) AS i, md5(b[i:i + 99]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d WHERE octet_length(b) >= 100)),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM w),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM f WHERE nth > 1),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 99 AS z FROM k GROUP BY doc_id, k),
cuts AS (SELECT doc_id, a, z FROM s UNION ALL SELECT doc_id, octet_length(b) + 1, octet_length(b) FROM d),
keep AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a, z), 0) + 1 AS since FROM cuts)
SELECT doc_id, CAST(any_value(octet_length(b)) AS BIGINT) AS n_bytes, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans, sha256(unhex(string_agg(CASE WHEN a > since THEN hex(b[since:a - 1]) ELSE '' END, '' ORDER BY a, z))) AS kept_sha256
FROM keep JOIN d USING (doc_id) GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
