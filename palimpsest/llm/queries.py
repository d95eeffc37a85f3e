"""The registered queries of the training-data operators, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(mod: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string")) % mod == rest


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the word vocabulary, as digests."""
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; labels of rows with crc32(doc_id) mod 3 = 1 are never read by the fit."""
    from . import quality

    rows = written(quality.features(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").filter(~_held_out(3, 1)).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(rows.join(labels, "doc_id"))
    scored = quality.score(rows, model)
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; rows with crc32(doc_id) mod 4 = 2 are never trained on."""
    from . import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~_held_out(4, 2)))
    return langid.predict(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: one row for each pair."""
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that repeat those of documents of smaller doc_ids: one row a passage, with the smallest source."""
    from .substring import repeated_passages

    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("begin").alias("begin_word"), F.col("end").alias("end_word"), F.col("source").alias("source_doc_id"), F.col("source_begin").alias("source_begin_word"), "n_sources")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back by verified boundary chains."""
    from .warc import read_archives, write_archives

    read = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1, formatted and read back, as digests."""
    from .chat import format_chats, parse_chats

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    chats = format_chats(turns.union(tricky)).withColumn("formatted_chars", F.length("formatted").cast("long"))
    back = parse_chats(chats, keep=("conv_id", "formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every row whose vec_id is divisible by 100."""
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as binary records in the order of doc_id and read back."""
    from .records import read_records, write_records

    manifest = write_records(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_records(manifest).withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_language, op4_jaccard, op5_decontaminate, op6_substring, op7_warc, op8_chat, op9_nearest, op10_records)}


_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
     f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha),
     b AS (
       SELECT p.page_id, f.first, octet_length(encode(p.body)) AS n,
              array_to_string(list_transform(range(0, 160, 5),
                lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + list_sum(list_transform(range(0, 5),
                    lambda j: (((strpos('0123456789abcdef', substr(p.sha, ((i + j) // 4 + 1)::BIGINT, 1)) - 1) >> (3 - (i + j) % 4)::BIGINT) & 1) << (4 - j)::BIGINT))::BIGINT, 1)), '') AS digest
       FROM p JOIN f ON p.sha = f.sha)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""

_OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS begins,
         length(regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\]|/?ROLE\]|TURN\]|</?SYS>>)', '\1\2\\\3', 'g')) AS n,
         length(regexp_replace(role, '(<|\[)(\\*)(/?s>|/?INST\]|/?ROLE\]|TURN\]|</?SYS>>)', '\1\2\\\3', 'g')) AS r
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(n + CASE WHEN NOT begins THEN 8 ELSE 1 + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 23 + r END END) - 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP9 = """
WITH v AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: pow(q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE, 2)))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": _OP7, "op8_chat": _OP8, "op9_nearest": _OP9}
