"""Queries on text corpora. SQL states what it can: round trips and totals. Tests hold the rest against brute force, round trips or labelled texts."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.llm import bpe, leakage, mojibake, pii
from draftlake.llm import sentences as cutting
from draftlake.runtime import checkpoint, load


def replacement_key(spark: SparkSession) -> bytes:
    """Key of the replacements: the session's setting `draftlake.redaction.key`, or a random one, with which nobody can repeat them."""
    named = spark.conf.get("draftlake.redaction.key", None)
    return named.encode() if named else secrets.token_bytes(32)


def _texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return mojibake.fields_of(load(spark, d, "summary_info"), load(spark, d, "decoded_mtext"), columns)


def _entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    fields = _texts(spark, d, "author", "last_saved_by", "comments")
    model = mojibake.train(fields)
    is_name = F.col("field").isin(*pii.NAME_FIELDS)
    lexicon = pii.learn(fields.filter(is_name), fields.filter(~is_name), model)
    return fields, pii.entities(fields, lexicon, model)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d)[1].select("src_table", "rec_id", "field", "pii_type").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    fields, found = _entities(spark, d)
    return pii.redact(fields, checkpoint(found), replacement_key(spark))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    fields = _texts(spark, d, "title", "author")
    return mojibake.garbled(fields, mojibake.train(fields))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("src_table", "rec_id", "field").distinct()


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(load(spark, d, "documents"))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again: its length and hash."""
    back = bpe.decode_documents(bpe.encode_documents(load(spark, d, "documents")))
    return back.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return cutting.sentences(load(spark, d, "documents"))


def p9_totals(spark: SparkSession, d: str) -> DataFrame:
    """Characters other than white space in the sentences of each document, read back by their places."""
    documents = load(spark, d, "documents")
    spans = cutting.sentences(documents).join(cutting.once(documents), "doc_id")
    own = F.substr("text", (F.col("start_pos") + 1).cast("int"), (F.col("end_pos") - F.col("start_pos")).cast("int"))
    return spans.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace(own, r"[\s\p{Z}\x{85}]", ""))).alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (p5_found, p5_redacted, p6_found, p6_restored, p7_ids, p7_texts, p8_found, p9_found, p9_totals)}

SQL: dict[str, str] = {
    "p7_texts": "select doc_id, length(coalesce(text, '')) as n_chars, md5(coalesce(text, '')) as text_md5 from documents",
    "p9_totals": "select doc_id, sum(length(body)) as n_chars from (select doc_id, regexp_replace(line, '[\\s\\p{Z}\\x{85}\\x0b]', '', 'g') as body, regexp_replace(line, '^[\\s\\p{Z}\\x{85}\\x0b]+|[\\s\\p{Z}\\x{85}\\x0b]+$', '', 'g') as trimmed from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)) "
    "where trimmed <> '' and not contains('={|}!*#:;<_-', left(trimmed, 1)) and not (starts_with(trimmed, '[[') and ends_with(trimmed, ']]')) group by doc_id",
}
