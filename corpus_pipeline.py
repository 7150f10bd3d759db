"""The corpus pipeline over ``documents``: five stages, each written as Parquet and read by the next.

Language identification rejects texts without a letter and fills in missing languages, line dedup cuts repeated chunks, the n-gram
join leaves one document of each group, mixing takes each document as often as its source's target
asks, and the last stage encodes and decodes what is left.

Rows: texts of any length are read whole.  A null or letterless text goes in the first stage.  Of similar documents that with the
smallest id stays (null ids last, then the smaller hash of the text); of rows with equal id and text, which one stays follows from their
other columns, and two equal rows leave one.  Ties in the mix go by a seeded hash.  Columns besides ``doc_id``, ``text``, ``lang``,
``source`` and ``n_chars`` keep their values whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymill.llm import bpe, langid, line_dedup, mixing, ngram_join
from daymill.session import staged

#: Columns that stages read; all others travel in one, so that no result of an operator takes their name.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def packed(docs: DataFrame) -> DataFrame:
    """The columns that stages read, and ``_others``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in READ]
    return docs.select(*(c for c in READ if c in docs.columns), *([F.struct(*others).alias("_others")] if others else []))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` of a packed table with the columns of ``docs``."""
    return rows.select(*(F.col(c) if c in READ else F.col(f"_others.`{c}`") for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a named language, learned from ``lang`` where it is given, and ``lang`` filled with it where it is null.

    Where no row has a label nothing is named, and those with a letter stay as they are.
    """
    named = langid.identify(packed(docs))
    known = named.where((F.col("lang_pred") != "und") | F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return unpacked(known.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit("und")))), docs)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks; those that consist of nothing else go."""
    cut = line_dedup.remove_repeated_chunks(packed(docs))
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return unpacked(left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left, docs)


def ngram_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the smallest id, nulls last, then the smallest hash of the text."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    found = ngram_join.similar_components(docs.select(key.alias("key"), "text"), "key")
    marks = found.groupBy("key").agg(F.bool_or(F.col("key") != F.col("component_id")).alias("goes"), F.count("*").alias("n"), F.max("n_shingles").alias("size"))
    marks = staged(marks.where("goes or n > 1 and size > 0"), "marks")
    rows = packed(docs).withColumn("key", key)
    repeats = rows.join(marks.where("not goes").select("key"), "key", "left_semi")
    every = F.xxhash64(*(c for c in rows.columns if c != "key"))
    one = repeats.groupBy("key").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "key")), every).alias("row")).select("row.*")
    return unpacked(rows.join(marks.select("key"), "key", "left_anti").drop("key").unionByName(one), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix_sources(packed(docs), F.array("source"), mixing.words("text"))
    return unpacked(mixed.select("*", F.explode("copies")), docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the text that they decode to."""
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_chunks),
    ("n-gram Jaccard join", ngram_groups),
    ("source mix", source_mix),
    ("BPE encoding and decoding", bpe_codec),
]
#: Language identification and merging by rank are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
