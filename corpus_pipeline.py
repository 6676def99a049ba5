"""A corpus from documents: rule filter, near-duplicate removal, secret redaction, source mix, packed sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import mixing, packing, quality, secrets, simhash
from tallyweave.llm._shared import dropped, scratch_dir, stored
from tallyweave.llm.queries import tokenizer_path

#: Near-duplicates share five-word shingles to this degree.
SIMILARITY, SHINGLE = 0.8, 5


def _aside(docs: DataFrame, name: str) -> DataFrame:
    """A column that an operator adds under its own name keeps out of its way."""
    return docs.withColumnRenamed(name, f"__own_{name}")


def _back(docs: DataFrame, name: str) -> DataFrame:
    return docs.drop(name).withColumnRenamed(f"__own_{name}", name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, with all their columns.

    Null, empty and blank texts go (they have few words), whatever their other columns hold; equal rows fare alike; whole
    texts are judged, however long; no rows give none.
    """
    kept = quality.apply_rules(_aside(docs, "rejected_by")).where("rejected_by is null")
    return _back(kept, "rejected_by").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: of smallest id (null ids last), then of smallest text hash, then of smallest other columns.

    A row is told by its id and text, so one id may name several texts. All texts without words (null, empty, blank)
    are one group; fully equal rows leave one; columns of any name stay as they are; no rows give none.
    """
    groups = stored(simhash.text_groups(docs, SHINGLE, SIMILARITY).select("doc_id", "text_hash", "root"), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    marked = groups.join(stored(first, "first"), "root")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    away = stored(marked.where(~stays).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")).distinct(), "duplicates")
    twice = groups.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")).count().where("count > 1").select("__id", "__th")
    twice = stored(twice, "repeated")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    kept = docs.join(away.hint("merge"), same, "left_anti")  # it grows with the documents
    if not twice.limit(1).count():
        return kept
    equal = kept.join(twice, same, "left_semi").groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th")).agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return kept.join(twice, same, "left_anti").unionByName(equal.select("__row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and n_chars counted again where there were any.

    Null and empty texts stay as they are; equal rows fare alike; whole texts are read; all other columns stay; no rows give none.
    """
    found = secrets.find_secrets(_aside(docs, "secret_spans"))
    clean = secrets.redacted(F.col("text"), F.col("secret_spans"))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        changed = F.size("secret_spans") > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return _back(out, "secret_spans").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The source mix, as documents (cut to the words taken, repeated where a source repeats).

    A null source is a source; texts without words give nothing and go; equal rows are taken one by one; a long document may
    be taken in part; all other columns stay; no rows give none.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in the packed sequences.

    A null or empty text is its end mark alone; null ids stay null; every row is packed, equal ones too; a text of over 2048
    tokens is cut into pieces; other columns are left out; no rows give none.
    """
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("secret scans", redact_secrets),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: Tokenizing, drawing a mix and packing are not SQL: tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{i}")
        if i:
            dropped(docs)  # the stage's own input is read no more
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}")
    return docs
