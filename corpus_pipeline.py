"""A corpus pipeline: quality classifier, exact deduplication, near deduplication, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes each result as Parquet and
reads it for the next. All but the last return the columns of docs. Both deduplications tell rows apart by a key of their own, so null and
repeated ids do no harm; mixing goes by id and text digest, and of rows that agree in both it repeats all as it repeats one.

In every stage a null text is an empty one: the classifier scores it as it scores empty texts, the deduplications keep one such row (exact) and link it with nothing
(near), the mix never takes it, as it has no words. Null sources are a source. Texts of any length are read whole. An empty table passes through as an empty table. Extra
columns are carried along, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelchron.llm._common import Scratch, whole
from pixelchron.llm.bpe import encode_documents, token_digests
from pixelchron.llm.exact_dedup import drop_copies, numbered
from pixelchron.llm.mixing import mix
from pixelchron.llm.near_dedup import near_duplicates
from pixelchron.llm.quality_classifier import keep_quality

_stale: list[Scratch] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Drops the scratch tables of earlier stages, unless docs is still to be computed from them: stages may also be chained before anything is written."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        needed = [s for s in _stale if s.read_by(docs)]
        for s in _stale:
            if s not in needed:
                s.drop()
        mark = len(Scratch._open)
        out = f(spark, docs, sf_dir)
        _stale[:] = [*needed, *Scratch._open[mark:]]
        del Scratch._open[mark:]
        return out

    return run_stage


def _private(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns as c0, c1 and so on, so that none clashes with ours, and their new names."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), {c: f"c{i}" for i, c in enumerate(docs.columns)}


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts equal but for white space."""
    return drop_copies(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 or more; it is the one with the smallest id."""
    rows = numbered(docs, Scratch(spark, "near_rows"))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    groups = near_duplicates(rows, 80, "_row", at["text"]).select("_row", "component_id").join(rows.select("_row", F.col(at["doc_id"]).alias("_by")), "_row")
    stays = groups.groupBy("component_id").agg(F.min(F.struct(F.col("_by").isNull().alias("_null"), "_by", "_row"))["_row"].alias("_row"))
    return rows.join(stays.select("_row"), "_row", "left_semi").drop("_row").toDF(*docs.columns)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: not at all, once or twice."""
    rows, at = _private(docs)
    rows = rows.withColumn("_key", F.sha2(whole(at["text"]).cast("binary"), 256))
    times = mix(rows, at["doc_id"], at["text"], at["source"], key_col="_key").filter("times > 0")
    times = times.groupBy(F.col(at["doc_id"]).alias("_id"), F.col("_key").alias("_taken")).agg(F.max("times").alias("_times"))
    taken = rows.join(times, F.col(at["doc_id"]).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_taken")))
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1), "_times"))).select(*at.values()).toDF(*docs.columns)


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the mixed documents and decodes them again: doc_id, n_tokens and digests of ids and text."""
    from public_tokenizers import path

    return token_digests(encode_documents(docs, path("byte_bpe_50k.json")))


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("minhash_near_dedup", near), ("mixing", mixed), ("bpe", token_ids)]

#: The quality classifier isn't SQL; tests/llm/test_corpus_queries.py holds each stage's rows against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
