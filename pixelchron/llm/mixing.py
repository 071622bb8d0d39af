"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, before_runs, n_words, running, sorted_runs, whole

WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(_source, _total) with _target: share of all sizes by weight, none above most times its source's size.

    Sources in code point order, null last, have the weights in turn. The excess of sources that reach their ceiling goes to the
    others by weight, again and again; that ends where each source gets min(ceiling, level * weight) with one level
    for all. Sorted by ceiling / weight the full sources are a prefix, so running sums find the level. The table has one
    row per source, so a single sort of it is cheap.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    n = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (n + 1).cast("int"))
    t = sizes.withColumn("_w", w).withColumn("_ceiling", F.lit(float(most)) * F.col("_total"))
    by = Window.orderBy(F.col("_ceiling") / F.col("_w"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({"_full": F.coalesce(F.sum("_ceiling").over(by), F.lit(0.0)), "_w_full": F.coalesce(F.sum("_w").over(by), F.lit(0.0)), "_all": F.sum("_total").over(every) * F.lit(float(share)), "_w_all": F.sum("_w").over(every)})
    t = t.withColumn("_level", (F.col("_all") - F.col("_full")) / (F.col("_w_all") - F.col("_w_full")))
    # The level if all sources before this one in the order are full and none else; the first at which the next isn't full holds.
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_ceiling"), F.struct(F.col("_w_full"), F.col("_level")))).over(every)["_level"]
    return t.withColumn("_target", F.when(level.isNull(), F.col("_ceiling")).otherwise(F.least(F.col("_ceiling"), level * F.col("_w")))).select("_source", "_total", "_target")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix-1", key_col: str | None = None, broadcast_sources: int = 10_000) -> DataFrame:
    """How often the mix takes each row: id, size (words), source_size, target (of its source), times, taken (words).

    Each source is shuffled by the MD5 of seed and id, and may be gone through ``most`` times. A document's virtual finish
    time is the words of its source up to and with it, over the source's target. All documents and repeats are range-sorted by finish time and
    the sorted stream is cut where the total budget, the sum of targets, is used up, so each source gets its target
    to within a document. Null text has size 0; a row of size 0 is never taken. Null is a source like others. Rows that
    repeat an id and size are interchangeable. key_col, if given, is carried along. The result depends on the rows alone, not on partitions.

    Running totals within the sources and in the stream are those of range-partitioned runs, so no source, however
    large, meets in one task. The source table is broadcast only up to broadcast_sources rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    extra = [F.col(key_col).alias("_extra")] if key_col else []
    base = scratch.table(df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(whole(text_col)).alias("_size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_key"), *extra), "base")
    targets = scratch.table(source_targets(base.groupBy("_source").agg(F.sum("_size").alias("_total")), weights, share, most), "targets")
    n = targets.count()
    # What the sources before one hold, to get from totals over the sorted stream to totals within a source.
    ahead = Window.orderBy(F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    small = scratch.table(targets.withColumns({"_ahead": F.coalesce(F.sum("_total").over(ahead), F.lit(0)), "_known": F.coalesce(F.col("_source"), F.lit("")), "_null": F.col("_source").isNull()}).drop("_source"), "sources")
    runs = sorted_runs(base.withColumns({"_known": F.coalesce(F.col("_source"), F.lit("")), "_null": F.col("_source").isNull()}).drop("_source"), ["_null", "_known", "_key", "_id", "_size"], scratch, "by_source")
    rows = running(runs, "_size", "_upto").join(F.broadcast(small) if n <= broadcast_sources else small, ["_null", "_known"])
    rows = rows.withColumn("_cum", F.col("_upto") - F.col("_ahead"))
    rows = scratch.table(rows.select("_id", "_size", "_total", "_target", "_cum", "_key", "_null", "_known", *(["_extra"] if key_col else [])), "rows")
    finish = F.when(F.col("_target") > 0, (F.col("_cum") + F.col("_pass") * F.col("_total")).cast("double") / F.col("_target"))
    stream = rows.filter("_size > 0").withColumn("_pass", F.explode(F.array(*(F.lit(k) for k in range(most))))).withColumn("_finish", finish)
    order = ["_finish", "_null", "_known", "_key", "_id", "_size"]
    runs = sorted_runs(stream.filter("_finish is not null").select(*order), order, scratch, "stream")
    budget = targets.agg(F.sum("_target")).first()[0] or 0.0
    # Only the run in which the budget ends is looked at row by row.
    before = before_runs(runs, ["_size"])
    last = before.filter(F.col("_b__size") < budget).agg(F.max("_pid")).first()[0]
    cut = None
    if last is not None:
        w = Window.partitionBy("_pid").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
        end = runs.filter(F.col("_pid") == last).join(F.broadcast(before), "_pid").withColumn("_used", F.sum("_size").over(w) + F.col("_b__size"))
        cut = end.filter(F.col("_used") <= budget + 1e-6).agg(F.max(F.struct(*order))).first()[0]
        if cut is None:  # nothing of this run fits: the stream ends with the run before it
            cut = runs.filter(F.col("_pid") < last).agg(F.max(F.struct(*order))).first()[0]
    times = F.lit(0)
    if cut is not None:
        kinds = dict(runs.select(*order).dtypes)
        limit = F.struct(*(F.lit(cut[c]).cast(kinds[c]).alias(c) for c in order))
        for k in range(most):
            f = F.when(F.col("_target") > 0, (F.col("_cum") + k * F.col("_total")).cast("double") / F.col("_target"))
            times = times + F.when((F.col("_size") > 0) & (F.struct(f.alias("_finish"), *order[1:]) <= limit), 1).otherwise(0)
    return rows.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), times.cast("int").alias("times"), (times * F.col("_size")).cast("long").alias("taken"), *([F.col("_extra").alias(key_col)] if key_col else []))
