"""Sharding by minimax contiguous partition of atomic groups of equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, before_runs, running, sorted_runs, whole

#: Capacities tried at once; each round of the search divides its range by one more.
TRIED = 63


def smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which greedy cutting needs at most so many shards, and its cuts.

    ends has one long column ``end``: the running totals of the ordered groups. Binary search, with TRIED capacities
    in one pass: the greedy check of a capacity asks ``shards`` times for the last group end that still
    fits, and all capacities of a round ask together. Only ends within one group size of what is asked are read,
    which the scan's min-max statistics prune. Per pass TRIED numbers come to the driver.
    """

    def last_fit(limits: list[int]) -> list[int]:
        near = ends.filter((F.col("end") > min(limits) - largest - 1) & (F.col("end") <= max(limits)))
        row = near.agg(*(F.max(F.when(F.col("end") <= t, F.col("end"))).alias(f"t{i}") for i, t in enumerate(limits))).first()
        return [x or 0 for x in row]

    def check(capacities: list[int]) -> list[list[int]]:
        cuts: list[list[int]] = [[] for _ in capacities]
        for _ in range(shards):
            going = [i for i, c in enumerate(cuts) if not c or c[-1] < total]
            if not going:
                break
            found = last_fit([min(total, (cuts[i][-1] if cuts[i] else 0) + capacities[i]) for i in going])
            for i, end in zip(going, found, strict=True):
                cuts[i].append(end)
        return cuts

    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    best = None
    while best is None or low < high:
        tried = sorted({low + (high - low) * k // TRIED for k in range(TRIED + 1)})
        for c, cuts in zip(tried, check(tried), strict=True):
            if cuts[-1] >= total:
                high, best = c, cuts
                break
            low = c + 1
    return high, best + [total] * (shards - len(best))


def shard_documents(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals rows out to contiguous shards of near equal bytes: id, size, text_crc32, law, shard, slot, grown_shard.

    A row's size is the UTF-8 bytes of its text plus 1 (null text: 1). Rows of equal text are one atomic group; groups are
    ordered by their smallest id and cut into ``shards`` runs so that the largest is as small as possible. law is
    "bytes"; grown_shard is null, as another shard count moves rows between all shards. slot counts the rows of a shard
    from 0, by group and then id. Ids that repeat and null ids (first) are rows like any others. An empty table gives an
    empty result. Columns of df other than the id and the text aren't read.

    Equal texts are found by SHA-256, so that no text is shuffled. A group of copies is summed map-side; its rows meet
    their group's place by a join that Spark can split. Running totals come from range-partitioned
    runs and one broadcast row per run.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    text = whole(text_col)
    base = scratch.table(df.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_key")), "base")
    groups = base.groupBy("_key").agg(F.min("_id").alias("_first"), F.sum("_size").alias("_bytes"))
    runs = sorted_runs(groups, ["_first", "_key"], scratch, "groups")
    ends = scratch.table(running(runs, "_bytes", "end").select("_key", "_first", "_bytes", "end"), "ends")
    total, largest = ends.agg(F.sum("_bytes"), F.max("_bytes")).first()
    cuts = smallest_capacity(ends.select("end"), total, largest, shards)[1] if total else []
    shard = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    placed = base.join(ends.select("_key", "_first", shard.cast("int").alias("_shard")), "_key")
    runs = sorted_runs(placed.select("_id", "_size", "_crc", "_shard", "_first", "_key"), ["_shard", "_first", "_key", "_id"], scratch, "placed")
    # A run covers the end of one shard, whole shards, and the start of another: one row for each.
    parts = runs.groupBy("_pid", "_shard").agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_from"))
    w = Window.partitionBy("_shard").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_pid", "_shard", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_from")).alias("_shift"))
    out = runs.join(F.broadcast(parts), ["_pid", "_shard"])
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), (F.col("_idx") + F.col("_shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
