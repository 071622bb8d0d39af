"""Exact deduplication by distributed MSD radix partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, whole, without_spaces

#: Bytes that the first split looks at; each later split looks at three times what is behind it, but at MOST_BYTES at most, so that no key is longer.
FIRST_BYTES, MOST_BYTES = 256, 1 << 20


def normalised(text: str) -> Column:
    """What equality compares: the text, null as empty, less every white space character."""
    return without_spaces(whole(text))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """Groups rows whose texts are the same but for white space: id, carry columns, keep_id, group_size, kept.

    Documents start in one group. A round splits every open group by the next bytes of its texts; a group of one
    document, and a group whose texts end within those bytes, is done. Equality is that of all bytes: nothing is hashed
    to decide it. A round counts its children with a map-side combine, so a group of copies of any size never meets
    in one task, and only documents of open groups of two or more go on, so later rounds read what is still equal so far.
    Bytes grow fourfold a round up to MOST_BYTES: the longest text of an open group sets the number of rounds.

    Of a group the row with the most code points, then the smallest id, of any type that has an order, stays. Null text is empty; empty texts are
    equal to each other and to texts of spaces. A null id comes after all others. Rows that repeat an id count each for themselves
    and kept is true on each that carries the id kept. An empty table gives an empty result. Other columns
    of df are read only if carry names them, whatever they are called.
    """
    spark, carry = df.sparkSession, carry or []
    scratch = Scratch(spark, "exact")
    rows = df.select(F.col(id_col).alias("_id"), F.struct(F.lit(0).alias("_"), *carry).alias("_carry"), normalised(text_col).alias("_n"), F.char_length(whole(text_col)).alias("_cp"), F.lit(0).cast("long").alias("_node"))
    lo, hi, done, n_round = 0, first_bytes, [], 0
    while True:
        keyed = rows.withColumns({"_piece": F.substring(F.col("_n").cast("binary"), lo + 1, hi - lo), "_ended": F.octet_length("_n") <= hi})
        keys = ["_node", "_piece", "_ended"]
        best = F.min(F.struct((-F.col("_cp")).alias("_less"), F.col("_id").isNull().alias("_null"), F.col("_id").alias("_keep")))
        nodes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), best.alias("_best")).filter("_size > 1")
        nodes = scratch.table(nodes.select(*keys, "_size", F.col("_best._keep").alias("_keep"), F.monotonically_increasing_id().alias("_child")), f"nodes{n_round}")
        step = keyed.join(nodes, keys, "left")
        is_open = F.col("_child").isNotNull() & ~F.col("_ended")
        step = step.select("_id", "_carry", F.when(is_open, F.col("_n")).alias("_n"), "_cp", F.when(is_open, F.col("_child")).alias("_node"), F.when(F.col("_child").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_size", F.lit(1)).cast("long").alias("_size"))
        step = scratch.table(step, f"step{n_round}")
        if n_round:
            scratch.drop(f"nodes{n_round}")
        done.append(step.filter("_node is null").select(F.col("_id").alias(id_col), "_carry.*", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_keep").eqNullSafe(F.col("_id")).alias("kept")).drop("_"))
        rows = step.filter("_node is not null").select("_id", "_carry", "_n", "_cp", "_node")
        if rows.isEmpty():
            break
        lo, hi, n_round = hi, min(hi * 4, hi + MOST_BYTES), n_round + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def numbered(df: DataFrame, scratch: Scratch) -> DataFrame:
    """df with its columns as c0, c1 and so on, and _row, a key of each row; written once, so that the key stays."""
    return scratch.table(df.toDF(*(f"c{i}" for i in range(len(df.columns)))).withColumn("_row", F.monotonically_increasing_id()), "numbered")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of df for each group of equal texts, with all its columns and in their schema.

    It is the row with the most code points, then the smallest id, null last; of rows that agree in both any one stays. Rows are told apart by a key of
    their own, so null and repeated ids neither keep a copy nor drop a row of another text.
    """
    rows = numbered(df, Scratch(df.sparkSession, "copies"))
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    keyed = rows.withColumns({"_by": F.col(at[id_col]), "_less": -F.char_length(whole(at[text_col]))})
    copies = exact_dedup(keyed, "_row", at[text_col], ["_less", "_by"]).filter("group_size > 1")
    stays = copies.groupBy("keep_id").agg(F.min(F.struct("_less", F.col("_by").isNull().alias("_null"), "_by", "_row"))["_row"].alias("_row"))
    # Joined by row and not by group: a group of any size is spread.
    gone = copies.select("_row").join(stays.select("_row"), "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").drop("_row").toDF(*df.columns)
