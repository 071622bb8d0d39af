"""What the corpus operators share: shared scratch tables, text expressions and distributed running totals."""

from __future__ import annotations

import gc
import tempfile
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of all corpus contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all runs in one process, a folder of our own; elsewhere that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pixelchron-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written under the shared folder, which cut lineage and survive lost executors.

    A lazy result may still read them, so they stay until ``drop`` or until ``Scratch.release_all``.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch._open.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and reads it back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(conf).delete(path, True)

    def forget(self) -> None:
        """Has Spark delete the shuffle files of tables already written; else they stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def read_by(self, df: DataFrame) -> bool:
        """Whether df is still to be computed from these tables."""
        return any(self.path.rpartition("/")[2] in f for f in df.inputFiles())

    @classmethod
    def release_all(cls) -> None:
        """Deletes the tables of all earlier operator calls, once nothing lazy reads them any more."""
        while cls._open:
            cls._open.pop().drop()


def whole(text: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def without_spaces(text: Column) -> Column:
    """The text less every white space character: byte searches, no regular expression."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def spaced(text: Column) -> Column:
    """The text with every white space character as a plain space."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sorted_runs(df: DataFrame, order: list, scratch: Scratch, name: str) -> DataFrame:
    """df range-partitioned and sorted by order, written with _pid (its run) and _idx (its place in it).

    Runs follow one another in the global order, so a global position is a place in a run plus what earlier runs hold.
    """
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    out = scratch.table(out, name)
    return out.withColumn("_pid", F.shiftrightunsigned("_m", 33)).withColumn("_idx", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")


def before_runs(runs: DataFrame, values: list[str]) -> DataFrame:
    """Per run, the totals of values over all earlier runs, as _b_<value>. One row per run: bounded by the partition count."""
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.groupBy("_pid").agg(*(F.sum(v).alias(v) for v in values))
    return sums.select("_pid", *(F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_b_{v}") for v in values))


def running(runs: DataFrame, value: str, out: str, group: str | None = None) -> DataFrame:
    """Adds out: the total of value over all rows up to and with this one in the global order.

    Each run is summed by itself; the totals of earlier runs arrive as a small broadcast of one row per run.
    """
    w = Window.partitionBy("_pid").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    return runs.join(F.broadcast(before_runs(runs, [value])), "_pid").withColumn(out, F.sum(value).over(w) + F.col(f"_b_{value}")).drop(f"_b_{value}")


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in turn, in slices whose texts have most_bytes together or are a single row."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of each start and length, one after another."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def coded(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of lists of strings: the different strings, each item's place among them, and where each list ends in these places."""
    items = lists.flatten().dictionary_encode()
    return items.dictionary, items.indices.to_numpy().astype(np.int64), np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)


def joined(strings: pa.Array, mark: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), mark)[0].as_py()


class Store(dict):
    """Places of words in a flat store of their ids, for numpy to gather from. make gives a word's ids."""

    def __init__(self, make, fixed: tuple[str, ...] = ()):
        super().__init__({x: k for k, x in enumerate(fixed)})
        self.make, self._ids, self._ends = make, array("I"), array("q", [0] * (len(fixed) + 1))

    def add(self, ids) -> int:
        self._ids.extend(ids)
        self._ends.append(len(self._ids))
        return len(self._ends) - 2

    def add_all(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Adds new words whose ids follow one another in ids."""
        at = len(self._ends) - 1
        self._ends.frombytes((len(self._ids) + np.cumsum(lengths, dtype=np.int64)).tobytes())
        self._ids.frombytes(ids.astype(np.uint32).tobytes())
        self.update(zip(words, range(at, at + len(words)), strict=True))

    def __missing__(self, word: str) -> int:
        self[word] = at = self.add(self.make(word))
        return at

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at places, one word after another, and how many each has."""
        # Looked at only here: the arrays can't grow while numpy looks at them.
        ids, ends = np.frombuffer(self._ids, np.uint32) if self._ids else np.zeros(0, np.uint32), np.frombuffer(self._ends, np.int64)
        lengths = ends[places + 1] - ends[places]
        return gathered(ids, ends[places], lengths), lengths


class Known(dict):
    """What make gave for a key, for at most twice ``limit`` keys: a full generation becomes the old one, and what is asked of it returns."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 256:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
