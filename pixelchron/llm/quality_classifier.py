"""Quality classifier: random Fourier features, ridge scores from summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, whole

#: Statistics of a text; see text_statistics.
N_STATS = 18
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_MARKS = b"#*$%&|<>"
_ENDS = b".?;:,"


def text_statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; shares are of bytes or words, counts are logarithms."""
    b = text.encode()
    words = b.split()
    n, size = len(words), len(b)
    if not n:
        return [0.0] * N_STATS

    def share(chars: bytes) -> float:
        return (size - len(b.translate(None, chars))) / size

    kinds = set(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(n), np.log1p(size), float(lengths.mean()), float(lengths.std()), np.log1p(int(lengths.max())),
        len(kinds) / n, np.log1p(len(kinds)), pairs / max(1, n - 1), sum(map(bytes.__eq__, words, words[1:])) / n,
        share(_UPPER), share(_LOWER), share(_DIGIT), share(_MARKS) * 10, share(b"!") * 10, share(_ENDS) * 10,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(map(bytes.istitle, words)) / n,
    ]


@dataclass
class QualityModel:
    """mean and scale standardise statistics; w, b make the Fourier features; beta scores them; knots and values calibrate."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([waves, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; where the isotonic fit is flat a trace of the raw score keeps their order."""
        if not len(self.knots):
            return np.full(len(x), 0.5)
        raw = self.features(x) @ self.beta
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 / (1 + np.exp(-4 * np.clip(raw - 0.5, -20, 20))), 0, 1)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values, two knots for each pool."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum, count, first, last
    for r, t in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        pools.append([t, 1, r, r])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, c, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += c
            pools[-1][3] = last
    knots = np.array([k for p in pools for k in (p[2], p[3])])
    values = np.array([v for p in pools for v in (p[0] / p[1],) * 2])
    return knots, values


def statistics_table(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """id, x (the statistics), held (crc32 of the id as text) for every row, written once: texts are read a single time."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = [text_statistics(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    rows = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(run, f"id {id_type}, x array<double>")
    return scratch.table(rows.withColumn("held", F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))), "statistics")


def fit(train: DataFrame, width: float = 1.0, features: int = 256, ridge: float = 1e-3, seed: int = 11, parts: int = 8) -> QualityModel:
    """Fits on train(x array<double>, y int, fold int), a bounded table.

    Each partition sums its own normal equations for either fold; the driver adds at most parts of them and solves. Calibration uses scores of
    each fold by the other's fit, so that it sees no score of a row that it was fitted on.
    """
    stats = train.agg(*(f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(N_STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    empty = stats is None or stats["m0"] is None
    mean = np.array([0.0 if empty else stats[f"m{i}"] for i in range(N_STATS)])
    scale = np.array([1.0 if empty else max(stats[f"s{i}"], 1e-3) for i in range(N_STATS)])
    rng = np.random.default_rng(seed)
    w = rng.normal(0, width / np.sqrt(N_STATS), (N_STATS, features))
    model = QualityModel(mean, scale, w, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([]), np.array([]))
    if empty:
        return model
    d = features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((2, d, d)), np.zeros((2, d))
        for batch in batches:
            x, y, fold = np.array(batch.column(0).to_pylist()), np.array(batch.column(1).to_pylist(), float), np.array(batch.column(2).to_pylist())
            z = model.features(x) if len(x) else np.zeros((0, d))
            for k in (0, 1):
                gram[k] += z[fold == k].T @ z[fold == k]
                right[k] += z[fold == k].T @ y[fold == k]
        yield pa.RecordBatch.from_pylist([{"gram": gram.tobytes(), "target": right.tobytes()}])

    sums = train.select("x", "y", "fold").coalesce(parts).mapInArrow(equations, "gram binary, target binary").collect()
    gram = sum(np.frombuffer(r["gram"]).reshape(2, d, d) for r in sums)
    right = sum(np.frombuffer(r["target"]).reshape(2, d) for r in sums)

    def solve(a: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) * np.eye(d) / 10, c)

    by_fold = [solve(gram[1], right[1]), solve(gram[0], right[0])]
    model.beta = solve(gram[0] + gram[1], right[0] + right[1])

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = np.array(batch.column(0).to_pylist()), np.array(batch.column(2).to_pylist())
            if len(x):
                z = model.features(x)
                raw = np.where(fold == 0, z @ by_fold[0], z @ by_fold[1])
                yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column(1)], ["raw", "y"])

    got = train.select("x", "y", "fold").mapInArrow(crossed, "raw double, y int").toPandas()
    model.knots, model.values = isotonic(got["raw"].to_numpy(), got["y"].to_numpy(float))
    return model


def train_quality(table: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_train: int, scratch: Scratch) -> QualityModel:
    """Fits on the rows of a statistics table that labels name, but for the held-out ones."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    train = table.filter("held % 3 != 1 and id is not null").join(marks, "id")
    train = scratch.table(train.select("x", "y", F.xxhash64("id").alias("hash")), "labelled")
    n = train.count()
    if n > max_train:
        train = train.filter(F.pmod("hash", F.lit(1_000_003)) < int(1_000_003 * max_train / n))
    return fit(scratch.table(train.select("x", "y", F.pmod(F.shiftright("hash", 20), F.lit(2)).cast("int").alias("fold")), "train"))


def classify_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 40_000) -> DataFrame:
    """Scores every row: id, held_out, score (0 to 1, higher is better), predicted (1 from 0.5 on).

    held_out rows (crc32 of the id as text, mod 3, is 1) lend no label. The others' labels train; of more than max_train
    labelled rows a share by hash of the id is taken, so that at most about max_train train. That bound holds for the fit alone: statistics and scores
    are those of every whole text. Scores depend on the text and nothing else; null text is empty. A document labelled twice counts with its highest
    label; a null label or id doesn't train. Repeated and null ids are scored as rows of their own. Without any
    label every score is 0.5. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "quality")
    table = statistics_table(df, id_col, text_col, scratch)
    model = train_quality(table, labels, id_col, label_col, max_train, scratch)
    id_type = dict(table.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist())
            score = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = table.select("id", "x", (F.col("held") % 3 == 1).alias("held_out"))
    return rows.mapInArrow(run, f"id {id_type}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 40_000) -> DataFrame:
    """The rows of df whose text scores 0.5 or more, with all their columns: classify_quality as a filter.

    Rows pass through the workers whole, so nothing is joined back and every row is judged by its own text.
    """
    scratch = Scratch(df.sparkSession, "quality")
    model = train_quality(statistics_table(df, id_col, text_col, scratch), labels, id_col, label_col, max_train, scratch)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                x = np.array([text_statistics(t or "") for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(model.score(x) >= 0.5))

    return df.mapInArrow(run, df.schema)
