"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard verification, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Known, Scratch, whole

WIDTH = 5
#: Places that the permutations permute. Shingles meet in a place only for candidates; links are decided on 64-bit hashes.
PLACES = 1 << 20
BANDS, ROWS = 32, 5
#: A bucket of at most so many different sets gives all its pairs; larger ones are searched through pivots.
SMALL = 8
#: A pivot is chosen from about so many sets of its family, and from about so many shingles in all. The choice changes what a run costs, never a link.
SAMPLE_SETS, SAMPLE_SHINGLES = 64, 1 << 20

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW_MULTIPLIERS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Signer:
    """Shingle sets and their circulant MinHash signatures."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, k = bands, rows, bands * rows
        rng = np.random.default_rng(4711)
        self.sigma = rng.permutation(PLACES).astype(np.uint32)
        pi = rng.permutation(PLACES).astype(np.uint32)
        # Coordinate k of a place is the second permutation, shifted by k: a window of it, so all coordinates of a place lie side by side.
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)
        self.words = Known(xxhash.xxh3_64_intdigest, 200_000)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the five-word shingles; of a shorter sequence of words, one for all of it."""
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if len(w) < WIDTH:
            return _mixed((w * _MULTIPLIERS[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))
        n = len(w) - WIDTH + 1
        h = w[:n] * _MULTIPLIERS[0]
        for k in range(1, WIDTH):
            h = h + w[k : n + k] * _MULTIPLIERS[k]
        return np.unique(_mixed(h))

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band."""
        at = self.sigma[(shingles & np.uint64(PLACES - 1)).astype(np.int64)]
        signature = reduce(np.minimum, (self.shifted[at[k : k + 2048]].min(axis=0) for k in range(0, len(at), 2048)))
        rows = signature.reshape(self.bands, self.rows).astype(np.uint64)
        return _mixed((rows * _ROW_MULTIPLIERS[: self.rows]).sum(axis=1, dtype=np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


_signers: dict[tuple[int, int], Signer] = {}


def _signer(bands: int = BANDS, rows: int = ROWS) -> Signer:
    if (bands, rows) not in _signers:
        _signers[bands, rows] = Signer(bands, rows)
    return _signers[bands, rows]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def linked_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node of edges(a, b): alternating large-star and small-star rounds until nothing changes.

    A round is two aggregations with a map-side combine and two joins that Spark can split; each is written, so lineage stays short.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before = None
    for k in range(200):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.table(large, f"large{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = scratch.table(small, f"small{k}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with linked: 100 * intersection >= percent * union, on the full sets."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("_x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("_y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    common = len(np.intersect1d(x, y, True))
                    out.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    return both.select("a", "b", "_x", "_y").mapInArrow(run, "a binary, b binary, linked boolean")


def bucket_pairs(members: DataFrame) -> DataFrame:
    left, right = members.select("key", F.col("cls").alias("a")), members.select("key", F.col("cls").alias("b"))
    return left.join(right, "key").filter("a < b").select("a", "b").distinct()


def families(members: DataFrame, scratch: Scratch) -> DataFrame:
    """family, cls: every class of a bucket with the family of the bucket, written once.

    A bucket is named after its class that shares most with others; classes take the best name of their buckets, and buckets the best
    name of their classes. So buckets of one text's copies mostly come to one name, and a class is in few families. Classes that
    share a bucket share a family: that bucket's.
    """
    weight = members.groupBy("cls").agg(F.sum("m").alias("w"))
    named = members.select("key", "cls").join(weight, "cls").groupBy("key").agg(F.max(F.struct("w", "cls")).alias("name"))
    # Each table of names is written, so that the join to it on a hot key starts from two exchanges, which Spark can split.
    named = scratch.table(named, "named0")
    best = scratch.table(members.select("key", "cls").join(named, "key").groupBy("cls").agg(F.max("name").alias("name")), "best")
    named = scratch.table(members.select("key", "cls").join(best, "cls").groupBy("key").agg(F.max("name").alias("name")), "named1")
    return scratch.table(members.select("key", "cls").join(named, "key").select(F.col("name.cls").alias("family"), "cls").distinct(), "families")


def pivots(family: DataFrame, sets: DataFrame) -> DataFrame:
    """Per family its pivot, a class of it, and what a sample of its sets holds: tokens (sorted), counts, in the pivot or not, and how many sets were looked at.

    The pivot is the sampled set nearest to the shingles that most sampled sets have. The sample is the class that gave the family its name and a share by hash.
    """
    sizes = family.join(sets.select("cls", "n"), "cls")
    total = sizes.groupBy("family").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_sum"))
    share = F.least(F.lit(SAMPLE_SETS) / F.col("_m"), F.lit(SAMPLE_SHINGLES) / F.col("_sum"))
    drawn = family.join(total, "family").filter((F.col("cls") == F.col("family")) | (F.pmod(F.xxhash64("family", "cls"), F.lit(1 << 30)) < share * (1 << 30)))
    drawn = drawn.select("family", "cls").join(sets.select("cls", "hashes"), "cls").groupBy("family").agg(F.collect_list(F.struct("cls", "hashes")).alias("drawn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                some = batch.column(1)[k].values
                names, found = some.field(0).to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in some.field(1)]
                tokens, counts = np.unique(np.concatenate(found), return_counts=True)
                usual = tokens[2 * counts > len(found)]
                away = [len(x) + len(usual) - 2 * len(np.intersect1d(x, usual, True)) for x in found]
                at = min(range(len(found)), key=lambda i: (away[i], names[i]))
                inside = np.isin(tokens, found[at], assume_unique=True)
                keep = inside | (counts > 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([names[at]], pa.binary()), *(pa.array([x[keep].tobytes()], pa.binary()) for x in (tokens, counts.astype(np.uint32), inside)), pa.array([len(found)], pa.int64())], ["family", "pivot", "tokens", "counts", "inside", "drawn"])

    return drawn.mapInArrow(run, "family binary, pivot binary, tokens binary, counts binary, inside binary, drawn bigint")


def star_of(family: DataFrame, pivot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Per family and class but the pivot: linked (to the pivot), n (size of its set), p_n (of the pivot's), delta (size of the symmetric difference) and members.

    members are the first of the difference, those rarest among the differences of the sample first, as many as another set linked to this one could have to share one of.
    """
    rows = family.join(pivot, "family").filter("cls <> pivot").join(sets.select("cls", "hashes"), "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, out = batch.slice(k, 256), []
                for *pivot_of, y in zip(*(part.column(c) for c in ("tokens", "counts", "inside", "drawn", "hashes")), strict=True):
                    tokens, counts, inside = (np.frombuffer(x.as_buffer(), t) for x, t in zip(pivot_of, (np.uint64, np.uint32, bool), strict=False))
                    drawn, y = pivot_of[3].as_py(), np.frombuffer(y.as_buffer(), np.uint64)
                    at = np.minimum(np.searchsorted(tokens, y), len(tokens) - 1)
                    met = tokens[at] == y
                    has = np.zeros(len(tokens), bool)
                    has[at[met]] = True
                    gone, odd = inside & ~has, has & ~inside
                    apart = np.concatenate([y[~met], tokens[odd], tokens[gone]])
                    rarity = np.concatenate([np.zeros(len(y) - int(met.sum()), np.int64), counts[odd], drawn - counts[gone].astype(np.int64)])
                    p_n = int(inside.sum())
                    common = p_n - int(gone.sum())
                    first = apart[np.lexsort((apart, rarity))][: int(len(y) * (100 - percent) / percent) + 2]
                    out.append((100 * common >= percent * (len(y) + p_n - common), len(y), p_n, len(apart), first.view(np.int64)))
                linked, n, p_n, delta, members = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("family", "pivot", "cls")), pa.array(linked, pa.bool_()), *(pa.array(x, pa.int64()) for x in (n, p_n, delta)), pa.array(members, pa.list_(pa.int64()))], ["family", "a", "b", "linked", "n", "p_n", "delta", "members"])

    rows = rows.select("family", "pivot", "cls", "tokens", "counts", "inside", "drawn", "hashes")
    return rows.mapInArrow(run, "family binary, a binary, b binary, linked boolean, n bigint, p_n bigint, delta bigint, members array<bigint>")


def delta_pairs(star: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of a family, at least one of them not linked to the pivot, that share enough of what tells them from it to be linked.

    |x ^ y| is delta_x + delta_y - 2 * shared, and a link allows it at most k = (100 - percent) / (100 + percent) of both sizes, which
    gives the least number shared. If two sets share so many, then two prefixes of their differences, as short as that number allows, have a member in
    common. A pair that shares nothing is no closer than either set is to the pivot, so a link without anything shared is one that goes through the pivot anyway.

    As a set beside one that isn't linked to the pivot needs only about the first half of its difference, the usual members, which come last, meet rare ones alone:
    neither two sets apart from the pivot nor those linked to it are brought together by what many of them lack.
    """
    k = (100 - percent) / (100 + percent)
    rows = star.select("family", "b", "linked", "n", "delta", ((F.col("delta") + k * (F.col("n") - F.col("p_n"))) / 2 + 1e-6).alias("half"), F.posexplode("members").alias("at", "e"))
    part = lambda s, x: s.select("family", "e", *(F.col(c).alias(f"{x}_{c}") for c in ("b", "n", "delta", "at")))
    apart, short = rows.filter("not linked"), rows.filter("at <= half")
    least = F.greatest(F.lit(1), F.ceil((F.col("x_delta") + F.col("y_delta") - (F.col("x_n") + F.col("y_n")) * k) / 2 - 1e-9))
    close = (F.col("x_delta") - least >= F.col("x_at")) & (F.col("y_delta") - least >= F.col("y_at"))
    sizes = (100 * F.col("x_n") >= percent * F.col("y_n")) & (100 * F.col("y_n") >= percent * F.col("x_n"))
    found = []
    for left, right, ordered in ((apart.filter("at <= half"), short.filter("not linked"), F.col("x_b") < F.col("y_b")), (apart, short.filter("linked"), F.lit(True))):
        x, y = part(left, "x"), part(right, "y")
        pairs = x.join(y, (x["family"] == y["family"]) & (x["e"] == y["e"]) & close & sizes & ordered)
        found.append(pairs.select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b")).distinct())
    return found[0].unionByName(found[1]).distinct()


def near_duplicates(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, key_col: str | None = None) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept. Links: Jaccard similarity of five-word shingle sets of percent or more.

    Only A-Z are lower-cased; words are separated by ASCII white space. Fewer than five words are one shingle; a text without words, or null, has an
    empty set and is linked with nothing. component_id is the smallest id reachable over links, kept says that it is the row's
    own. Null ids are never smallest unless alone; rows that repeat an id are judged by their own texts. key_col, a string column, is carried along if given. Other columns of df aren't read.

    Rows of equal sets are one class from the start, however many, and need no link between them. Candidates are classes that share a band:
    at 32 bands of 5 a pair of similarity 0.8 is missed with probability 3e-6, one of 0.85 with 7e-9. A bucket of up to SMALL classes gives all its
    pairs. Larger ones are joined to families; in a family each class is compared with one pivot, and with those others that the differences from the pivot
    leave possible (delta_pairs), so nothing is capped and a large group of near copies doesn't give all its pairs. Every link is confirmed on full
    sets, of which only candidates' are kept.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "near")
    id_type = df.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _signer(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [signer.shingles(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([signer.keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())), *part.columns[2:]], ["id", "n", "cls", "keys", "extra"][: part.num_columns + 2])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _signer(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [signer.shingles(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "found", "hashes"])

    texts = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), *([F.col(key_col).alias("extra")] if key_col else []))
    signed = scratch.table(texts.mapInArrow(sign, f"id {id_type}, n bigint, cls binary, keys array<bigint>" + ", extra string" * bool(key_col)), "signed")
    classes = scratch.table(signed.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.any_value("keys").alias("keys")), "classes")
    banded = classes.select("cls", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = scratch.table(banded.join(shared, "key"), "members")
    edges, level = None, 0
    if not members.isEmpty():
        wanted = members.select("cls").distinct().join(classes.select("cls", "rep"), "cls")
        sets = texts.join(wanted, F.col("id").eqNullSafe(F.col("rep"))).select("text", "cls").mapInArrow(full, "cls binary, found binary, hashes binary")
        # A repeated id brings texts of other classes along.
        sets = sets.filter("cls = found").groupBy("cls").agg(F.any_value("hashes").alias("hashes"))
        sets = scratch.table(sets.withColumn("n", (F.octet_length("hashes") / 8).cast("long")), "sets")
        pairs, found = [bucket_pairs(members.filter(F.col("m") <= SMALL))], []
        members = members.filter(F.col("m") > SMALL)
        if not members.isEmpty():
            family = families(members, scratch)
            star = scratch.table(star_of(family, scratch.table(pivots(family, sets), "pivots"), sets, percent), "star")
            found.append(star.filter("linked").select("a", "b"))
            pairs.append(delta_pairs(star, percent))
        candidates = scratch.table(reduce(DataFrame.unionByName, pairs).distinct(), "candidates")
        found.append(verified(candidates, sets, percent).filter("linked").select("a", "b"))
        edges = scratch.table(reduce(DataFrame.unionByName, found), "edges")
    if edges is None or edges.isEmpty():
        named = classes.select("cls", F.col("rep").alias("least"))
    else:
        roots = linked_components(edges, scratch)
        joined = classes.select("cls", "rep").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
        least = joined.groupBy("root").agg(F.min("rep").alias("least"))
        named = scratch.table(joined.join(least, "root").select("cls", "least"), "named")
    carried = ["extra"] if key_col else []
    out = signed.select("id", "n", "cls", *carried).join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"), *(F.col(c).alias(key_col) for c in carried))
