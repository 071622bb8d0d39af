"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax, beside a unigram base."""

from __future__ import annotations

import copy
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, coded, slices, whole

#: Stands for the end of a document; no word has a line feed in it.
END = "\n"
#: Classes: GROUPS groups of as many. The first half are single tokens, the end and the most frequent; the rest are classes of words by their last letters,
#: each in GROUPS parts by the word's hash.
GROUPS = 16
CLASSES = GROUPS * GROUPS
SINGLES = CLASSES // 2
#: Words are hashed to so many numbers where they are context; a number is also its word's part of its class.
WORDS = 1 << 16
#: Rows of hashed weights of each of the three layers, GROUPS weights each: as many as a TOKENS_A_ROW-th of the training tokens, LEAST_ROWS at least.
LEAST_ROWS, TOKENS_A_ROW = 1 << 12, 16
#: Up to so many rows a layer are held by the driver. More are dealt to experts of EXPERT_ROWS each, and a token goes to one of them.
SHARD_ROWS = EXPERT_ROWS = 1 << 15
#: Words with more training tokens don't choose an expert by themselves: at most half of the tokens that an expert has on average.
BUSY = 1 << 17
#: Tokens of whole documents that are dealt to the experts at once.
BLOCK_CONTEXTS = 1 << 21
#: Tokens that share one local dictionary while counts are looked up.
BLOCK_TOKENS = 3_000_000
CHUNK = 1 << 16


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of texts, A-Z in lower case, each word's place among them, and where each text ends in these places."""
    words, at, ends = coded(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    words = words.to_pylist()
    if "" in words:  # before or behind white space at either end of a text
        keep = at != words.index("")
        at, ends = at[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
    return words, at, ends


def squeezed(seq: np.ndarray) -> bytes:
    """Places as bytes for disk and shuffle: how many, then the four bytes of all places apart, compressed; the upper ones are nearly all 0."""
    planes = np.ascontiguousarray(seq.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(seq).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def unsqueezed(raw: pa.Buffer) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(pa.decompress(raw[4:], 4 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(-1)


def read_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents as places in the dictionary of their block, and the blocks' dictionaries, in one pass over the texts.

    Rows with a seq are documents: block, id, held, seq (the squeezed places of its tokens, the end included). Rows with a token are
    dictionary entries: block, token, place, c (how often the block's training documents have it).
    """
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held"), whole(text_col).alias("text"))
    names = ["block", "id", "held", "seq", "token", "place", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, docs, n, id_arrow = _Numbers(), [], 0, None
        numbers[END]

        def flush() -> Iterator[pa.RecordBatch]:
            block = uuid.uuid4().int >> 65
            counts = np.zeros(len(numbers), np.int64)
            if train := [seq for _, held, seq in docs if not held]:
                counts += np.bincount(np.concatenate(train), minlength=len(counts))
            for k in range(0, len(docs), 1000):
                part = docs[k : k + 1000]
                m = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([block] * m), pa.array([x[0] for x in part], id_arrow), pa.array([x[1] for x in part]), pa.array([squeezed(x[2]) for x in part], pa.binary()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)
            words = list(numbers)
            for k in range(0, len(words), 20_000):
                part = words[k : k + 20_000]
                m = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([block] * m), pa.nulls(m, id_arrow), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()), pa.array(part, pa.string()), pa.array(np.arange(k, k + m)), pa.array(counts[k : k + m])], names)

        for whole_batch in batches:
            id_arrow = whole_batch.schema.field(0).type
            for batch in slices(whole_batch, 2, 4 << 20):
                words, at, ends = split_words(batch.column(2))
                # Numbers of the block; the empty word isn't met any more.
                place = np.fromiter((numbers[w] if w else 0 for w in words), np.uint32, len(words))[at]
                seqs = np.split(np.insert(place, ends, 0), ends + np.arange(1, len(ends) + 1))[:-1]
                docs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), seqs, strict=True)
                n += sum(map(len, seqs))
                if n >= BLOCK_TOKENS:
                    yield from flush()
                    numbers, docs, n = _Numbers({END: 0}), [], 0
        if docs:
            yield from flush()

    return rows.mapInArrow(run, f"block bigint, id {id_type}, held boolean, seq binary, token string, place bigint, c bigint")


def suffix_class(token: Column) -> Column:
    return (SINGLES + F.pmod(F.xxhash64(F.right(token, F.lit(2))), F.lit(CLASSES - SINGLES))).cast("int")


def word_number(token: Column) -> Column:
    return F.pmod(F.xxhash64(token, F.lit(1)), F.lit(WORDS)).cast("int")


def part_of(number):
    """A word's part of its class, of numbers or columns."""
    return number % GROUPS


@dataclass
class Unigrams:
    """n tokens and v kinds in training, and for each class and part its tokens and kinds."""

    n: int
    v: int
    mass: np.ndarray
    kinds: np.ndarray


def look_up(blocks: DataFrame, entries: DataFrame, base: Unigrams, id_type: str) -> DataFrame:
    """Per document: id, held, n_tokens, n_known, base_score, within (log10 of its tokens in their parts), tokens (number and class, three bytes for each token, and the id's crc32), of (its block), nth (its place there)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        places = right["place"].to_numpy()
        c, kind, number = np.zeros(len(places), np.int64), np.zeros(len(places), np.uint8), np.zeros(len(places), np.uint16)
        c[places], kind[places], number[places] = right["c"].to_numpy(), right["cls"].to_numpy(), right["number"].to_numpy()
        score, part = np.log10((c + 0.1) / (base.n + 0.1 * (base.v + 1))), part_of(number)
        inner = np.where(kind < SINGLES, 0.0, np.log10((c + 0.1) / (base.mass[kind, part] + 0.1 * (base.kinds[kind, part] + 1))))
        seqs = [unsqueezed(x.as_buffer()) for x in left["seq"]]
        salts = [zlib.crc32(str(i).encode()).to_bytes(4, "little") for i in left["id"].to_pylist()]
        packed = [number[s].tobytes() + kind[s].tobytes() + salt for s, salt in zip(seqs, salts, strict=True)]
        return pa.table({"id": left["id"], "held": left["held"], "n_tokens": pa.array([len(s) for s in seqs], pa.int64()), "n_known": pa.array([int((c[s] > 0).sum()) for s in seqs], pa.int64()), "base_score": pa.array([float(score[s].sum()) for s in seqs], pa.float64()), "within": pa.array([float(inner[s].sum()) for s in seqs], pa.float64()), "tokens": pa.array(packed, pa.binary()), "of": left["of"], "nth": pa.array(np.arange(len(seqs)))})

    docs = blocks.filter("seq is not null").select(F.col("block").alias("of"), "id", "held", "seq")
    return docs.groupBy("of").cogroup(entries.groupBy("block")).applyInArrow(run, f"id {id_type}, held boolean, n_tokens bigint, n_known bigint, base_score double, within double, tokens binary, of bigint, nth bigint")


def unpacked(tokens: pa.Array) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The words' numbers and classes of each document, and its salt."""
    out = []
    for x in tokens:
        raw = np.frombuffer(x.as_buffer(), np.uint8)
        n = len(raw) // 3 - 1
        out.append((raw[: 2 * n].view(np.uint16), raw[2 * n : 3 * n], int.from_bytes(raw[3 * n :], "little")))
    return out


def _hashed(kind: int, value: np.ndarray, rows: int) -> np.ndarray:
    h = (value.astype(np.uint32) + np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h >> np.uint32(16) ^ h) & np.uint32(rows - 1)


@dataclass
class Window:
    """Tokens with what lies before them: their documents, numbers and classes, their places up to 3, the numbers and classes one, two and three before, and their documents' salts."""

    ids: np.ndarray
    y: np.ndarray
    cls: np.ndarray
    place: np.ndarray
    words: list[np.ndarray]
    classes: list[np.ndarray]
    salt: np.ndarray


def windows(docs: list[tuple]) -> Iterator[Window]:
    """All tokens of documents (numbers, classes and, if not 0, a salt) in chunks of whole documents."""
    at = 0
    while at < len(docs):
        upto, n = at, 0
        while upto < len(docs) and (upto == at or n + len(docs[upto][0]) <= CHUNK):
            n += len(docs[upto][0])
            upto += 1
        part = docs[at:upto]
        sizes = np.array([len(d[0]) for d in part])
        ids, y, cls = np.repeat(np.arange(at, upto), sizes), np.concatenate([d[0] for d in part]), np.concatenate([d[1] for d in part])
        place = np.arange(len(y)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

        def before(v: np.ndarray, k: int, none: int, place: np.ndarray = place) -> np.ndarray:
            p = np.full(len(v), none, np.uint32)
            p[k:] = v[:-k] if len(v) > k else v[:0]
            p[place < k] = none
            return p

        salt = np.repeat(np.array([d[2] if len(d) > 2 else 0 for d in part], np.uint32), sizes)
        yield Window(ids, y, cls, np.minimum(place, 3).astype(np.uint8), [before(y, k, WORDS) for k in (1, 2, 3)], [before(cls, k, CLASSES) for k in (1, 2, 3)], salt)
        at = upto


def features(words: list[np.ndarray], classes: list[np.ndarray]) -> list[np.ndarray]:
    pair = (words[1] * np.uint32(0x9E3779B1)) ^ words[0]
    return [classes[0], words[0] * np.uint32(3), pair, classes[2] * np.uint32(512) + classes[1]]


def expert_of(w: Window, busy: np.ndarray, experts: int) -> np.ndarray:
    """The expert of each token, chosen by the word before; where that has more than BUSY training tokens (busy, by number) by the two before, and where both have more by
    three. As these may still have as many tokens as the rarest of them, they then go to one expert for each BUSY of those, by the document's salt.
    """
    mass = [busy[x] for x in w.words]
    two = mass[0] > BUSY
    three = two & (mass[1] > BUSY)
    ways = -(-np.maximum(np.minimum(np.minimum(mass[0], mass[1]), mass[2]), 1) // BUSY)
    key = w.words[0] * np.uint32(0x27D4EB2F)
    key ^= np.where(two, w.words[1] * np.uint32(0x165667B1), np.uint32(0))
    key ^= np.where(three, w.words[2] * np.uint32(0xC2B2AE3D) + (w.salt % ways).astype(np.uint32) * np.uint32(0x9E3779B1), np.uint32(0))
    return _hashed(0, key, experts)


class MaxEnt:
    """Weights of the three layers: the group given the context, the class in its group, and for classes of many words the part of the class.

    The context are the word before and its class, the two words before as a pair, and, skipping one, the classes of the second and third before. In
    the inner layers a feature is one of them together with what is chosen already. Words go by their hashed numbers. Beyond EXPERT_ROWS, rows are
    those of experts, one after another, and a token meets only rows of its own (expert_of).
    """

    def __init__(self, mass: np.ndarray, rows: int, busy: np.ndarray | None = None):
        share = (mass + 0.1) / (mass + 0.1).sum()
        cls = share.sum(axis=1).reshape(GROUPS, GROUPS)
        outer = (np.log(cls.sum(axis=1))[None, :], np.log(cls / cls.sum(axis=1, keepdims=True)), np.log(share[SINGLES:] / share[SINGLES:].sum(axis=1, keepdims=True)))
        self.rows, self.busy, self.bias = rows, busy, [x.astype(np.float32) for x in outer]
        self.weights = [np.zeros((rows, GROUPS), np.float32) for _ in range(3)]

    def contexts(self, docs: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
        """Chunks of tokens: which document each is of, its number, its class, its features, and its expert's first row."""
        for w in windows(docs):
            first = expert_of(w, self.busy, self.rows // EXPERT_ROWS) * np.uint32(EXPERT_ROWS) if self.rows > EXPERT_ROWS else np.zeros(len(w.y), np.uint32)
            yield w.ids, w.y, w.cls, features(w.words, w.classes), first

    def layers(self, y: np.ndarray, cls: np.ndarray, features: list[np.ndarray], first: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray, list[np.ndarray], np.ndarray]]:
        """Per layer: its number, the tokens that have it, what they have chosen so far, the features' rows, the choice made."""
        group = cls // GROUPS
        many = np.flatnonzero(cls >= SINGLES)
        every = (slice(None), np.zeros(len(y), np.uint8), features, group), (slice(None), group, features, cls % GROUPS), (many, cls[many] - SINGLES, [f[many] for f in features], part_of(y[many]))
        for layer, (who, before, some, choice) in enumerate(every):
            rows = [_hashed(3 * layer + k + 1, f + before * np.uint32(0xC2B2AE35), min(self.rows, EXPERT_ROWS)) + first[who] for k, f in enumerate(some)]
            yield layer, who, before, rows, choice

    def logs(self, layer: int, before: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """The log probabilities of a layer's choices."""
        z = np.take(self.bias[layer], before, axis=0)
        for r in rows:
            z += np.take(self.weights[layer], r, axis=0)
        # Biases and weights stay far from where exp of a float32 ends, so no maximum has to be taken off first.
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def scores(self, docs: list[tuple], n: int | None = None) -> np.ndarray:
        """Per document the log10 probability of its classes and parts; n documents, if not as many as docs."""
        out = np.zeros(len(docs) if n is None else n)
        for ids, y, cls, features, first in self.contexts(docs):
            low = int(ids[0])
            for layer, who, before, rows, choice in self.layers(y, cls, features, first):
                logs = self.logs(layer, before, rows)
                found = np.bincount(ids[who] - low, logs[np.arange(len(choice)), choice].astype(float))
                out[low : low + len(found)] += found
        return out / np.log(10)

    def first_counts(self) -> list[np.ndarray]:
        return [np.zeros((self.rows, len(b)), np.float32) for b in self.bias]

    def first_gradient(self, docs: list[tuple], sums: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """gradient where all weights are 0, in counts alone: of what was chosen, into sums, and of what was chosen before, into counts, from which first_expected takes what was expected."""
        for _, y, cls, features, first in self.contexts(docs):
            for layer, _, before, rows, choice in self.layers(y, cls, features, first):
                chosen, prior = sums[layer].reshape(-1), counts[layer].reshape(-1)
                for r in rows:
                    r = r.astype(np.int64)
                    np.add.at(chosen, r * (GROUPS + 1) + choice, np.float32(1))
                    np.add.at(prior, r * counts[layer].shape[1] + before, np.float32(1))

    def first_expected(self, sums: list[np.ndarray], counts: list[np.ndarray]) -> None:
        for layer, n in enumerate(counts):
            sums[layer][:, :GROUPS] -= n @ np.exp(self.bias[layer])
            sums[layer][:, GROUPS] = n.sum(axis=1)

    def gradient(self, docs: list[tuple], sums: list[np.ndarray]) -> None:
        """Adds to sums, for each weight the observed less the expected, and in a last column how often its row is met."""
        for _, y, cls, features, first in self.contexts(docs):
            for layer, _, before, rows, choice in self.layers(y, cls, features, first):
                gap = self.logs(layer, before, rows)
                np.exp(gap, out=gap)
                gap[np.arange(len(choice)), choice] -= 1
                for r in rows if len(choice) else ():
                    r = r.astype(np.uint16 if len(self.weights[layer]) <= 1 << 16 else np.uint32)
                    order = np.argsort(r, kind="stable")
                    r = r[order]
                    starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                    met = r[starts]
                    sums[layer][met, :GROUPS] -= np.add.reduceat(np.take(gap, order, axis=0), starts, axis=0)
                    sums[layer][met, GROUPS] += np.diff(starts, append=len(r))


def stepped(g: np.ndarray, bias: np.ndarray, done: int, rate: float = 1.2, held_back: float = 20.0) -> np.ndarray:
    """What rows of summed gradients add to their weights in pass done."""
    prior = np.exp(bias).mean(axis=0)
    step = rate / (1 + 3 * done) * g[:, :GROUPS] / ((g[:, GROUPS:] + held_back) * np.maximum(prior, 0.01) + held_back / GROUPS)
    return np.clip(step / 2, -1.5, 1.5).astype(np.float32)


class Expert(MaxEnt):
    """The model of an expert's own tokens, whose docs are chunks as contexts gives them."""

    def __init__(self, bias: list[np.ndarray]):
        self.rows, self.busy, self.bias = EXPERT_ROWS, None, bias
        self.weights = [np.zeros((EXPERT_ROWS, GROUPS), np.float32) for _ in range(3)]

    def contexts(self, docs: list[tuple]) -> Iterator[tuple]:
        return iter(docs)

    def fit(self, docs: list[tuple], passes: int) -> None:
        for done in range(passes):
            sums, counts = [np.zeros((EXPERT_ROWS, GROUPS + 1), np.float32) for _ in range(3)], self.first_counts() if not done else []
            if done:
                self.gradient(docs, sums)
            else:
                self.first_gradient(docs, sums, counts)
                self.first_expected(sums, counts)
            for layer, s in enumerate(sums):
                self.weights[layer] += stepped(s, self.bias[layer], done)


def planes(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length for disk and shuffle: how many, then the bytes of each in turn, those of wide types apart, compressed."""
    apart = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return len(columns[0]).to_bytes(4, "little") + pa.compress(b"".join(apart), "zstd", asbytes=True)


def unplaned(raw: pa.Buffer, types: list[str]) -> list[np.ndarray]:
    n, sizes = int.from_bytes(raw[:4], "little"), [np.dtype(t).itemsize for t in types]
    flat, out = np.frombuffer(pa.decompress(raw[4:], n * sum(sizes), "zstd"), np.uint8), []
    for t, size in zip(types, sizes, strict=True):
        out.append(np.ascontiguousarray(flat[: n * size].reshape(size, n).T).view(t).reshape(n))
        flat = flat[n * size :]
    return out


#: A token for its expert: its class; whether it is held out, its place up to 3, its part; the classes and numbers before; by how much its document's place is beyond the last token's.
EVENT = ["u1", "u1", "u1", "u1", "u1", "<u2", "<u2", "<u4"]
#: What a document has of an expert's score, its place as above.
SHARE = ["<u4", "<f4"]


def dealt(docs: list[tuple], nth: np.ndarray, held: np.ndarray, busy: np.ndarray, experts: int) -> Iterator[tuple[int, bytes]]:
    """The documents' tokens by expert."""
    parts = []
    for w in windows(docs):
        part = np.where(w.cls >= SINGLES, part_of(w.y), 0).astype(np.uint8)
        flags = held[w.ids] | (w.place << 1) | (part << 3)
        expert = expert_of(w, busy, experts)
        expert = expert.astype(np.uint16) if experts <= 1 << 16 else expert
        parts.append([expert, w.cls, flags, *(c.astype(np.uint8) for c in w.classes), *(x.astype(np.uint16) for x in w.words[:2]), nth[w.ids].astype(np.uint32)])
    expert, *columns = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(expert, kind="stable")
    expert, columns = expert[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.diff(expert.astype(np.int64), prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(expert)], strict=True):
        yield int(expert[a]), planes([*(c[a:b] for c in columns[:-1]), np.diff(columns[-1][a:b], prepend=np.uint32(0))])


def learnt(cells: list[pa.Buffer], bias: list[np.ndarray], passes: int) -> list[bytes]:
    """Trains an expert on all its tokens that aren't held out, and gives for each cell its documents' shares of the scores of all."""
    got = [unplaned(x, EVENT) for x in cells]
    # Documents count from 0 over all cells.
    new = np.concatenate([np.concatenate([[True], c[7][1:] > 0]) for c in got])
    ids = np.cumsum(new) - 1
    cls, flags, c1, c2, c3, w1, w2 = (np.concatenate([c[k] for c in got]) for k in range(7))
    place = (flags >> 1) & 3
    known = lambda v, k, none: np.where(place < k, np.uint32(none), v)
    some = features([known(w1, 1, WORDS), known(w2, 2, WORDS)], [known(c1, 1, CLASSES), known(c2, 2, CLASSES), known(c3, 3, CLASSES)])
    first, part = np.zeros(CHUNK, np.uint32), flags >> 3

    def chunks(which: np.ndarray) -> list[tuple]:
        return [(ids[at], part[at], cls[at], [f[at] for f in some], first[: len(at)]) for k in range(0, len(which), CHUNK) for at in [which[k : k + CHUNK]]]

    model = Expert(bias)
    model.fit(chunks(np.flatnonzero(flags & 1 == 0)), passes)
    scores = model.scores(chunks(np.arange(len(ids))), int(ids[-1]) + 1).astype("<f4")
    out, low = [], 0
    for c in got:
        at = np.flatnonzero(np.concatenate([[True], c[7][1:] > 0]))
        out.append(planes([c[7][at], scores[low : low + len(at)]]))
        low += len(at)
    return out


def score_by_experts(table: DataFrame, bias: list[np.ndarray], rows: int, busy: np.ndarray, passes: int) -> DataFrame:
    """train and score for any number of rows: id, held_out, n_tokens, n_known, base_score, score.

    Each token crosses the shuffle once, to its expert, which has all rows that the token meets. An expert is trained and scores in one task, and gives back what each document
    has of its scores. So no weights or gradients cross it, and neither the driver nor a task holds rows of more than one expert.
    """
    id_type, experts = table.schema["id"].dataType.simpleString(), rows // EXPERT_ROWS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, docs, nth, held, n = None, [], [], [], 0

        def flush() -> pa.RecordBatch:
            cells = list(dealt(docs, np.array(nth), np.array(held, np.uint8), busy, experts))
            return pa.RecordBatch.from_arrays([pa.array([of] * len(cells), pa.int64()), pa.array([c[0] for c in cells], pa.int64()), pa.array([c[1] for c in cells], pa.binary())], ["of", "expert", "events"])

        for batch in batches:
            for block, place, out, doc in zip(*(batch.column(k).to_pylist() for k in range(3)), unpacked(batch.column(3)), strict=True):
                if docs and (block != of or n + len(doc[0]) > BLOCK_CONTEXTS):
                    yield flush()
                    docs, nth, held, n = [], [], [], 0
                of, n = block, n + len(doc[0])
                docs.append(doc)
                nth.append(place)
                held.append(out)
        if docs:
            yield flush()

    def learn(cells: pa.Table) -> pa.Table:
        return pa.table({"of": cells["of"], "shares": pa.array(learnt([x.as_buffer() for x in cells["events"]], bias, passes), pa.binary())})

    def gather(docs: pa.Table, shares: pa.Table) -> pa.Table:
        total = np.zeros(docs.num_rows)
        for x in shares["shares"]:
            beyond, score = unplaned(x.as_buffer(), SHARE)
            total[np.cumsum(beyond, dtype=np.int64)] += score
        score = total[docs["nth"].to_numpy()] + docs["within"].to_numpy()
        return pa.table({"id": docs["id"], "held_out": docs["held"], "n_tokens": docs["n_tokens"], "n_known": docs["n_known"], "base_score": docs["base_score"], "score": pa.array(score)})

    events = table.select("of", "nth", "held", "tokens").mapInArrow(deal, "of bigint, expert bigint, events binary")
    shares = events.groupBy("expert").applyInArrow(learn, "of bigint, shares binary")
    return table.drop("tokens").groupBy("of").cogroup(shares.groupBy("of")).applyInArrow(gather, f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def train(table: DataFrame, model: MaxEnt, passes: int) -> MaxEnt:
    """Gradient updates over all training documents: a pass sums gradients by partition, Spark adds them by row, and the driver, which gets one row for each row of weights, steps.

    A step (stepped) is divided by how often a row is met times the prior of each choice, which takes the place of second derivatives; held_back keeps rare rows near 0. Later
    passes take shorter steps: the features of a token overlap, and each corrects the whole error. Each task gives a row for each row of weights that it met, so
    few large tasks read the table.
    """
    columns = [f"g{k}" for k in range(GROUPS + 1)]
    docs = table.filter("not held").select("tokens")
    context = table.sparkSession.sparkContext
    docs = docs.coalesce(max(context.defaultParallelism, -(-docs.rdd.getNumPartitions() // 3)))
    for done in range(passes):

        def run(batches: Iterator[pa.RecordBatch], model: MaxEnt = model, first: bool = not done) -> Iterator[pa.RecordBatch]:
            sums, counts = [np.zeros((model.rows, GROUPS + 1), np.float32) for _ in range(3)], model.first_counts() if first else []
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    docs = unpacked(batch.column(0)[k : k + 512])
                    model.first_gradient(docs, sums, counts) if first else model.gradient(docs, sums)
            if first:
                model.first_expected(sums, counts)
            for layer, s in enumerate(sums):
                met = np.flatnonzero(s[:, GROUPS])
                yield pa.RecordBatch.from_arrays([pa.array(met + layer * model.rows, pa.int64()), *(pa.array(s[met, k]) for k in range(GROUPS + 1))], ["row", *columns])

        got = docs.mapInArrow(run, "row bigint, " + ", ".join(f"{c} float" for c in columns)).groupBy("row").agg(*(F.sum(c).cast("float").alias(c) for c in columns)).toArrow()
        at, sums = got["row"].to_numpy(), np.column_stack([got[c].to_numpy() for c in columns])
        del got
        after = copy.copy(model)
        after.weights = [w.copy() for w in model.weights]
        for layer in range(3):
            low = layer * model.rows
            of = (at >= low) & (at < low + model.rows)
            after.weights[layer][at[of] - low] += stepped(sums[of], model.bias[layer], done)
        model = after
    return model


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passes: int = 2) -> DataFrame:
    """Scores every row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    Tokens are words, A-Z in lower case, and one end. Rows whose crc32 of the id as text is 0 mod 10 are held out: neither
    counts nor weights come from them (a null id counts as "", which is held out). The base is the smoothed unigram of the contract. The model predicts
    each token's class, and in classes of many words a part of the class, from the words before it, through hashed n-gram and skip features and softmaxes in three steps; the token in its
    part has its smoothed frequency, where one more kind stands for all unknown words. So both are distributions over the same tokens. Null text is empty: only the end.
    Repeated ids are rows of their own. An empty table gives an empty result. Other columns aren't read.

    All counts are over all training texts. The vocabulary is never held in one place: blocks of documents have local
    dictionaries, these are joined with the counts by word, and each block gets its own back. The driver holds class totals, and weights up to SHARD_ROWS rows a layer; rows grow with the
    training tokens, and beyond that number they are those of experts (score_by_experts).
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "lm")
    id_type = df.schema[id_col].dataType.simpleString()
    blocks = scratch.table(read_blocks(df, id_col, text_col), "blocks")
    words = blocks.filter("token is not null").select("block", "token", "place", "c")
    counts = scratch.table(words.filter("c > 0").groupBy("token").agg(F.sum("c").alias("c")), "counts")
    top = counts.filter(F.col("token") != END).orderBy(F.desc("c"), "token").limit(SINGLES - 1).collect()
    singles = spark.createDataFrame([(END, 0), *((r["token"], k + 1) for k, r in enumerate(top))], "token string, single int")
    classed = counts.join(F.broadcast(singles), "token", "left").select("token", "c", F.coalesce("single", suffix_class(F.col("token"))).alias("cls"))
    mass, kinds = np.zeros((CLASSES, GROUPS)), np.zeros((CLASSES, GROUPS))
    for r in classed.groupBy("cls", part_of(word_number(F.col("token"))).cast("int").alias("part")).agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("k")).collect():
        mass[r["cls"], r["part"]], kinds[r["cls"], r["part"]] = r["m"], r["k"]
    base = Unigrams(int(mass.sum()), int(kinds.sum()), mass, kinds)
    entries = words.drop("c").join(classed.select("token", "c", "cls"), "token", "left")
    entries = entries.select("block", "place", F.coalesce("c", F.lit(0)).cast("long").alias("c"), F.coalesce("cls", F.when(F.col("token") == END, 0), suffix_class(F.col("token"))).cast("long").alias("cls"), word_number(F.col("token")).alias("number"))
    table = scratch.table(look_up(blocks, entries, base, id_type), "looked_up")
    rows = max(LEAST_ROWS, 1 << (base.n // TOKENS_A_ROW).bit_length())
    busy = np.zeros(WORDS + 1, np.int64)
    if rows > EXPERT_ROWS:
        # As many documents begin as end; before them is no word.
        busy[WORDS] = mass[0].sum()
        for r in classed.groupBy(word_number(F.col("token")).alias("number")).agg(F.sum("c").alias("m")).filter(F.col("m") > BUSY).collect():
            busy[r["number"]] = r["m"]
    scratch.drop("blocks")
    scratch.drop("counts")
    scratch.forget()
    named = lambda out: out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(base.n).cast("long").alias("train_tokens"), "base_score", "score")
    if rows > SHARD_ROWS:
        return named(score_by_experts(table, MaxEnt(mass, LEAST_ROWS).bias, rows, busy, passes))
    model = train(table, MaxEnt(mass, rows, busy), passes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                score = model.scores(unpacked(part.column(6)))
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(score + part.column(5).to_numpy())], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return named(table.mapInArrow(run, f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"))
