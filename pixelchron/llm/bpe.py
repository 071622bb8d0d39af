"""Byte-level BPE: encoding with a contiguous rank array for each word, and decoding."""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Store, coded, gathered, slices, whole

WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters of which every Unicode version says the same; a text with others is split by the tokenizers library.
SETTLED = regex.compile("[\x00-\x1b\x20-\x84\x86-ſ]*")
#: Words with more bytes than this are merged with a heap: the array is scanned once for each merge.
SHORT = 256
#: New words of up to so many bytes are merged together, those of equal length in one array.
TOGETHER = 40
#: Bytes of texts that are encoded at once. Parts, words and ids of a slice are many times its size and stay with the worker.
SLICE = 2 << 20
#: Words that a worker remembers between batches.
REMEMBERED = 300_000
#: A white space character before a plain space: the split at plain spaces isn't that of the words then.
BEFORE_SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "
NONE = 1 << 30


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, each with its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of a byte-level tokenizer file; equal to the tokenizers library without padding, truncation and special tokens of its own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, at = spec["model"], byte_chars()
        raw = {token: bytes(at[c] for c in token) for token in model["vocab"]}
        ids = {raw[token]: i for token, i in model["vocab"].items()}
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((model["vocab"][a], model["vocab"][b]), (rank, ids[raw[a] + raw[b]]))
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        tokens = {i: raw[t] for t, i in model["vocab"].items()} | {i: t.encode() for t, i in added.items()}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.path, self.store, self._library = path, Store(self._word), None
        # The same for numpy: pairs as sorted numbers, what they rank and give, and the ranks of pairs of bytes as a table.
        self.size = len(self.tokens)
        order = sorted(self.pairs, key=lambda p: p[0] * self.size + p[1])
        self.keys = np.array([a * self.size + b for a, b in order] + [1 << 62], np.int64)
        self.ranks = np.array([self.pairs[p][0] for p in order] + [NONE], np.int32)
        self.gives = np.zeros(max([*self.ranks[:-1].tolist(), 0]) + 1, np.int32)
        self.gives[self.ranks[:-1]] = [self.pairs[p][1] for p in order]
        self.first = np.array(self.of_byte, np.int32)
        self.of_bytes = self.rank(self.first[:, None], self.first[None, :])

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What merging a with b ranks, NONE if they don't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge for many words of equal length, a row of parts and a row of ranks for each: their ids, one word after another, and how many each has.

        In a round every word's least rank, leftmost first, is sought; its boundary goes, so all words still merging have one part less, and the ranks
        at both sides are looked up again. Words without a rank leave.
        """
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        parts, ranks, rows = self.first[raw], self.of_bytes[raw[:, :-1], raw[:, 1:]], np.arange(len(words))
        out, lengths = np.zeros(raw.shape, np.int32), np.zeros(len(words), np.int64)
        while len(rows):
            width = parts.shape[1]
            at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), NONE)
            live = least < NONE
            out[rows[~live], :width], lengths[rows[~live]] = parts[~live], width
            parts, ranks, rows, at, least = parts[live], ranks[live], rows[live], at[live], least[live]
            if not len(rows):
                break
            each, below = np.arange(len(rows)), np.arange(width - 1)
            parts = np.take_along_axis(parts, below + (below > at[:, None]), 1)
            parts[each, at] = self.gives[least]
            ranks = np.take_along_axis(ranks, below[:-1] + (below[:-1] >= at[:, None]), 1)
            left, right = at > 0, at < width - 2
            ranks[each[left], at[left] - 1] = self.rank(parts[each[left], at[left] - 1], parts[each[left], at[left]])
            ranks[each[right], at[right]] = self.rank(parts[each[right], at[right]], parts[each[right], at[right] + 1])
        return out[np.arange(out.shape[1]) < lengths[:, None]], lengths

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word.

        bounds holds where its parts begin, parts their ids, ranks what merging each with its right neighbour ranks. The
        least rank, leftmost first, is sought by a scan; its boundary goes, and the ranks at both sides are looked up again.
        """
        if len(word) > SHORT:
            return self.merge_long(word)
        pairs = self.pairs
        parts, bounds = [self.of_byte[b] for b in word], list(range(len(word) + 1))
        ranks = [pairs[p][0] if p in pairs else NONE for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            parts[i] = pairs[parts[i], parts[i + 1]][1]
            del parts[i + 1], bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs.get((parts[i - 1], parts[i]), (NONE,))[0]
            if i < len(ranks):
                ranks[i] = pairs.get((parts[i], parts[i + 1]), (NONE,))[0]
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """The same for a long word: the merges wait in a heap and the parts in a linked list, so time grows as n log n."""
        pairs, n = self.pairs, len(word)
        parts, left, right = [self.of_byte[b] for b in word], list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else -1
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j], right[i] = pairs[pair][1], None, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (p := (parts[a], parts[b])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], a, p))
        return [x for x in parts if x is not None]

    def words(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return WORDS.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        at = byte_chars()
        return [bytes(at[c] for c in w).decode() for w, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def _word(self, word: str) -> list[int]:
        return self.merge(word.encode())

    def learn(self, words: set[str]) -> None:
        """Adds new words to the store, short ones of equal length together."""
        if len(self.store) > REMEMBERED:
            self.store = Store(self._word)
        store, by_length = self.store, defaultdict(list)
        for w in words:
            if w not in store:
                by_length[len(w.encode())].append(w)
        for n, some in by_length.items():
            for k in range(0, len(some) if n <= TOGETHER else 0, 8192):
                part = some[k : k + 8192]
                store.add_all(part, *self.merge_together([*map(str.encode, part)]))

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces, each split into words by itself: a flat array, and where each piece starts and how long it is."""
        words = [*map(WORDS.findall, pieces)] if SETTLED.fullmatch("".join(pieces)) else [*map(self.words, pieces)]
        flat = [*chain.from_iterable(words)]
        self.learn(set(flat))
        ids, lengths = self.store.of(self.store.places(flat))
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = upto[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        starts = np.concatenate([[0], ends[:-1]])
        return ids, starts, ends - starts


    def _special(self, text: str) -> list[int]:
        some = [x for x in (self.special.split(text) if self.special else [text]) if x]
        ids, starts, lengths = self.pieces([x for x in some if x not in self.added])
        plain = iter(zip(starts.tolist(), lengths.tolist(), strict=True))
        out: list[int] = []
        for x in some:
            if x in self.added:
                out.append(self.added[x])
            else:
                at, n = next(plain)
                out.extend(ids[at : at + n].tolist())
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in a flat array, and how many each has.

        Where no white space stands before a plain space, a word with the space before it is split from its neighbours
        in any case. So Arrow takes texts apart at plain spaces and finds the different parts, and each is split and merged once. Other texts,
        and those with a special token, are pieces as a whole.
        """
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, BEFORE_SPACE)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(odd):
            texts_here = pc.if_else(pa.array(np.isin(np.arange(len(texts)), odd)), "", texts)
            special = [self._special(texts[int(k)].as_py()) for k in odd]
        else:
            texts_here, special = texts, []
        parts, at, ends = coded(pc.split_pattern(texts_here, " "))
        first = np.concatenate([[0], ends[:-1]])
        parts = parts.to_pylist()
        # The first part of a text has no space before it.
        starts_of = [parts[k] for k in at[first].tolist()]
        at[first] = len(parts) + np.arange(len(first))
        ids, starts, lengths = self.pieces([*(" " + x for x in parts), *starts_of])
        if special:
            starts[len(parts) + odd] = len(ids) + np.cumsum([0, *map(len, special[:-1])])
            lengths[len(parts) + odd] = [*map(len, special)]
            ids = np.concatenate([ids, np.array([x for y in special for x in y], np.uint32)])
        of = lengths[at]
        return gathered(ids, starts[at], of), np.diff(np.concatenate([[0], np.cumsum(of)])[ends], prepend=0)

    def decode_all(self, ids: np.ndarray, ends: list[int]) -> list[str]:
        """The texts of ids, special tokens included, cut at ends; bytes that aren't UTF-8 become U+FFFD."""
        return [b"".join(map(self.tokens.__getitem__, ids[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


_loaded: dict[str, ByteBPE] = {}


def _bpe(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, decoded: bool = True) -> Iterator[pa.RecordBatch]:
    """encode_documents for batches of id and text."""
    bpe = _bpe(path)
    for whole_batch in batches:
        for batch in slices(whole_batch, 1, SLICE):
            flat, sizes = bpe.encode_all(batch.column(1))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])
            columns, names = [batch.column(0), pa.array(sizes, pa.int64()), ids], ["id", "n_tokens", "ids"]
            if decoded:
                columns.append(pa.array(bpe.decode_all(flat, ends.tolist()), pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids (binary, little-endian unsigned 32-bit) and, if asked for, text decoded from those ids.

    A map over rows, without a shuffle: memory is that of an Arrow batch and of a bounded store of known words. Null
    text is empty: no ids, empty decoded text. Repeated and null ids are rows like others; columns of df other than the two
    aren't read. The vocabulary file is read by each worker and has to be at path on all of them.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    rows = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    out = rows.mapInArrow(lambda batches: encoded(batches, path, decoded), f"id {id_type}, n_tokens bigint, ids binary" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def token_digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the op10 query and the pipeline's last stage return, from encode_documents."""
    return df.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
