"""Token ids in flat binary files with 64-bit offsets, written in id order and read by memory map."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, Store, coded, gathered, joined, slices, whole
from .bpe import byte_chars

#: Stands for a null id in a file of ids.
NULL_ID = -(1 << 63)
#: Words that a worker remembers between batches.
REMEMBERED = 600_000
#: Texts of these characters alone are in NFC, lower-case one character at a time and split alike in every Unicode version.
SETTLED = regex.compile("[\t-\r\x20-\x7e\xa1-\u012f\u0131-\u0148\u014a-\u017f]*")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of pieces, and what parts the pieces.
WORDS = regex.compile(SPLIT + "|\n")
#: Stands for a piece that isn't settled; no settled piece has it.
ODD = "\0"


class Encoder:
    """Encodes as the tokenizers library does with a file, without special tokens of its own.

    A file whose normaliser is NFC, white space and lower case, and which keeps the matches of SPLIT, never looks
    across ASCII white space: Arrow splits a batch of texts there and finds the different pieces, and these are taken apart into words at once. The library's model
    takes each new word of settled characters; other pieces, and all texts under other files, go through the whole library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        added = spec.get("added_tokens", [])
        self.by_word = norm == ["NFC", "Replace", "Lowercase"] and pre[0].get("pattern") == {"Regex": SPLIT} and pre[0].get("invert") and spec["model"].get("dropout") is None
        self.by_word = self.by_word and not any(x.get("lstrip") or x.get("rstrip") or x["content"].split() != [x["content"]] for x in added)
        self.added = [x["content"] for x in added]
        self.size = self.library.get_vocab_size()
        self.to_chars = {b: c for c, b in byte_chars().items()}
        self.words = Store(self._model_word, ("\n", ODD))

    def _model_word(self, word: str) -> list[int]:
        chars = word if word.isascii() else word.encode().decode("latin-1").translate(self.to_chars)
        return [x.id for x in self.library.model.tokenize(chars)]

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def settled(self, text: str) -> bool:
        return SETTLED.fullmatch(text) is not None and not any(a in text for a in self.added)

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces without white space: a flat array, and where each piece starts and how long it is."""
        if len(self.words) > REMEMBERED:
            self.words = Store(self._model_word, ("\n", ODD))
        words, odd, text = self.words, [], joined(pieces, "\n")
        if not self.settled(text):
            each = pieces.to_pylist()
            fit = [self.settled(p) for p in each]
            odd = [words.add(self._whole(p)) for p, ok in zip(each, fit, strict=True) if not ok]
            text = "\n".join(p if ok else ODD for p, ok in zip(each, fit, strict=True))
        found = WORDS.findall(text.lower())
        at = words.places(found)
        at[at == 1] = odd
        flat, lengths = words.of(at)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        cuts = np.flatnonzero(at == 0)
        starts = upto[np.concatenate([[0], cuts + 1])]
        return flat, starts, upto[np.concatenate([cuts, [len(at)]])] - starts

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in a flat array, each text's with end_id behind them, and how many each has."""
        if not self.by_word:
            ids = [[*self._whole(t), end_id] for t in texts.to_pylist()]
            return np.array([x for y in ids for x in y], np.uint32), np.array([len(x) for x in ids], np.int64)
        pieces, at, ends = coded(pc.ascii_split_whitespace(texts))
        flat, starts, lengths = self.pieces(pieces) if len(pieces) else (np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * 2)
        # The end is one more piece, behind the last of each text.
        flat, starts, lengths = np.append(flat, np.uint32(end_id)), np.append(starts, len(flat)), np.append(lengths, 1)
        at = np.insert(at, ends, len(starts) - 1)
        of = lengths[at]
        upto = np.cumsum(of)[ends + np.arange(len(ends))]
        return gathered(flat, starts[at], of), np.diff(upto, prepend=0)


_loaded: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(df: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all rows' token ids in ascending id order and returns the manifest: part, path, n_docs, n_tokens, base, width.

    For each part there are three flat little-endian files: ``<path>.bin``, the ids, unsigned with 16 bits where the vocabulary
    and end_id allow it, else 32; ``<path>.idx``, one 64-bit offset for each document and one after the last, counted within the part;
    ``<path>.doc``, the 64-bit document ids. base is the count of ids in all parts before: a prefix sum over the manifest,
    which has one row per part. Each document's ids end with end_id.

    Rows are range-partitioned and sorted by id; a task streams its part to files of a name of its own and tells that
    name, so a task that is run again, or twice, harms nothing, and one that fails deletes what it wrote. folder is in a store that pyarrow opens: a path or a file:, hdfs: or s3: URI; by
    default it is in the shared folder. Ids must be whole numbers, as the format has 64 bits for each; others are refused. Null text is empty: only end_id. Null ids come first, as NULL_ID in the file. Rows that
    repeat an id are adjacent, in any order. An empty table has an empty manifest, and a part without rows no files. Other columns aren't read.
    """
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} is {df.schema[id_col].dataType.simpleString()}; token files hold 64-bit whole numbers")
    scratch = Scratch(df.sparkSession, "tokens")
    folder = folder or f"{scratch.path}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, store = TaskContext.get().partitionId(), _encoder(tokenizer), None
        width = 2 if max(encoder.size - 1, end_id) < 1 << 16 else 4
        path, n, offsets, docs, out = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}", 0, [np.zeros(1, np.int64)], [], None
        try:
            for whole_batch in batches:
                for batch in slices(whole_batch, 1):
                    if out is None:
                        store, root = _store(folder)
                        store.create_dir(root, recursive=True)
                        at = root + path[len(folder) :]
                        out = store.open_output_stream(f"{at}.bin")
                    ids, sizes = encoder.encode(batch.column(1), end_id)
                    out.write(ids.astype(f"<u{width}").tobytes())
                    offsets.append(n + np.cumsum(sizes))
                    n += len(ids)
                    docs.append(pc.fill_null(batch.column(0), NULL_ID).to_numpy())
            if out is None:
                return
            out.close()
            for kind, values in (("idx", np.concatenate(offsets)), ("doc", np.concatenate(docs))):
                with store.open_output_stream(f"{at}.{kind}") as file:
                    file.write(values.astype("<i8").tobytes())
        except BaseException:
            for kind in ("bin", "idx", "doc") if store else ():
                with contextlib.suppress(OSError):
                    store.delete_file(f"{at}.{kind}")
            raise
        yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": sum(map(len, docs)), "n_tokens": n, "width": width}])

    rows = df.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    parts = scratch.table(rows.mapInArrow(run, "part bigint, path string, n_docs bigint, n_tokens bigint, width bigint"), "manifest")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return scratch.table(parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))), "based")


def read_part(path: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids, offsets and document ids of a part; a memory map where the store is a local or shared file system."""
    from pyarrow import fs

    store, at = _store(path)
    out = []
    for kind, dtype in (("bin", f"<u{width}"), ("idx", "<i8"), ("doc", "<i8")):
        if isinstance(store, fs.LocalFileSystem):
            out.append(np.memmap(f"{at}.{kind}", dtype, "r"))
        else:
            with store.open_input_file(f"{at}.{kind}") as f:
                out.append(np.frombuffer(f.read_buffer(), dtype))
    return out[0], out[1], out[2]


def read_token_files(manifest: DataFrame, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """Per document, from the files of a manifest: id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat, offsets, docs = read_part(row["path"], row["width"])
                for k in range(0, len(docs), 1024):
                    ends = offsets[k : k + 1025].tolist()
                    raw = [flat[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]
                    names = docs[k : k + 1024]
                    columns = [pa.array(names, pa.int64(), mask=np.asarray(names == NULL_ID)), pa.array(np.array(ends[:-1]) + row["base"], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array(raw, pa.binary())] if ids else [])], ["id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    parts = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    out = parts.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * ids)
    return out.withColumnRenamed("id", id_col)
