"""Token ids as flat binary files that can be memory-mapped.

One output folder holds, for each shard k:

    tokens-k.bin    ids of all documents of the shard, one after another,
                    unsigned little-endian, 16 bits if every id fits, else 32
    offsets-k.bin   unsigned 64-bit: n + 1 offsets, in ids from the shard's start
    ids-k.bin       signed 64-bit: the n document ids
    nulls-k.bin     n bytes, 1 where the document id is null
    manifest.parquet  (shard, base, n_docs, n_tokens, width): base is the number
                    of ids in all shards before, by prefix sum

Documents are range-partitioned and sorted by (doc_id, a hash of the text, text), so shards and the
documents in them ascend.  Each task encodes its texts in bounded batches and
streams them to files under a name of its own attempt, which it then renames:
a task that is run again, after a lost executor, writes the same bytes.  The
folder must be one that all executors share (``spark.checkpoint.dir`` by
default); any file system that ``pyarrow.fs`` knows will do.  Local paths are
memory-mapped for reading, others are read by range.

Byte-level tokenizers with the usual pattern never join a space, or a line end,
to what stands before it when a word follows, nor a stop to a letter before it.  For these, texts are cut there,
each distinct piece of a batch is encoded once, and the ids are gathered; the
result is that of whole texts.  Of a run of white space before a word only the
last character stands alone, so a cut after a line end needs one before it too.
A text's end and an added token end such a run, so no word follows it there.
Other tokenizers encode whole texts.

Cases: a null or empty text has only the end id.  A null doc_id comes first.
Repeated ids and rows are kept as separate documents.  An empty table gives a
manifest without shards.  A text longer than a batch is a batch of its own.
"""

from __future__ import annotations

import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels
from .shared import filesystem_of, materialise, new_path

BATCH_CHARS = 2_000_000


def _encoder(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


#: Pieces whose ids a worker keeps between batches, and the bytes of all of them.
KEPT_PIECES = 1_000_000
KEPT_BYTES = 32_000_000

#: Bytes that can follow a cut: printable ASCII, and first bytes of characters of which none is white space.
_AFTER = kernels.class_table((0x21, 0x7E), (0xC3, 0xDF), (0xE4, 0xF4))
_INK = kernels.class_table((0x21, 0x7E))
_LETTER = kernels.class_table((0x41, 0x5A), (0x61, 0x7A))
_STOP = kernels.class_table((0x2C, 0x2C), (0x2E, 0x2E))


def _cuts_hold(encoder) -> bool:
    """Whether ids of pieces are those of the whole text: byte level, the usual pattern, nothing else."""
    parts = json.loads(encoder.to_str())
    first = parts.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    model = parts["model"]
    ordinary = model.get("type") == "BPE" and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("dropout")
    added = all(not any(x.isspace() for x in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in parts.get("added_tokens", []))
    return bool(plain and ordinary and added and not parts.get("normalizer") and not parts.get("truncation") and not parts.get("padding"))


class _Pieces:
    """Encodes batches of texts by their distinct pieces."""

    def __init__(self, encoder, end_id: int, dtype: str) -> None:
        self.encoder, self.end, self.dtype = encoder, end_id, dtype
        self.added = [t["content"].encode() for t in json.loads(encoder.to_str()).get("added_tokens", [])]
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, self.dtype)
        self.raw, self.begin, self.end_ = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)  # the pieces' own bytes

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        ids = [np.array(e.ids + [self.end], self.dtype) for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(ids), np.array([len(x) for x in ids])

    def _added(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, bytes) of what may be an added token."""
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while token and at >= 0:
                yield at, len(token)
                at = raw.find(token, at + 1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows with their end ids, number of ids of each row).

        Pieces are looked up by hash and then compared byte by byte; should two
        different ones share a hash, the texts are encoded whole.
        """
        n_rows = len(offsets) - 1
        begins = np.zeros(len(data) + 1, bool)
        if len(data):
            after = _AFTER[data[1:]]
            after[offsets[(offsets > 0) & (offsets < len(data))] - 1] = False  # the next text
            begins[1:-1] = (data[1:] == 0x0A) & _INK[data[:-1]]
            begins[1:-1] |= _LETTER[data[:-1]] & _STOP[data[1:]]
            begins[:-2] |= ((data[:-1] == 0x0A) | (data[:-1] == 0x20)) & after
            begins[1:-1] |= (data[:-1] == 0x0A) & after
            for at, n in self._added(data):
                begins[max(at - 1, 0) : at + n] = False
        begins[offsets] = True
        begins[len(data)] = False
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        row = np.searchsorted(offsets, starts, side="right") - 1
        values, at, inverse = np.unique(kernels.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        first, last = starts[at], ends[at]
        if not kernels.same_spans(data, starts, ends, data, first[inverse], last[inverse]).all():
            return self._whole(data, offsets)
        place = np.searchsorted(self.known, values)
        new = np.ones(len(values), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != values[inside]
        old = place[~new]
        if not kernels.same_spans(data, first[~new], last[~new], self.raw, self.begin[old], self.end_[old]).all():
            return self._whole(data, offsets)
        if new.any():
            if len(self.known) + new.sum() > KEPT_PIECES or len(self.raw) + len(data) > KEPT_BYTES:
                self._forget()
                new[:] = True
            raw = data.tobytes()
            own = [raw[a:b] for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)]
            lists = [e.ids for e in self.encoder.encode_batch_fast([x.decode() for x in own], add_special_tokens=False)]
            size = np.array([len(x) for x in lists], np.int64)
            start = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(lists), self.dtype, int(size.sum()))])
            end = len(self.raw) + np.cumsum(last[new] - first[new])
            self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(own), np.uint8)])
            known = np.concatenate([self.known, values[new]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            for name, more in (("start", start), ("size", size), ("begin", end - (last[new] - first[new])), ("end_", end)):
                setattr(self, name, np.concatenate([getattr(self, name), more])[order])
            place = np.searchsorted(self.known, values)
        start, size = self.start[place][inverse], self.size[place][inverse]
        total = np.bincount(row, size, minlength=n_rows).astype(np.int64)
        out = np.full(int(total.sum()) + n_rows, self.end, self.dtype)
        target = np.cumsum(size) - size + row  # each row before adds an end id
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(target, size) + inner] = self.ids[np.repeat(start, size) + inner]
        return out, total + 1


_workers: dict[tuple, tuple] = {}


def _worker(tokenizer: str, end_id: int, width: int) -> tuple:
    """(encoder, pieces) of this process, which serves many tasks.

    A task's own function is sent by value, with copies of the names it uses; only
    a function of the module, sent by reference, sees the same table in each task.
    """
    if (tokenizer, end_id, width) not in _workers:
        new = _encoder(tokenizer)
        _workers[tokenizer, end_id, width] = new, _Pieces(new, end_id, f"<u{width}") if _cuts_hold(new) else None
    return _workers[tokenizer, end_id, width]


def _encode(encoder, pieces: _Pieces | None, column: pa.Array, end_id: int, dtype: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, number of ids of each row) of runs of rows."""
    if pieces is not None:
        for _, data, offsets in kernels.slices(column, BATCH_CHARS):
            yield pieces.encode(data, offsets)
        return
    texts = column.to_pylist()
    for first, last in _batches(texts):
        ids = [np.array(e.ids + [end_id], dtype) for e in encoder.encode_batch_fast(texts[first:last], add_special_tokens=False)]
        yield np.concatenate(ids), np.array([len(x) for x in ids])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, shards: int | None = None, text: str = "text") -> str:
    """Encode every document and write the files; returns the folder."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    width = 2 if max(_encoder(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = chosen.withColumn("spread", F.xxhash64("text")).repartitionByRange(n, "doc_id", "spread").sortWithinPartitions("doc_id", "spread", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = pieces = None
        files, filesystem, names = {}, None, {}
        n_docs = n_tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder, pieces = _worker(tokenizer, end_id, width)
                filesystem, root = filesystem_of(folder)
                filesystem.create_dir(root, recursive=True)
                attempt = uuid.uuid4().hex
                for kind in ("tokens", "offsets", "ids", "nulls"):
                    names[kind] = (f"{root}/_{attempt}-{kind}", f"{root}/{kind}-{shard:06d}.bin")
                    files[kind] = filesystem.open_output_stream(names[kind][0])
                files["offsets"].write(np.zeros(1, "<u8").tobytes())
            column = batch.column("doc_id")
            missing = np.asarray(column.is_null().to_numpy(zero_copy_only=False), np.uint8)
            files["ids"].write(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            files["nulls"].write(missing.tobytes())
            for ids, size in _encode(encoder, pieces, batch.column("text"), end_id, f"<u{width}"):
                ends = n_tokens + np.cumsum(size)
                files["tokens"].write(ids.tobytes())
                files["offsets"].write(ends.astype("<u8").tobytes())
                n_tokens = int(ends[-1])
                n_docs += len(size)
        for kind, f in files.items():
            f.close()
            filesystem.move(*names[kind])
        kernels.release()
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    written = materialise(ordered.mapInArrow(write, "shard long, n_docs long, n_tokens long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    base = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")
    written.select("shard", base.alias("base"), "n_docs", "n_tokens", F.lit(width).alias("width")).coalesce(1).write.parquet(f"{folder}/manifest.parquet")
    return folder


def _reader(filesystem, path: str, dtype: str):
    """A function (a, b) that gives entries a to b of a flat file: from a memory map, or by range."""
    from pyarrow import fs

    width = np.dtype(dtype).itemsize
    if isinstance(filesystem, fs.LocalFileSystem):
        whole = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
        return lambda a, b: whole[a:b]
    file = filesystem.open_input_file(path)
    return lambda a, b: np.frombuffer(file.read_at((b - a) * width, a * width), dtype)


#: Documents that are read together at most, and ids.
READ_DOCS, READ_IDS = 1000, 4_000_000


def read_tokens(spark: SparkSession, folder: str, tokens: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, and its ids if ``tokens``, from the files."""
    manifest = spark.read.schema("shard long, base long, n_docs long, n_tokens long, width int").parquet(f"{folder}/manifest.parquet")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = filesystem_of(folder)
        for batch in batches:
            for shard, base, n_docs, width in zip(*(batch.column(c).to_pylist() for c in ("shard", "base", "n_docs", "width")), strict=True):
                at = lambda kind, dtype: _reader(filesystem, f"{root}/{kind}-{shard:06d}.bin", dtype)  # noqa: B023, E731
                offsets, ids, names, missing = at("offsets", "<u8"), at("tokens", f"<u{width}"), at("ids", "<i8"), at("nulls", "u1")
                k = 0
                while k < n_docs:
                    bounds = np.asarray(offsets(k, min(k + READ_DOCS, n_docs) + 1)).astype(np.int64)
                    n = max(1, int(np.searchsorted(bounds, bounds[0] + READ_IDS, side="right")) - 1)
                    bounds = bounds[: n + 1]
                    flat = np.ascontiguousarray(ids(int(bounds[0]), int(bounds[-1]))).astype("<u4")
                    parts = np.split(flat, bounds[1:-1] - bounds[0])
                    columns = {
                        "doc_id": pa.array(np.array(names(k, k + n), np.int64), mask=np.array(missing(k, k + n), bool)),
                        "start": pa.array(base + bounds[:-1]),
                        "n_tokens": pa.array(np.diff(bounds)),
                        "ids_crc32": pa.array([zlib.crc32(np.ascontiguousarray(p)) for p in parts], pa.int64()),
                    }
                    if tokens:
                        columns["ids"] = pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)
                    k += n
        kernels.release()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartitionByRange(n, "shard").mapInArrow(read, schema)
