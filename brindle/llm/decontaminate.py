"""Benchmark decontamination with suffix arrays of the training shards.

Words are letters and digits after lower-casing A-Z.  A benchmark item is read
as the windows of ``width`` consecutive words (an item of fewer words is one
window).  Each run of training documents that a task holds is a shard: the
suffixes of its words, cut to ``width`` words, are sorted into a suffix array,
and every test suffix is binary-searched in it; the range of equal prefixes
gives all places of a window.  Neighbouring windows of one item on one diagonal
join to the longest verbatim matches.

A word that the benchmark lacks can be in no match, so the array leaves out
every run of benchmark words that is shorter than the shortest window; no match
is lost.  Training texts are read once and never shuffled.

The benchmark is written to the shared folder in blocks of about ``BLOCK_CHARS``,
dealt out by hash; a larger benchmark just means more blocks, each searched in turn
in the same pass.  Nothing of it passes through the driver or a broadcast.  A
worker holds one block at a time and keeps it from task to task.  Equal windows of
a block are one entry, so repeated items cost nothing in the search, and the
smaller side of window entries and shard suffixes is looked up in the larger one:
the work follows the suffixes that consist of benchmark words, not the benchmark.
The folder must be one that ``pyarrow.fs`` can reach, like that of the token files.

Cases: null and empty texts have no words and match nothing.  Repeated items
all count, each under its id; a null item_id is left out of the list of ids but
its words still hit.  Items without words match nothing.  An empty benchmark
leaves all documents clean.  Ties and repeated rows get equal results.  Texts are
read whole, however long.  A carried column may have any name; one called like a
column that the operator adds gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .shared import filesystem_of, new_path

BLOCK_CHARS = 8_000_000


class _Block:
    """Windows of some items: distinct window prefixes by length, sorted, and the items of each."""

    def __init__(self, items: list[tuple[int | None, str]], width: int) -> None:
        ids_of: dict[str, list[int]] = {}  # equal texts are one item with several ids
        for i, t in items:
            ids_of.setdefault(t, []).extend([] if i is None else [i])
        self.names = list(ids_of.values())
        column = pa.array(list(ids_of), pa.large_string())
        hashes, rows = [], []
        for first, data, offsets in kernels.slices(column):
            own, r = kernels.word_hashes(data, offsets, kernels.NOT_ALNUM)
            hashes.append(own)
            rows.append(r + first)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        row = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        ids = ids + 1  # 0 is a word that the benchmark lacks
        count = np.bincount(row, minlength=len(self.names))
        first = np.cumsum(count) - count
        #: words of a window -> distinct windows, where the occurrences of each begin, their items, their places in them
        self.groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({int(min(c, width)) for c in count if c}):
            own = np.flatnonzero(count >= width) if n == width else np.flatnonzero(count == n)
            starts = np.concatenate([first[i] + np.arange(count[i] - n + 1) for i in own])
            item = np.repeat(own, count[own] - n + 1)
            keys = _keys(ids, starts, n)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self.groups[n] = (keys[new], np.append(new, len(keys)), item[order], (starts - first[item])[order])


def _keys(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The suffixes at ``starts``, cut to n words, as byte strings that sort as the words do."""
    table = np.ascontiguousarray(ids[starts[:, None] + np.arange(n)[None, :]], ">u4")
    return table.view(f"S{4 * n}").ravel() if len(table) else np.empty(0, f"S{4 * n}")


def _expand(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin .. begin + size - 1 of each entry, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _search(block: _Block, hashes: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, word positions, numbers of the distinct windows of n words that stand there)."""
    if not len(block.vocabulary) or not len(hashes):
        return
    at = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
    ids = np.where(block.vocabulary[at] == hashes, at + 1, 0)
    known = ids > 0
    edge = np.ones(len(ids) + 1, bool)
    edge[1:-1] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
    cuts = np.flatnonzero(edge)
    left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(ids))  # words from here to the end of the run
    for n, (windows, *_) in block.groups.items():
        starts = np.flatnonzero(known & (left >= n))
        if not len(starts):
            continue
        keys = _keys(ids, starts, n)
        array = np.argsort(keys, kind="stable")  # the suffix array of the shard
        keys = keys[array]
        if len(windows) <= len(keys):
            low, high = (np.searchsorted(keys, windows, side=side) for side in ("left", "right"))
            found = np.flatnonzero(high > low)
            size = high[found] - low[found]
            places, window = array[_expand(low[found], size)], np.repeat(found, size)
        else:
            near = np.minimum(np.searchsorted(windows, keys), len(windows) - 1)
            same = windows[near] == keys
            places, window = array[same], near[same]
        if len(places):
            yield n, starts[places], window


def _write_blocks(benchmark: DataFrame) -> tuple[str, int]:
    """Write the benchmark's items in blocks; returns the folder and the number of blocks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_CHARS))
    path = new_path(benchmark.sparkSession, "benchmark")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    dealt.repartition(int(min(n, 1000)), "block").write.partitionBy("block").parquet(path)
    return path, int(n)


_held: dict[str, tuple] = {}


def _block(path: str, k: int, width: int) -> _Block:
    """Block k of the benchmark; a worker keeps the one that it used last."""
    if _held.get("name") != (path, k, width):
        _held.clear()  # so that two blocks are never held
        from pyarrow import fs
        from pyarrow import parquet

        filesystem, root = filesystem_of(path)
        found = filesystem.get_file_info(fs.FileSelector(f"{root}/block={k}", allow_not_found=True))
        tables = [parquet.ParquetFile(filesystem.open_input_file(f.path)).read(["item_id", "text"]) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet")]
        items = [x for t in tables for x in zip(*(t.column(c).to_pylist() for c in ("item_id", "text")), strict=True)]
        _held.update(name=(path, k, width), block=_Block(items, width))
    return _held["block"]


#: Columns that the operator adds.
OWN = ("n_words", "n_hit", "items", "contaminated", "matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", carry: tuple[str, ...] = ("doc_id",), matches: bool = False) -> DataFrame:
    """The carried columns of every document, n_words, n_hit, items (sorted as strings) and contaminated.

    With ``matches``, also matches: array of (item_id, item_start, doc_start,
    n_words), the longest verbatim matches in words.
    """
    path, n_blocks = _write_blocks(benchmark)
    found = "array<struct<item_id:long,item_start:long,doc_start:long,n_words:long>>"
    kept = [c for c in carry if c not in OWN]
    own = [f"c_{k}" for k in range(len(kept))]
    chosen = docs.select(*[F.col(c).alias(x) for c, x in zip(kept, own, strict=True)], *([] if text in kept else [F.col(text).alias("d_text")]))
    at_text = kept.index(text) if text in kept else len(own)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema if f.name != "d_text")
    schema = f"{fields}n_words long, n_hit long, items array<string>, contaminated boolean" + f", matches {found}" * matches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items, places = [], [], [], []
            shards = []
            for _, data, offsets in kernels.slices(batch.column(at_text)):
                hashes, row = kernels.word_hashes(data, offsets, kernels.NOT_ALNUM)
                count = np.bincount(row, minlength=len(offsets) - 1)
                hit = np.zeros(len(hashes) + 1, np.int64)
                shards.append((hashes, row, count, hit, [set() for _ in count], [[] for _ in count]))
            for k in range(n_blocks):
                block = _block(path, k, width)
                for hashes, row, count, hit, ids, spans in shards:
                    seen: dict[int, set[int]] = {}
                    for n, at, window in _search(block, hashes, row):
                        np.add.at(hit, at, 1)
                        np.add.at(hit, at + n, -1)
                        _, begins, item, place = block.groups[n]
                        # Each window once for each row, then its items.
                        rows, windows = np.unique(np.stack([row[at], window]), axis=1)
                        for r, w in zip(rows.tolist(), windows.tolist(), strict=True):
                            seen.setdefault(r, set()).update(item[begins[w] : begins[w + 1]].tolist())
                        if matches:
                            size = begins[window + 1] - begins[window]
                            here = _expand(begins[window], size)
                            _join(n, np.repeat(at, size), item[here], place[here], row, np.cumsum(count) - count, block.names, spans)
                    for r, found_items in seen.items():
                        ids[r].update(str(x) for i in found_items for x in block.names[i])
            for _, row, count, hit, ids, spans in shards:
                covered = np.cumsum(hit[:-1]) > 0
                n_words += count.tolist()
                n_hit += np.bincount(row[covered], minlength=len(count)).tolist()
                items += [sorted(x) for x in ids]
                places += spans
            columns = [*batch.columns[: len(own)], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([x > 0 for x in n_hit], pa.bool_())]
            if matches:
                columns.append(pa.array(places, pa.list_(pa.struct([(x, pa.int64()) for x in ("item_id", "item_start", "doc_start", "n_words")]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*own, *OWN[: len(columns) - len(own)]])
        kernels.release()

    out = chosen.mapInArrow(run, schema)
    return out.select(*[F.col(x).alias(c) for c, x in zip(kept, own, strict=True)], *[c for c in OWN if c in out.columns])


def _join(n: int, at: np.ndarray, item: np.ndarray, place: np.ndarray, row: np.ndarray, first: np.ndarray, names: list, spans: list[list[dict]]) -> None:
    """Windows that follow each other on one diagonal become one longest match."""
    order = np.lexsort((at, at - place, item, row[at]))
    at, item, place = at[order], item[order], place[order]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    cuts = np.append(np.flatnonzero(new), len(at))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        r = row[at[a]]
        spans[r] += [{"item_id": x, "item_start": int(place[a]), "doc_start": int(at[a] - first[r]), "n_words": int(b - a - 1 + n)} for x in names[item[a]] or [None]]


def items_digest(items: str = "items"):
    """Lowercase hex sha256 of the item ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)
