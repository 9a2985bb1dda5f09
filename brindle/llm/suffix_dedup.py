"""Removal of long repeated strings with a run-length index.

Each byte covered by a string of ``length`` bytes that also starts elsewhere in
the corpus is removed.  Texts are UTF-8 bytes; strings never cross documents.

1. Every window of ``length`` bytes picks its anchor: the least hash among its
   ``ANCHOR``-byte strings (winnowing).  Equal windows pick equal anchors, so
   only windows of one anchor can be equal.  Consecutive windows with one anchor
   occurrence form a phrase.  Anchors that occur once are done.
2. As in prefix-free parsing, the transform is built from the distinct phrases and
   the number of times that each occurs (known by a 128-bit digest).  A phrase
   that occurs n > 1 times gives rows in runs of n or more: all its windows repeat.
   For a group of one phrase that is the whole transform, and nothing is sorted.
3. The other groups are dealt out by anchor.  Each task builds the Burrows-Wheeler
   transform of its distinct phrases, compresses it to run heads and run lengths,
   keeps samples of text position and match length at run ends (irreducible LCP
   values), and streams over the text: the matching statistics toward either
   neighbour are the last sample minus the distance from it.  Windows whose
   statistics reach ``length`` repeat.
4. An anchor with more than ``hot`` distinct phrases would make one task large.
   Its windows are split by a longer shared prefix: all windows of an interval of
   places share a core, and only windows of equal cores can be equal.  Each part
   with at most ``hot`` distinct strings goes to an index as in 3; larger ones are
   split again, at last down to single windows, where a core is the window and
   equal ones collapse.  So an index decides every group at every size, and no
   task holds more than ``hot`` strings of one group.

Cases: a null text is empty; texts shorter than ``length`` have no windows.
Equal texts get equal results (results are joined by a 128-bit digest of the
text), and repeated rows repeat each other.  Null or repeated doc_ids do no harm.
An empty table gives an empty result.  A carried column may have any name; one
called like a column that the operator adds gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .shared import materialise

ANCHOR = 64
#: Distinct strings of one group that one index takes; each has at most 2 * length bytes.
HOT = 400
#: Bytes after which an index takes no further group.
INDEX_BYTES = 250_000
#: How many places the intervals of a split span, round by round.
SPANS = (128, 32, 8, 1)
#: Size of the bitmap of texts that take part in a join.
BITS = 1 << 25


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit digest of each span of bytes."""
    raw = memoryview(data.tobytes())
    out = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    both = np.frombuffer(out, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _text_key(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _digests(data, offsets[:-1], offsets[1:])


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w consecutive values, by running minima over blocks of w."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.append(x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, w)
    forward = np.minimum.accumulate(y, axis=1).ravel()
    backward = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[w - 1 : w - 1 + n])


def _phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, first window, last window, anchor's place in the phrase) of each phrase; windows are places in ``data``."""
    if len(data) < length:
        return (np.empty(0, np.int64),) * 5
    hashes = kernels.window_hashes(data, ANCHOR)
    bits = np.uint64((1 << 31) - 1)
    anchor = (_sliding_least((hashes & ~bits) | np.arange(len(hashes), dtype=np.uint64), length - ANCHOR + 1) & bits).astype(np.int64)
    good = np.zeros(len(anchor) + 2, bool)
    new = np.append(True, anchor[1:] != anchor[:-1])
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - begin >= length:
            good[begin + 1 : end - length + 2] = True
            new[begin] = True
    new &= good[1:-1]
    first = np.flatnonzero(new)
    # A phrase ends before the next one or where windows of its row end.
    last = np.flatnonzero(good[1:-1] & (np.append(new[1:], True) | ~good[2:]))
    a = anchor[first]
    return np.searchsorted(offsets, first, side="right") - 1, hashes[a].view(np.int64), first, last, a - first


def _in_pieces(data: np.ndarray, offsets: np.ndarray, length: int, piece: int = kernels.PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """The phrases; those of a long text piece by piece, so that one at the end of a piece may be two."""
    step = piece if len(offsets) == 2 else max(len(data), 1)
    for begin in range(0, len(data), step):
        part = data[begin : begin + step + length - 1]
        row, h, a, b, p = _phrases(part, offsets if step >= len(data) else np.array([0, len(part)]), length)
        if len(row):
            yield row, h, a + begin, b + begin, p


_PHRASE = "h long, f1 long, f2 long, key long, key2 long, a long, b long, p long"


def _all_phrases(docs: DataFrame, length: int) -> DataFrame:
    """Each phrase: anchor, digest, digest of its text, first and last window in the text, anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in kernels.slices(batch.column(0)):
                offsets = offsets[np.append(True, np.diff(offsets) > 0)]
                key, key2 = _text_key(data, offsets)
                for row, h, a, b, p in _in_pieces(data, offsets, length):
                    at = offsets[row]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, *_digests(data, a, b + length), key[row], key2[row], a - at, b - at, p)], names=["h", "f1", "f2", "key", "key2", "a", "b", "p"])
        kernels.release()

    return docs.select("text").mapInArrow(run, _PHRASE)


_CUT = "h long, f1 long, f2 long, key long, key2 long, a long, p long, times long, hot boolean, bytes binary"


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted phrases with their bytes, each once."""
    lists = wanted.groupBy("key", "key2").agg(F.collect_list(F.struct("h", "f1", "f2", "a", "b", "p", "times", "hot")).alias("cuts"))
    lists = materialise(lists, "cuts")
    bits = docs.sparkSession.sparkContext.broadcast(_key_bits(lists))
    keyed = _keyed(docs, (), bits)
    joined = keyed.join(lists.hint("merge"), (F.col("s_key") == F.col("key")) & (F.col("s_key2") == F.col("key2"))).select("key", "key2", "text", "cuts")
    names = [x.split()[0] for x in _CUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            data, bounds = (np.frombuffer(texts.buffers()[k], t) if texts.buffers()[k] is not None else np.empty(0, t) for k, t in ((2, np.uint8), (1, np.int64)))
            lists = batch.column(3)
            cuts = lists.flatten()
            if not len(cuts):
                continue
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            field = {k: cuts.field(i) for i, k in enumerate(("h", "f1", "f2", "a", "b", "p", "times", "hot"))}
            begin = bounds[texts.offset + row] + field["a"].to_numpy()
            end = bounds[texts.offset + row] + field["b"].to_numpy() + length
            for k in range(0, len(row), 5000):
                here = slice(k, k + 5000)
                size = end[here] - begin[here]
                ends = np.cumsum(size)
                flat = data[np.repeat(begin[here] - (ends - size), size) + np.arange(int(ends[-1]))]
                part = {c: field[c].slice(k, 5000) for c in ("h", "f1", "f2", "a", "p", "times", "hot")}
                part["bytes"] = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(flat)])
                part |= {"key": batch.column(0).take(pa.array(row[here])), "key2": batch.column(1).take(pa.array(row[here]))}
                yield pa.RecordBatch.from_arrays([part[c] for c in names], names=names)
        kernels.release()

    return joined.mapInArrow(run, _CUT).dropDuplicates(["h", "f1", "f2"])


def _key_bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (4 MB) in which the places of all keys are set; others rarely are."""
    place = F.pmod(F.col("key"), F.lit(BITS))
    words = keys.select(F.floor(place / 64).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(key, {BITS}) % 64 AS int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    out = np.zeros(BITS // 64, np.int64)
    for batch in words.toArrow().to_batches():  # at most BITS / 64 rows
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint64)


def _keyed(docs: DataFrame, carry: tuple[str, ...], bits, inside: bool = True) -> DataFrame:
    """Carried columns, text and the text's key, of documents whose key is marked in the bitmap (or isn't)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            both = [_text_key(data, offsets) for _, data, offsets in kernels.slices(column)]
            keys, more = (np.concatenate([x[k] for x in both]) if both else np.empty(0, np.int64) for k in (0, 1))
            place = keys % BITS
            marked = pa.array(((bits.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool) == inside)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys), pa.array(more)], names=[*batch.schema.names, "s_key", "s_key2"]).filter(marked)
        kernels.release()

    chosen = docs.select(*carry, F.col("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema]
    return chosen.mapInArrow(run, ", ".join([*fields, "s_key long, s_key2 long"]))


def _order(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in order of (key, place), and whether each key differs from the one before; keys have ``width`` bits."""
    bits = len(key).bit_length()
    if width + bits <= 63:  # one sort of plain integers, much faster than a sort of places
        value = np.sort(key << bits | np.arange(len(key)))
        order, value = value & ((1 << bits) - 1), value >> bits
    else:
        order = np.argsort(key, kind="stable")
        value = key[order]
    return order, np.append(True, value[1:] != value[:-1])


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of several strings, with samples at run ends.

    Each string ends with a separator of its own; separators sort by the number of
    their string, before all bytes.  ``times`` says how often each string occurs:
    the transform of all occurrences has the same run heads, and each row stands
    as often as its string does.  What stays after building is the runs, the
    samples and the places of the separators.
    """

    def __init__(self, parts: list[bytes], times: np.ndarray | None = None) -> None:
        n_parts = len(parts)
        size = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(size + 1) - 1  # places of the separators
        n = self.n = int(size.sum()) + n_parts
        inside = np.ones(n, bool)
        inside[self.ends] = False
        symbols = np.zeros(n + 3, np.int16)
        symbols[:n][inside] = np.frombuffer(b"".join(parts), np.uint8)
        symbols[:n][inside] += 1
        left = np.repeat(self.ends, size + 1) - np.arange(n)  # bytes up to the separator
        # Suffixes by their first 4 symbols, then 8, 16 and so on; what lies behind a separator counts as nothing.
        step, bits = 4, n.bit_length()
        key = symbols[:n].astype(np.int64)
        for k in range(1, step):
            key = key << 9 | symbols[k : n + k]
        near = np.flatnonzero(left < step)
        behind = 9 * (step - left[near])
        key[near] = key[near] >> behind << behind
        order, new = _order(key, 9 * step)
        new[:n_parts] = True  # separators come first, and differ
        levels: list[np.ndarray] = []
        kinds = 0
        while True:
            found = int(new.sum())
            if found in (n, kinds):  # nothing is left to part: what ties is equal to its end
                break
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new, dtype=np.int32)
            levels.append(rank)
            kinds = found
            key = rank.astype(np.int64) << bits
            if step < n:
                key[:-step] |= np.where(left[:-step] > step, rank[step:], 0)
            order, new = _order(key, 2 * bits)
            step *= 2
        owner = np.cumsum(~inside) - ~inside
        before = np.where(order == 0, -1, symbols[order - 1].astype(np.int64))  # the transform: what stands before each suffix
        starts = before == 0
        before[starts] = -2 - owner[order[starts]]  # separators differ
        weight = np.ones(n_parts, np.int64) if times is None else np.asarray(times, np.int64)
        cut = np.append(True, before[1:] != before[:-1])
        self.run_heads = before[cut]
        rows = np.add.reduceat(np.ones(n, np.int64), np.flatnonzero(cut))
        self.run_lengths = np.add.reduceat(weight[owner[order]], np.flatnonzero(cut))
        # Two neighbours of different runs: their places and match length are the samples at both ends.
        ends = np.cumsum(rows)[:-1]
        low, high = order[ends - 1], order[ends]
        match = np.zeros(len(ends), np.int64)
        x, y = low.copy(), high.copy()
        for k in range(len(levels) - 1, -1, -1):
            same = np.flatnonzero((x < n) & (y < n))
            same = same[levels[k][x[same]] == levels[k][y[same]]]
            match[same] += 4 << k
            x[same] += 4 << k
            y[same] += 4 << k
        # The last symbols, fewer than a level has.
        for _ in range(3):
            same = np.flatnonzero((x < n) & (y < n))
            same = same[(symbols[x[same]] == symbols[y[same]]) & (symbols[x[same]] > 0)]
            match[same] += 1
            x[same] += 1
            y[same] += 1
        if found < n and levels:  # what ties in the last level is equal to its end
            match[levels[-1][low] == levels[-1][high]] = n
        match = np.minimum(match, np.minimum(left[low], left[high]))
        self.samples = [(high, match), (low, match)]
        self.edge = order[0], order[-1]
        # Where a string occurs more than once, each of its rows has an equal neighbour up to the separator.
        self.repeated = weight > 1

    def statistics(self) -> np.ndarray:
        """For each text position the longest match that starts elsewhere, streamed from the samples at run ends."""
        best = np.zeros(self.n, np.int64)
        for (at, match), edge in zip(self.samples, self.edge, strict=True):
            value, last = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
            value[at] = match
            value[edge] = 0
            last[at] = at
            last[edge] = edge
            last = np.maximum.accumulate(last)
            best = np.maximum(best, value[last] - (np.arange(self.n) - last))
        begins = np.append(0, self.ends[:-1] + 1)
        for k in np.flatnonzero(self.repeated).tolist():
            best[begins[k] : self.ends[k] + 1] = self.ends[k] - np.arange(begins[k], self.ends[k] + 1)
        return best


def _indexed(rows: DataFrame, length: int) -> DataFrame:
    """(key, key2, a, e): byte ranges that repeat in strings of bounded groups; rows: (g, key, key2, a, times, bytes), a group's rows of one g."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def search(parts: list[bytes], origin: list[np.ndarray]) -> pa.RecordBatch:
        key, key2, a, times = (np.concatenate([x[k] for x in origin]) for k in range(4))
        index = RunLengthIndex(parts, times)
        begins = np.append(0, index.ends[:-1] + 1)
        hit = index.statistics() >= length
        hit[np.append(index.ends, -1)] = False
        for k in np.flatnonzero(times > 1).tolist():  # known to repeat with all their occurrences
            hit[begins[k] : index.ends[k]] = False
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        x, y = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(begins, x, side="right") - 1
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (key[of], key2[of], a[of] + x - begins[of], a[of] + y - begins[of] - 1 + length)], names=["key", "key2", "a", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        origin: list[np.ndarray] = []
        size, at = 0, None
        for batch in batches:
            g = batch.column(0).to_numpy()
            if not len(g):
                continue
            columns = [batch.column(k).to_numpy() for k in range(1, 5)]
            raw = batch.column(5).to_pylist()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if g[x] != at and size >= INDEX_BYTES:
                    yield search(parts, origin)
                    parts, origin, size = [], [], 0
                at = g[x]
                parts += raw[x:y]
                origin.append([c[x:y] for c in columns])
                size += sum(map(len, raw[x:y]))
        if parts:
            yield search(parts, origin)
        kernels.release()

    dealt = rows.select("g", "key", "key2", "a", "times", "bytes").repartition(n, "g").sortWithinPartitions("g", "key", "key2", "a")
    return dealt.mapInArrow(run, "key long, key2 long, a long, e long")


def _parts(rows: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Ranges of the strings in large groups: those told by equal strings, and those that an index finds in parts of at most ``hot`` strings.

    rows: (h, key, key2, a, p, times, bytes).  A window is known by its reach x
    before the anchor, which stands at place p of the bytes.  All windows with x
    from lo to hi share the bytes from p - lo to p - hi + length, their core.  The
    bytes are cut to the windows of the interval; equal ones collapse.
    """
    most = length - ANCHOR
    told = indexed = None
    todo = rows.select("h", "key", "key2", "a", "p", "times", "bytes", F.lit(0).cast("long").alias("lo"))
    wide = most + 1
    for size in SPANS:
        inner = F.expr(f"sequence(lo, least(lo + {wide - 1}L, {most}L), {size}L)")
        cut = todo.withColumn("lo", F.explode(inner)).withColumn("hi", F.least(F.col("lo") + size - 1, F.lit(most)))
        cut = cut.withColumn("first", F.greatest(F.col("lo"), F.col("p") - (F.length("bytes") - length))).withColumn("last", F.least("hi", "p")).filter("first <= last")
        take = lambda a, b: F.substring("bytes", (F.col("p") - a + 1).cast("int"), (a - b + length).cast("int"))
        cut = cut.withColumn("core", take(F.col("lo"), F.col("hi"))).withColumn("hull", take(F.col("last"), F.col("first")))
        cut = cut.select(
            "h", "lo", F.unhex(F.substring(F.sha2("core", 256), 1, 32)).alias("c"), F.unhex(F.substring(F.sha2("hull", 256), 1, 32)).alias("u"), "first", "key", "key2",
            (F.col("a") + F.col("p") - F.col("last")).alias("a"), F.col("last").alias("p"), "times", F.col("hull").alias("bytes"),
        )
        cut = materialise(cut, "cut_parts")
        same = ["h", "lo", "first", "p", "u"]
        kinds = cut.groupBy(*same).agg(F.sum("times").alias("times"), F.min(F.struct("key", "key2", "a", "c", "bytes")).alias("one"))
        kinds = materialise(kinds.select(*same, "times", "one.*"), "kinds")
        repeated = kinds.filter("times > 1").select(*same).join(cut.filter("times = 1"), same).select("key", "key2", "a", (F.col("a") + F.length("bytes")).alias("e"))
        told = repeated if told is None else told.unionByName(repeated)
        if size == 1:
            break
        group = kinds.groupBy("h", "lo", "c").agg(F.count("*").alias("m"), F.min("times").alias("least")).filter("m > 1 AND least = 1")
        group = materialise(group.select("h", "lo", "c", (F.col("m") > hot).alias("large")), "parts")
        live = materialise(kinds.join(group, ["h", "lo", "c"]), "live")
        small = live.filter("NOT large").withColumn("g", F.xxhash64("h", "lo", "c"))
        found = _indexed(small, length)
        indexed = found if indexed is None else indexed.unionByName(found)
        todo, wide = live.filter("large").select(*todo.columns), size
        if not todo.limit(1).count():
            break
    return told, indexed


def repeated_ranges(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """(key, key2, a, e): ranges of bytes that repeated strings cover, by digest of the text; ranges may overlap."""
    phrases = materialise(_all_phrases(docs, length), "phrases")
    # Sides that are sums are written first: adaptive execution splits a hot key only in a join of plain reads.
    often = materialise(phrases.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "often")
    again = materialise(phrases.join(often, "h"), "again")
    same = ["h", "f1", "f2"]
    kinds = materialise(again.groupBy(*same).agg(F.count("*").alias("times"), F.min(F.struct("key", "key2", "a", "b", "p")).alias("one")), "kinds")
    repeated = materialise(kinds.filter("times > 1").select(*same), "repeated")
    whole = again.join(repeated, same).groupBy("key", "key2", "a").agg((F.max("b") + length).alias("e"))
    groups = kinds.groupBy("h").agg(F.count("*").alias("m"), F.min("times").alias("least")).filter("m > 1 AND least = 1")
    groups = materialise(groups.select("h", (F.col("m") > hot).alias("hot")), "groups")
    wanted = kinds.join(groups, "h").select(*same, "one.*", "times", "hot")
    cut = materialise(_cut(docs, materialise(wanted, "wanted"), length), "cut")
    ranges = [whole, _indexed(cut.filter(~F.col("hot")).withColumn("g", F.col("h")), length)]
    many = cut.filter("hot")
    if many.limit(1).count():
        ranges += [x for x in _parts(many, length, hot) if x is not None]
    out = ranges[0].select("key", "key2", "a", "e")
    for r in ranges[1:]:
        out = out.unionByName(r)
    return materialise(out, "ranges")


#: Columns that the operator adds.
OWN = ("n_bytes", "n_removed", "n_spans", "kept", "spans", "kept_sha256")


def remove_repeats(docs: DataFrame, length: int = 400, carry: tuple[str, ...] = ("doc_id",), hot: int = HOT) -> DataFrame:
    """The carried columns, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans (removed runs) and kept_sha256."""
    names = [c for c in carry if c not in OWN]
    own = [f"c_{k}" for k in range(len(names))]  # carried columns may be called like columns used here
    docs = docs.select(*[F.col(c).alias(x) for c, x in zip(names, own, strict=True)], "text")
    ranges = repeated_ranges(docs, length, hot)
    lists = ranges.groupBy("key", "key2", "a").agg(F.max("e").alias("e")).groupBy("key", "key2").agg(F.sort_array(F.collect_list(F.struct("a", "e"))).alias("ranges"))
    lists = materialise(lists, "lists")  # many equal texts make a hot key, which a join of plain reads can split
    bits = docs.sparkSession.sparkContext.broadcast(_key_bits(lists))
    # Only texts that may have ranges are shuffled to them.
    found = (F.col("s_key") == F.col("key")) & (F.col("s_key2") == F.col("key2"))
    joined = _keyed(docs, tuple(own), bits).join(lists.hint("merge"), found, "left").select(*own, "text", "ranges")
    clean = _keyed(docs, tuple(own), bits, False).select(*own, "text", F.lit(None).cast("array<struct<a:long,e:long>>").alias("ranges"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*own).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in OWN}
            for text, found in zip(batch.column(len(own)), batch.column(len(own) + 1), strict=True):
                raw = (text.as_py() or "").encode()
                spans: list[list[int]] = []
                for r in found.as_py() or ():
                    if spans and r["a"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["e"])
                    else:
                        spans.append([r["a"], r["e"]])
                begins = [0, *(e for _, e in spans)]
                kept = b"".join(raw[x:y] for x, y in zip(begins, [*(a for a, _ in spans), len(raw)], strict=True))
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(len(spans))
                out["kept"].append(kept)
                out["spans"].append([{"a": a, "e": e} for a, e in spans])
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            types = {"kept": pa.binary(), "spans": pa.list_(pa.struct([("a", pa.int64()), ("e", pa.int64())])), "kept_sha256": pa.string()}
            arrays = [pa.array(v, types.get(k, pa.int64())) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *arrays], names=[*own, *out])
        kernels.release()

    schema = f"{fields}n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<a:long,e:long>>, kept_sha256 string"
    out = joined.mapInArrow(run, schema).unionByName(clean.mapInArrow(run, schema))
    return out.select(*[F.col(x).alias(c) for c, x in zip(names, own, strict=True)], *OWN)
