"""N-gram Jaccard join: groups of documents whose word n-gram sets overlap.

Two documents link when their sets of ``k``-word shingles have a Jaccard
similarity of at least ``percent`` / 100.  The result has each document's set
size and the smallest doc_id that links reach.  Sets are compared by the 64-bit
hashes of their n-grams; apart from chance collisions of these it is exact.

1. Equal sets collapse to one class under a 128-bit digest of the set.
2. Only few n-grams of a document are indexed.  With an order over all n-grams
   that every document shares, two documents that link have at least m common
   n-grams among the first n - ceil(t n) + m of each (a bound from the sizes);
   m is ceil(n / 20) for the smaller one.  The order puts n-grams that many documents share last
   (``heavy``; any choice of them keeps the result, a good one makes lists
   short), else it follows their hash.  A document that shares fewer of its
   indexed n-grams than the smallest possible partner asks for links with none and is done.
3. The documents of an n-gram share a pivot, the smallest class among them: a
   partial minimum, so a frequent n-gram is no hot group.  Of the common n-grams
   of two documents that link, one pivot has at least the m-th part divided by
   the number of a document's pivots, so a document stays in the block of a
   pivot only if it has that many n-grams there.  The documents of one pivot form
   a block of the incidence matrix; all links are found in such blocks.
4. A block of the matrix is multiplied with its transpose in slices of n-gram
   columns.  Overlap counts accumulate; after each slice, pairs that cannot
   reach the overlap that their sizes ask for are discarded.  Of the links, a
   spanning forest leaves the task, so copies are never expanded into pairs.
5. A pivot with many documents is cut into tiles of ``TILE`` documents.  First
   each tile is multiplied with itself and the pivot.  Then one document of each
   component found so far stands for it: these are tiled and multiplied again, with
   that of the largest component in each tile, which joins most copies whose pivot
   is no copy of theirs.  Then only documents
   outside the largest component of the pivot are left to compare with all its
   documents: pairs of one component need no more looking at.  For that the sets of
   the block are written once, tile by tile, to the shared folder; tasks get the
   places of pairs of tiles and read them there, so texts are not sent to each pair.

Cases: a null or empty text has an empty set and links with nothing; fewer than
k words are one shingle.  Rows with equal doc_id count as one document, which links
by the set of any of its rows.  A null
doc_id cannot be named: such a row is in no group and its component_id is null.
An empty table gives an empty result.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels
from .components import components
from .shared import filesystem_of, materialise, new_path, small, token

#: Documents of one tile of a large block.
TILE = 64
#: A tile that is written once holds so many times as many documents, or about so many bytes of sets.
WIDE, STORED_BYTES = 4, 8_000_000
#: A stored tile is compared with so many others in a run.
RUN = 16
#: A list of wanted ids, eight bytes each, may be broadcast up to this length.
WANTED = 1_000_000
#: How often representatives of a large block's components are compared before all that is left is.
ROUNDS = 2
#: Shingles that a task counts together when it looks for frequent ones.
COUNTED = 2_000_000
#: At most this many frequent n-grams are put last in the order.
HEAVY = 200_000


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, hash) of the shingle sets of runs of texts."""
    for first, data, offsets in kernels.slices(column):
        rows, value = kernels.shingles(*kernels.word_hashes(data, offsets, kernels.SPACE), len(offsets) - 1, k)
        yield first, len(offsets) - 1, rows, value


def _least(n):
    """How many indexed n-grams are shared with each document that links and has at least as many n-grams."""
    return -(-n // 20)


def _heavy(docs: DataFrame, k: int, least: int = 32) -> np.ndarray:
    """Hashes of n-grams that many documents have: local counts, summed; at most HEAVY."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = n_docs = 0

        def flush() -> pa.RecordBatch:
            value = np.sort(np.concatenate(held))
            cut = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            times = np.diff(np.append(cut, len(value)))
            often = times >= max(3, n_docs // 1000)
            return pa.RecordBatch.from_pydict({"h": pa.array(value[cut[often]].view(np.int64)), "n": pa.array(times[often])})

        for batch in batches:
            for _, rows, _, value in _sets(batch.column(0), k):
                held.append(value)
                size += len(value)
                n_docs += rows
                if size >= COUNTED:
                    yield flush()
                    held, size, n_docs = [], 0, 0
        if size:
            yield flush()
        held.clear()
        kernels.release()

    counts = materialise(docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "heavy")
    by_size = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).cast("int")).count().collect()}  # a row per power of two
    level, total = max(by_size, default=0) + 1, 0
    while level - 1 in by_size and total + by_size[level - 1] <= HEAVY:
        level -= 1
        total += by_size[level]
    found = counts.filter(F.floor(F.log2("n")) >= level).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def _documents(docs: DataFrame, k: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, indexed): set size, digest and indexed n-grams of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for batch in batches:
            ids = batch.column(0)
            for first, rows, row, value in _sets(batch.column(1), k):
                n = np.bincount(row, minlength=rows)
                bounds = np.append(0, np.cumsum(n))
                last = np.zeros(len(value), bool)
                if len(often) and len(value):
                    at = np.minimum(np.searchsorted(often, value), len(often) - 1)
                    last = often[at] == value
                total = lambda x: np.diff(np.append(np.uint64(0), np.cumsum(x))[bounds])  # noqa: B023, E731
                sums = [total(kernels.mix(value + np.uint64(c))) for c in (1, 2)]
                order = np.lexsort((last, row)) if last.any() else slice(None)  # stable: by hash within each part
                value = value[order]
                keep = np.arange(len(value)) - np.repeat(bounds[:-1], n) <= np.repeat(n - -(-percent * n // 100) + _least(n) - 1, n)
                kept = np.bincount(row[keep], minlength=rows)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)).astype(np.int32)), pa.array(value[keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, rows), pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), lists], names=["doc_id", "n_shingles", "s1", "s2", "indexed"])
        kernels.release()

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n_shingles long, s1 long, s2 long, indexed array<long>")


class _Forest:
    """Union-find over local numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _product(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right) of sets that link, by the product of two row blocks of the incidence matrix."""
    size = np.array([len(s) for s in sets], np.int64)
    # With overlap o a pair's union is a + b - o, so 100 o >= p (a + b - o) asks for o >= p (a + b) / (100 + p).
    need = -(-percent * (size[left][:, None] + size[right][None, :]) // (100 + percent))
    open_ = need <= np.minimum(size[left][:, None], size[right][None, :])
    if not open_.any():
        return left[:0], right[:0]
    rows, cols = left[open_.any(1)], right[open_.any(0)]
    need, open_ = need[open_.any(1)][:, open_.any(0)], open_[open_.any(1)][:, open_.any(0)]
    used = np.unique(np.concatenate([rows, cols]))
    value = np.concatenate([sets[i] for i in used])
    owner = np.repeat(used, size[used])
    words, column, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times > 1  # an n-gram of one document adds to no pair
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    count = np.zeros(need.shape, np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[rows], place_r[cols] = np.arange(len(rows)), np.arange(len(cols))
    rest = np.bincount(owner, minlength=len(sets))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(shared.sum()), columns):
        here = slice(*np.searchsorted(column, (low, low + columns)))
        o, c = owner[here], column[here] - low
        a, b = np.zeros((len(rows), columns), np.float32), np.zeros((len(cols), columns), np.float32)
        inside = place_l[o] >= 0
        a[place_l[o[inside]], c[inside]] = 1
        inside = place_r[o] >= 0
        b[place_r[o[inside]], c[inside]] = 1
        count += a @ b.T
        rest -= np.bincount(o, minlength=len(sets))
        open_ &= count + np.minimum(rest[rows][:, None], rest[cols][None, :]) >= need
        if not open_.any():
            return left[:0], right[:0]
    i, j = np.nonzero(open_ & (count >= need))
    return rows[i], cols[j]


def _links(ids: list[int], sets: list[np.ndarray], side: np.ndarray | None, percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among documents, or between the two sides; without links inside known components."""
    edges, forest = [], _Forest(len(ids))
    first = {}
    for x, d in enumerate(known or ids):  # rows of one document
        if forest.join(first.setdefault(d, x), x):
            pass
    left, right = (np.arange(len(ids)),) * 2 if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for a in range(0, len(left), 256):
        for b in range(0, len(right), 256):
            if side is None and b < a:
                continue
            for x, y in zip(*(v.tolist() for v in _product(sets, left[a : a + 256], right[b : b + 256], percent)), strict=True):
                if x != y and forest.join(x, y):
                    edges.append((ids[x], ids[y]))
    return edges


def _multiply(parts: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) found in each part; parts: (part, side, doc_id, text), a part's rows together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets, sides = None, [], [], []

        def result() -> Iterator[pa.RecordBatch]:
            side = np.array(sides)
            edges = _links(ids, sets, side if side.any() else None, percent)
            if edges:
                yield pa.RecordBatch.from_pydict({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

        for batch in batches:
            found: list[np.ndarray] = []
            for _, rows, row, value in _sets(batch.column(3), k):
                found += np.split(value, np.cumsum(np.bincount(row, minlength=rows))[:-1])
            for x, (part, side, doc) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if part != at:
                    if len(ids) > 1:
                        yield from result()
                    at, ids, sets, sides = part, [], [], []
                ids.append(doc)
                sets.append(found[x])
                sides.append(side)
        if len(ids) > 1:
            yield from result()
        kernels.release()

    return parts.select("part", "side", "doc_id", "text").mapInArrow(run, "a long, b long")


def _placed(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of (part, any other column, doc_id), each part in one task, the parts dealt out evenly.

    A part is a task's unit of work; parts are numbered by their place, so that
    numbers, not hashes, deal them out.
    """
    texts = docs.select(F.col("doc_id").alias("t_id"), "text")
    # A document may have many rows: first the texts of all others go, by a list of ids alone, where that is small.
    ids = materialise(rows.select(F.col("doc_id").alias("w_id")).distinct(), "wanted")
    texts = texts.join(small(ids, WANTED), F.col("t_id") == F.col("w_id"), "left_semi")
    joined = texts.join(small(rows), F.col("t_id") == F.col("doc_id"))
    return _dealt(joined.select(*rows.columns, "text")).sortWithinPartitions(*rows.columns)


def _dealt(df: DataFrame) -> DataFrame:
    """Rows of a part to one partition, by the part's number."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionById(n, F.pmod("part", F.lit(n)).cast("int"))


def _numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number the distinct keys so that the numbers modulo the partitions deal them evenly; no single task sees all keys."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = df.select(*keys).distinct().withColumn("p", F.pmod(F.xxhash64(*keys), F.lit(n)))
    spread = materialise(spread.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy(*keys))), "numbers")
    return spread.select(*keys, (F.col("i").cast("long") * n + F.pmod(F.col("p") + F.col("i"), F.lit(n))).alias("part"))


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = materialise(_documents(docs, k, percent, _heavy(docs, k)), "sets")
    named = every.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialise(named.groupBy("s1", "s2").agg(F.min("doc_id").alias("class"), F.count("*").alias("n")), "classes")

    posted = named.select("doc_id", F.explode("indexed").alias("h"))
    pivots = posted.groupBy("h").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("most")).filter("pivot <> most").select("h")
    pivots = materialise(pivots, "pivots")  # sums are written before they meet hot n-grams, so that skewed joins can split
    shared = materialise(posted.join(pivots, "h"), "shared")
    of_ids = named.select("doc_id", "s1", "s2").join(classes.select("s1", "s2", "class"), ["s1", "s2"]).select("doc_id", "class").distinct()
    of_ids = materialise(of_ids.filter("doc_id <> class"), "copies")
    # Rows that repeat an id can be a copy and stand for another class; such an id stays in the search, so each class does.
    standing = classes.select(F.col("class").alias("doc_id")).distinct()
    gone = materialise(of_ids.select("doc_id").distinct().join(standing, "doc_id", "left_anti"), "gone")
    single = shared.join(small(gone), "doc_id", "left_anti")
    sizes = named.groupBy("doc_id").agg(F.min("n_shingles").alias("least"))
    # Copies are left out, so an n-gram may now have one document; such n-grams count for nothing.
    twice = single.groupBy("h").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("most")).filter("pivot <> most").select("h", "pivot")
    twice = materialise(twice, "twice")
    counted = single.join(twice, "h").groupBy("doc_id", "pivot").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("doc_id")
    counted = counted.withColumn("all", F.sum("c").over(whole)).withColumn("pivots", F.count("*").over(whole)).join(sizes, "doc_id")
    # A partner has at least percent / 100 of a document's n-grams, and a part of those in common.
    need = F.ceil(F.ceil(F.col("least") * percent / 100) / 20)
    members = counted.filter((F.col("all") >= need) & (F.col("c") * F.col("pivots") >= need)).select("doc_id", "pivot")
    members = materialise(members, "members")

    groups = materialise(members.groupBy("pivot").agg(F.count("*").alias("n")).filter("n > 1"), "groups")
    members = materialise(members.join(small(groups), "pivot").select("pivot", "doc_id", "n"), "blocks")
    edges = materialise(_within(docs, members, k, percent, tile), "edges1")
    repeats = of_ids.select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    edges = edges.union(repeats)
    large = members.filter(F.col("n") > tile)
    if large.limit(1).count():
        for _ in range(ROUNDS):
            more = _representatives(docs, large, components(edges), k, percent, tile)
            if more is None:
                break
            edges = materialise(edges.union(more), "edges_of_representatives")
        labels = components(edges)
        edges = materialise(edges.union(_across(docs, large, labels, k, percent, tile)), "edges2")
    labels = components(edges)
    out = every.join(labels.withColumnRenamed("node", "l_id"), F.col("doc_id") == F.col("l_id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _within(docs: DataFrame, members: DataFrame, k: int, percent: int, tile: int, hub: str = "pivot") -> DataFrame:
    """Edges inside each block, or inside each tile of a large block (with the block's pivot, or another hub, in each tile)."""
    tiles = F.ceil(F.col("n") / tile)
    salt = F.pmod(F.xxhash64("doc_id", "pivot"), tiles).cast("int")
    rows = members.select("pivot", salt.alias("tile"), "doc_id", F.col(hub).alias("hub")).filter("doc_id <> hub")
    rows = rows.select("pivot", "tile", "doc_id").union(rows.select("pivot", "tile", "hub").distinct())
    numbers = _numbered(rows, ["pivot", "tile"])
    placed = materialise(rows.join(numbers, ["pivot", "tile"]).select("part", F.lit(0).alias("side"), "doc_id"), "tiles")
    return _multiply(_placed(docs, placed), k, percent)


def _representatives(docs: DataFrame, large: DataFrame, labels: DataFrame, k: int, percent: int, tile: int) -> DataFrame | None:
    """Edges between one document of each component of a large block, tile by tile, with that of the largest in each tile."""
    labelled = large.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("pivot", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    one = materialise(labelled.groupBy("pivot", "c").agg(F.count("*").alias("size"), F.min("doc_id").alias("doc_id")), "representatives")
    blocks = one.groupBy("pivot").agg(F.count("*").alias("n"), F.max(F.struct("size", "doc_id"))["doc_id"].alias("hub")).filter("n > 1")
    blocks = materialise(blocks, "blocks_of_representatives")
    if not blocks.limit(1).count():
        return None
    return _within(docs, one.join(small(blocks), "pivot").select("pivot", "doc_id", "n", "hub"), k, percent, tile, "hub")


def _across(docs: DataFrame, large: DataFrame, labels: DataFrame, k: int, percent: int, tile: int) -> DataFrame:
    """Edges between documents of one large block in different components."""
    labelled = large.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("pivot", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    labelled = materialise(labelled, "labelled")
    counts = labelled.groupBy("pivot", "c").agg(F.count("*").alias("n"))
    largest = counts.groupBy("pivot").agg(F.max(F.struct("n", "c")).alias("x"), F.sum("n").alias("all")).select("pivot", F.col("x.c").alias("main"), F.col("all"), (F.col("all") - F.col("x.n")).alias("minor"))
    largest = materialise(largest.filter("minor > 0"), "largest")
    both = labelled.join(small(largest), "pivot")
    wide = WIDE * tile
    many = lambda n: F.ceil(n / wide).cast("int")
    minors, mains = many(F.col("minor")), many(F.col("all") - F.col("minor"))
    salt = F.xxhash64("doc_id", "pivot")
    # Tiles outside the largest component have the lower numbers.
    rows = both.select("pivot", F.when(F.col("c") != F.col("main"), F.pmod(salt, minors)).otherwise(minors + F.pmod(salt, mains)).cast("int").alias("tile"), "c", "doc_id")
    numbers = _numbered(rows, ["pivot", "tile"])
    placed = materialise(rows.join(numbers, ["pivot", "tile"]).select("part", "c", "doc_id"), "wide_tiles")
    folder = new_path(docs.sparkSession, "tile_sets")
    stored = materialise(_stored(_placed(docs, placed), folder, k), "stored")
    places = materialise(stored.join(small(numbers), "part").select("pivot", "tile", "piece", F.struct("file", "at", "size").alias("place")), "places")
    left = places.join(small(largest), "pivot").filter(F.col("tile") < minors)
    left = left.select("pivot", F.col("tile").alias("x"), F.col("piece").alias("x_piece"), F.col("place").alias("x_place"), F.explode(F.sequence("tile", minors + mains - 1)).alias("tile"))
    pairs = left.join(small(places), ["pivot", "tile"]).filter((F.col("x") < F.col("tile")) | (F.col("x_piece") <= F.col("piece")))
    pairs = materialise(pairs.select("pivot", "x", F.floor(F.col("tile") / RUN).alias("run"), F.col("x_place").alias("left"), F.col("place").alias("right")), "tile_pairs")
    runs = _numbered(pairs, ["pivot", "x", "run"])
    return _compare(pairs.join(runs, ["pivot", "x", "run"]).select("part", "left", "right"), folder, percent)


def _stored(parts: DataFrame, folder: str, k: int) -> DataFrame:
    """Write the n-gram sets of each part once, in pieces; where each is.  parts: (part, c, doc_id, text), a part's rows together.

    A piece is 64-bit numbers: how many documents, their ids, known components and set
    sizes, then the sets.  A task's file has a name of its own, so one that runs twice
    does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = filesystem_of(folder)
        name, file = token(), None
        at = piece = end = held = 0
        rows: list[tuple[int, int]] = []
        sets: list[np.ndarray] = []

        def write() -> pa.RecordBatch:
            nonlocal file, piece, end, held, rows, sets
            if file is None:
                filesystem.create_dir(root, recursive=True)
                file = filesystem.open_output_stream(f"{root}/{name}")
            raw = np.concatenate([[len(rows)], *np.array(rows, np.int64).T, [len(s) for s in sets], *(s.view(np.int64) for s in sets)]).astype("<i8").tobytes()
            file.write(raw)
            place = pa.RecordBatch.from_pydict({"part": [at], "piece": pa.array([piece], pa.int32()), "file": [name], "at": [end], "size": [len(raw)]})
            piece, end, held, rows, sets = piece + 1, end + len(raw), 0, [], []
            return place

        for batch in batches:
            found: list[np.ndarray] = []
            for _, n, row, value in _sets(batch.column(3), k):
                found += np.split(value, np.cumsum(np.bincount(row, minlength=n))[:-1])
            for x, (part, c, doc) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if rows and (part != at or held >= STORED_BYTES):
                    yield write()
                if part != at:
                    at, piece = part, 0
                rows.append((doc, c))
                sets.append(found[x])
                held += found[x].nbytes
        if rows:
            yield write()
        if file is not None:
            file.close()
        kernels.release()

    return parts.select("part", "c", "doc_id", "text").mapInArrow(run, "part long, piece int, file string, at long, size long")


def _compare(pairs: DataFrame, folder: str, percent: int) -> DataFrame:
    """Edges (a, b) between known components in pairs of stored pieces; pairs: (part, left, right)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = filesystem_of(folder)

        def read(place: dict) -> tuple[list[int], list[int], list[np.ndarray]]:
            with filesystem.open_input_file(f"{root}/{place['file']}") as file:
                raw = np.frombuffer(file.read_at(place["size"], place["at"]), "<i8")
            n = int(raw[0])
            ids, known, sizes = raw[1 : 3 * n + 1].reshape(3, n)
            return ids.tolist(), known.tolist(), np.split(raw[3 * n + 1 :].view(np.uint64), np.cumsum(sizes)[:-1])

        at = None
        for batch in batches:
            for left, right in zip(*(batch.column(c).to_pylist() for c in (1, 2)), strict=True):
                if left != at:
                    at, held = left, read(left)
                ids, known, sets = held
                side = None
                if left != right:
                    ids, known, sets = (x + y for x, y in zip(held, read(right), strict=True))
                    side = np.repeat([0, 1], [len(held[0]), len(ids) - len(held[0])])
                edges = _links(ids, sets, side, percent, known)
                if edges:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})
        kernels.release()

    return _dealt(pairs.select("part", "left", "right")).sortWithinPartitions("part", "left", "right").mapInArrow(run, "a long, b long")
