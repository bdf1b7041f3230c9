"""Exact Jaccard join of documents as a metric-space join.

Jaccard distance is a metric, so distances to pivots tell what can be close: documents within eps
of each other differ by at most eps in their distance to any pivot. The join works in rounds over
regions that are stored between rounds.

1. Regions. Almost all texts lie at distance nearly 1 from almost all others, where no window excludes
   anything, so a filter goes first: shingles are hashed into K slices. Two sets within the
   distance differ in at most D shingles, so with K > D one slice at least is the same in both. Sets of like size
   that share a slice lie in a cell; the least document of a cell is a pivot, and its region is
   all that shares a cell with it. Documents in no cell with another are done.
2. Balls. Each document's distance to its least pivot is measured. Those within eps are linked to it. A region all of
   whose documents are then connected is done; in any other, connected documents stay only if their
   distance to the pivot is within eps of the distance of one that is not (the window).
3. Voronoi regions. In each region of over ``SPLIT_DOCS`` documents, ``PIVOTS`` pivots are drawn, all distances to
   them measured, and each document goes to the region of its nearest pivot p, and by window to that of any q with
   d(x, q) <= min(d(x, p) + 2 eps, 1 - eps). Documents at 1 - 2 eps or more from every pivot form the outer region,
   with those from 1 - 3 eps on as its window: a close pair meets in the home of one of the two. The ball rule
   of 2 holds around each pivot. The parts are cut again as long as they are large and have fewer pairs than the whole.
4. Leaves. Other regions are joined exactly in memory, by pivots and windows again and by one matrix
   product over patterns of shared shingles; those over ``REGION_SHINGLES`` or ``REGION_DOCS``
   go as tiles of chunk pairs, each a task's work of bounded size.

Equal sets are one class and compared once. Hot regions are dealt out to many tasks, each with the pivots. Links that add
nothing to a region's connectivity are not written.

Nulls and edge cases: a null or wordless text has the empty set and links with nothing; a null
doc_id takes no part and has a null component; of rows that repeat a doc_id each is
judged by its own text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.components import components
from quire.llm.textvec import fingerprint, mix, shingle_sets
from quire.llm.workspace import dealt, discard, planes, ragged, runs, slices, stored, unplanes

#: Shingles and documents of a region, or of a chunk of one, that one task joins at once.
REGION_SHINGLES = 2_000_000
REGION_DOCS = 2_000
#: The same for distances to pivots.
PART_SHINGLES = 500_000
PART_DOCS = 250
#: Documents of a region that is cut into Voronoi regions by a round of its own.
SPLIT_DOCS = 400
#: Parts of the cells for each task that they are dealt to.
PARTS = 4
#: Such a cut is taken back if the parts have more than this share of the region's pairs.
PAYS = 0.7
#: Documents that a leaf compares directly instead of through further pivots.
SMALL = 96
PIVOTS = 8
MAX_DEPTH = 5
MAX_ROUNDS = 5
#: Largest number of rows of three to five numbers (under 64 MB) that are broadcast.
BROADCAST_ROWS = 1_000_000
#: Slicings that a sparse set tries before it sends keys of empty slices too.
SLICINGS = 24
#: Set sizes in a class lie within this ratio.
CLASS_RATIO = 1.4


@lru_cache(maxsize=8)
def size_classes(num: int, den: int, most: int = 1 << 26) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size, slices, spare slices) of each size class for a similarity of num / den.

    A class reaches far enough that all partners of the class below lie in it."""
    low, k, spare = [1], [], []
    while low[-1] < most:
        at = low[-1]
        high = max(at, int(at * CLASS_RATIO) - 1, (at - 1) * den // num)
        largest = high * den // num
        differ = (den - num) * (high + largest) // (den + num)
        extra = int(2 * (differ + 1) * math.exp(-at / (differ + 1))) + 2
        k.append(differ + 1 + extra if differ else 0)
        spare.append(extra)
        low.append(high + 1)
    return np.array(low), np.array(k), np.array(spare)


def cell_keys(values: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the cells that a set lies in: one for each slice, in its size class and, as a
    guest, in the class below if that has possible partners. Slices without a shingle give
    no key: a set with at most ``spare`` of them shares some other slice with any partner. A set with more
    goes on to the next slicing, where that holds for it or it goes on again; so close sets share a
    cell of the first slicing that suits one of them."""
    low, slices_of, spare_of = size_classes(num, den)
    n = len(values)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    own = int(np.searchsorted(low, n, side="right")) - 1
    into = [own] + [own - 1] * bool(own and n * num <= (int(low[own]) - 1) * den)
    out = []
    for c in into:
        k = int(slices_of[c])
        if not k:
            continue
        for turn in range(SLICINGS):
            seed = np.uint64((turn + 1) * 0x5BD1E995CAFEF00D & 0xFFFFFFFFFFFFFFFF)
            at = (mix(values ^ seed) % np.uint64(k)).astype(np.int64)
            total = np.zeros(k, dtype=np.uint64)
            np.add.at(total, at, mix(values + seed))
            keys = mix(total + mix(np.arange(k, dtype=np.uint64) + np.uint64(c << 32)) + seed)
            filled = np.bincount(at, minlength=k) > 0
            enough = k - int(filled.sum()) <= spare_of[c]
            out.append(keys if turn == SLICINGS - 1 and not enough else keys[filled])
            if enough:
                break
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """All pairwise intersection sizes. Shingles that the same documents hold count as one
    column with a weight, and those of a single document as none."""
    m = len(sets)
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(start, len(flat)))
    start, size = start[size > 1], size[size > 1]
    out = np.zeros((m, m), dtype=np.float64)
    if not len(start):
        return out.astype(np.int64)
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(doc.astype(np.uint64) + np.uint64(1)))))
    pattern = total[start + size] - total[start]
    _, first, weight = np.unique(pattern, return_index=True, return_counts=True)
    for at in range(0, len(first), 4096):
        f, w = first[at : at + 4096], weight[at : at + 4096]
        n = size[f]
        column = np.repeat(np.arange(len(f)), n)
        row = doc[np.repeat(start[f] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        grid = np.zeros((m, len(f)), dtype=np.float32)
        grid[row, column] = 1
        out += (grid * w.astype(np.float32)) @ grid.T
    return np.rint(out).astype(np.int64)


def _similar(common, a, b, num: int, den: int):
    return den * common >= num * (a + b - common)


def voronoi_links(sets: list[np.ndarray], num: int, den: int, depth: int = 0) -> list[tuple[int, int]]:
    """Links (i, j) among the sets, enough to connect all that links connect."""
    m, size = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    if m < 2:
        return []
    if m <= SMALL or depth >= MAX_DEPTH:
        common = intersections(sets)
        i, j = np.nonzero(np.triu(_similar(common, size[:, None], size[None, :], num, den), 1))
        return list(zip(i.tolist(), j.tolist(), strict=True))
    eps = 1 - num / den
    flat, ends = np.concatenate(sets), np.cumsum(size)
    links: list[tuple[int, int]] = []
    nearest, pivots, far = np.full(m, np.inf), [], []
    pick = int(np.argmax(size))
    for _ in range(PIVOTS):  # each pivot is the set farthest from those before it
        held = np.isin(flat, sets[pick], assume_unique=False, kind="sort")
        total = np.concatenate(([0], np.cumsum(held)))
        common = total[ends] - total[ends - size]
        distance = 1 - common / (size + size[pick] - common)
        close = np.flatnonzero(_similar(common, size, size[pick], num, den))
        links += [(min(pick, x), max(pick, x)) for x in close.tolist() if x != pick]
        pivots.append(pick)
        far.append(distance)
        nearest = np.minimum(nearest, distance)
        pick = int(np.argmax(nearest))
        if nearest[pick] == 0:
            break
    regions = [np.flatnonzero(d <= nearest + 2 * eps + 1e-9) for d in far]
    if sum(len(r) ** 2 for r in regions) >= m * m:  # windows hold nearly all: cutting does not pay
        return links + voronoi_links(sets, num, den, MAX_DEPTH)
    for region, distance in zip(regions, far, strict=True):
        if (distance[region] <= eps / 2).all():  # all within eps of one another through the pivot
            continue
        inner = voronoi_links([sets[x] for x in region], num, den, depth + 1)
        links += [(int(region[i]), int(region[j])) for i, j in inner]
    return links


def spanning(links: list[tuple[int, int]], m: int) -> list[tuple[int, int]]:
    """(root, member) pairs that connect what the links connect; the root is the least."""
    parent = list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(find(x), x) for x in range(m) if find(x) != x]


_SIGNED = "row bigint, doc_id bigint, tie bigint, n_shingles bigint, fp1 bigint, fp2 bigint, cells array<bigint>"


def _sign(width: int, num: int, den: int):
    def run(batches):
        for batch in slices(batches, 2000):
            sets = list(shingle_sets(batch.column("text").to_pylist(), width))
            prints = [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("tie"),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([p[0] for p in prints], type=pa.int64()),
                    pa.array([p[1] for p in prints], type=pa.int64()),
                    ragged([cell_keys(s, num, den).view(np.int64) for s in sets], pa.int64()),
                ],
                names=["row", "doc_id", "tie", "n_shingles", "fp1", "fp2", "cells"],
            )

    return run


def _with_sets(width: int, kernel):
    """``kernel`` over the shingle sets of rows that come with their texts, which take less room on the way."""

    def run(batches):
        def read():
            for batch in slices(batches, 500):
                sets = shingle_sets(batch.column("text").to_pylist(), width)
                yield batch.drop_columns(["text"]).append_column("values", pa.array([x.tobytes() for x in sets], pa.binary()))

        yield from kernel(read())

    return run


def _distance(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(nodes, their sizes, pivots, common, across) of one part of a region; common and across are the sizes of
    intersections and unions, members x pivots."""
    pivot = table.column("pivot").to_numpy(zero_copy_only=False).astype(bool)
    ids, raw = table.column("node").to_numpy(), table.column("values").to_pylist()
    held = [np.frombuffer(raw[i], dtype=np.uint64) for i in np.flatnonzero(pivot)]
    at = np.flatnonzero(~pivot)
    sets = [np.frombuffer(raw[i], dtype=np.uint64) for i in at]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    flat, ends = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), np.cumsum(size)
    common = np.zeros((len(at), len(held)), dtype=np.int64)
    for k, p in enumerate(held):
        hit = p[np.minimum(np.searchsorted(p, flat), len(p) - 1)] == flat
        total = np.concatenate(([0], np.cumsum(hit)))
        common[:, k] = total[ends] - total[ends - size]
    across = size[:, None] + np.array([len(p) for p in held], dtype=np.int64)[None, :] - common
    return ids[at], size, ids[pivot], common, across


_MEASURED = "region bigint, node bigint, n bigint, d double, close boolean"


def _measure(num: int, den: int):
    """Distance of each member to the region's one pivot."""

    def run(batches):
        for (region, _), table in runs(batches, ["region", "part"]):
            ids, size, _, common, across = _distance(table)
            common, across = common[:, 0], across[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), region)), pa.array(ids), pa.array(size), pa.array(1 - common / across), pa.array(den * common >= num * across)], names=["region", "node", "n", "d", "close"])

    return run


_SPLIT = "parent bigint, region bigint, pivot bigint, node bigint, n bigint, d double, close boolean, outer boolean"


def _split(num: int, den: int):
    """Home and windows of each member among the region's pivots; ``close`` is a link with the pivot."""
    eps, slack = 1 - num / den, 1e-9

    def run(batches):
        for (region, _), table in runs(batches, ["region", "part"]):
            ids, size, pivots, common, across = _distance(table)
            d = 1 - common / across
            nearest = d.min(axis=1)
            member, k = np.nonzero((d <= nearest[:, None] + 2 * eps + slack) & (d <= 1 - eps + slack))
            far = np.flatnonzero(nearest >= 1 - 3 * eps - slack)
            own = mix(np.full(1, region, dtype=np.int64).view(np.uint64))
            sub, beyond = mix(pivots.view(np.uint64) + own), mix(own + np.uint64(1))
            close = (den * common >= num * across)[member, k]
            rows = np.concatenate((member, far))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), region)),
                    pa.array(np.concatenate((sub[k], np.repeat(beyond, len(far)))).view(np.int64)),
                    pa.array(np.concatenate((pivots[k], ids[far]))),
                    pa.array(ids[rows]),
                    pa.array(size[rows]),
                    pa.array(np.concatenate((d[member, k], np.ones(len(far))))),
                    pa.array(np.concatenate((close, np.zeros(len(far), dtype=bool)))),
                    pa.array(np.arange(len(rows)) >= len(member)),
                ],
                names=["parent", "region", "pivot", "node", "n", "d", "close", "outer"],
            )

    return run


def _leaf(num: int, den: int):
    def run(batches):
        a: list[int] = []
        b: list[int] = []
        for _, table in runs(batches, ["region", "part"]):
            once = dict(zip(table.column("node").to_pylist(), table.column("values").to_pylist(), strict=True))
            ids = list(once)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in once.values()]
            for i, j in spanning(voronoi_links(sets, num, den), len(ids)):
                a.append(ids[i])
                b.append(ids[j])
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its known number of narrow rows is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _pack(parts: int):
    """Rows (part, nodes, cells) of a batch: the cells in each of ``parts`` parts, and the node of each as its difference
    from the one before, by byte planes, of which most are zeros."""

    def run(batches):
        for batch in slices(batches, 10_000):
            held = batch.column("cells")
            cell = held.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(cell):
                continue
            node = np.repeat(batch.column("node").to_numpy(), held.value_lengths().to_numpy())
            part = (cell % np.uint64(parts)).astype(np.min_scalar_type(parts))
            order, starts, ends = dealt(part)
            part, node, cell = part[order], node[order], cell[order]
            steps = [planes(np.diff(node[i:j], prepend=0)) for i, j in zip(starts, ends, strict=True)]
            cells = [cell[i:j].tobytes() for i, j in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(part[starts].astype(np.int64)), "nodes": pa.array(steps, pa.binary()), "cells": pa.array(cells, pa.binary())})

    return run


def _meet(batches):
    """Rows (region, node) of each part, see ``_shared``."""
    for _, table in runs(batches, ["part"]):
        node = np.concatenate([np.cumsum(unplanes(x)) for x in table.column("nodes").to_pylist()])
        cell = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("cells").to_pylist()])
        order = np.argsort(cell)
        alike = cell[order][1:] == cell[order][:-1]
        met = order[np.append(alike, False) | np.insert(alike, 0, False)]
        met = met[np.lexsort((node[met], cell[met]))]
        node, cell = node[met], cell[met]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(first, len(cell)))
        region = np.repeat(node[first], size)
        two = np.repeat(node[first] < node[first + size - 1], size)
        pairs = np.unique(np.stack((region[two], node[two]), axis=1), axis=0)
        yield pa.RecordBatch.from_pydict({"region": pa.array(pairs[:, 0]), "node": pa.array(pairs[:, 1])})


def _shared(cells: DataFrame) -> DataFrame:
    """(region, node) of rows (node, cells): the least node of each cell that has two at least, and who lies in a cell
    with it. Cells cross one shuffle, packed, as they are many times as many as the documents."""
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = cells.mapInArrow(_pack(PARTS * tasks), "part bigint, nodes binary, cells binary")
    return packed.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_meet, "region bigint, node bigint").distinct()


class _Regions:
    """Texts (node, text) of the candidates, and what is done with rows (region, node, n) of their regions."""

    def __init__(self, texts: DataFrame, width: int, num: int, den: int):
        self.texts, self.width, self.num, self.den = texts, width, num, den
        self.tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def _chunks(self, members: DataFrame, docs: int, shingles: int) -> DataFrame:
        """The members with ``chunks``: tasks that their region is dealt to."""
        hot = members.groupBy("region").agg(F.greatest(F.ceil(F.sum("n") / shingles), F.ceil(F.count("*") / docs)).cast("bigint").alias("chunks")).where("chunks > 1")
        return members.join(hot, "region", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("bigint")))

    def _run(self, routes: DataFrame, kernel, schema: str, name: str) -> DataFrame:
        """``kernel`` over the sets of rows (region, part, pivot, node), sorted by region and part."""
        routes = stored(routes.select("region", "part", "pivot", "node"), "routes")
        sent = self.texts.join(_bounded(routes, routes.count()), "node")
        return stored(sent.repartition(self.tasks, "region", "part").sortWithinPartitions("region", "part").mapInArrow(_with_sets(self.width, kernel), schema), name)

    def _with_pivots(self, members: DataFrame, pivots: DataFrame) -> DataFrame:
        """Routes of members, each in one part of its region, and of the pivots to all its parts."""
        dealt = self._chunks(members, PART_DOCS, PART_SHINGLES).withColumn("part", F.pmod(F.xxhash64("node"), "chunks"))
        parts = dealt.groupBy("region").agg(F.max("chunks").alias("chunks"))
        spread = pivots.join(parts, "region").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        return dealt.select("region", "part", F.lit(False).alias("pivot"), "node").unionByName(spread.select("region", "part", F.lit(True).alias("pivot"), "node"))

    def measure(self, members: DataFrame) -> DataFrame:
        """Distances to the pivot, which is the region's own node."""
        pivots = members.select("region").distinct().withColumn("node", F.col("region"))
        return self._run(self._with_pivots(members, pivots), _measure(self.num, self.den), _MEASURED, "measured")

    def split(self, members: DataFrame, turn: int) -> DataFrame:
        """One round of Voronoi regions, see ``_split``."""
        drawn = F.xxhash64("node", F.lit(turn))
        pivots = members.groupBy("region", F.pmod(drawn, F.lit(PIVOTS)).alias("k")).agg(F.min_by("node", F.xxhash64("node", F.lit(-1 - turn))).alias("node"))
        return self._run(self._with_pivots(members, pivots), _split(self.num, self.den), _SPLIT, "split")

    def leaves(self, members: DataFrame) -> DataFrame:
        """Links (a, b) inside each region; a region of t chunks has a task for each pair of them."""
        dealt = self._chunks(members, REGION_DOCS, REGION_SHINGLES).withColumns({"own": F.pmod(F.xxhash64("node"), "chunks"), "other": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))})
        part = F.least("own", "other") * F.col("chunks") + F.greatest("own", "other")
        return self._run(dealt.select("region", part.alias("part"), F.lit(False).alias("pivot"), "node"), _leaf(self.num, self.den), "a bigint, b bigint", "links")


def _window(d: Column, least: Column, most: Column, eps: float) -> Column:
    """Whether a connected document may be within eps of one at a distance from least to most of the pivot."""
    return (d >= least - eps - 1e-9) & (d <= most + eps + 1e-9)


def _unresolved(members: DataFrame, measured: DataFrame, found: DataFrame, eps: float) -> DataFrame:
    """(region, node, n) of what the distances to the regions' pivots, and the components ``found`` by them, leave open."""
    known = measured.select("region", "node", "d")
    rows = members.join(known, ["region", "node"], "left").join(found.withColumnRenamed("component", "c"), "node", "left")
    rows = rows.select("region", "node", "n", F.coalesce("c", "node").alias("c"), F.when(F.col("node") == F.col("region"), 0.0).otherwise(F.col("d")).alias("d"), F.col("d").isNotNull().alias("is_measured"))
    rows = stored(rows, "rows")
    own = rows.where("node = region").select("region", F.col("c").alias("of"))
    marked = rows.join(own, "region").withColumn("apart", F.col("c") != F.col("of"))
    other = F.when(F.col("node") != F.col("region"), F.col("c"))
    told = marked.groupBy("region").agg(
        F.min(other).alias("lo"),
        F.max(other).alias("hi"),
        F.coalesce(F.max(F.col("apart") & ~F.col("is_measured")), F.lit(False)).alias("blind"),
        F.min(F.when(F.col("apart"), F.coalesce("d", F.lit(0.0)))).alias("least"),
        F.max(F.when(F.col("apart"), F.coalesce("d", F.lit(1.0)))).alias("most"),
    )
    open_ = told.where((F.col("lo") < F.col("hi")) | F.col("blind")).select("region", "least", "most")
    keep = F.col("apart") | F.col("d").isNull() | _window(F.col("d"), F.col("least"), F.col("most"), eps)
    return marked.join(open_, "region").where(keep).select("region", "node", "n")


def _join_regions(members: DataFrame, regions: _Regions, eps: float, log: list | None = None) -> list[DataFrame]:
    """Links (a, b) of all regions, in tables; ``log`` gets a dict of counts for each round."""
    links, now = [], members
    for turn in range(MAX_ROUNDS):
        docs = stored(now.groupBy("region").agg(F.count("*").alias("docs")).where(F.col("docs") > SPLIT_DOCS), "large")
        if docs.isEmpty():
            break
        large = stored(now.join(docs, "region").select("region", "node", "n"), "members")
        split = regions.split(large, turn)
        links.append(split.where("close").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        apart = split.where("not outer and not close").groupBy("region").agg(F.min("d").alias("least"))
        balls = split.where("not outer").join(apart, "region").where(F.col("d") >= F.col("least") - eps - 1e-9)
        subs = stored(balls.select("parent", "region", "node", "n").unionByName(split.where("outer").select("parent", "region", "node", "n")), "regions")
        parent = docs.withColumnRenamed("region", "parent")
        pairs = subs.groupBy("parent", "region").agg((F.count("*") * F.count("*")).alias("pairs")).groupBy("parent").agg(F.sum("pairs").alias("pairs"))
        whole = stored(pairs.join(parent, "parent").where(F.col("pairs") > F.lit(PAYS) * F.col("docs") * F.col("docs")).select(F.col("parent").alias("region")), "whole")
        if log is not None:
            log.append({"members": large.count(), "routed": split.count(), "left": subs.count(), "whole": whole.count()})
        done = now.join(docs.join(whole, "region", "left_anti"), "region", "left_anti")
        links.append(regions.leaves(done))
        now = stored(subs.join(whole.withColumnRenamed("region", "parent"), "parent", "left_anti").select("region", "node", "n"), "members")
        if now.isEmpty():
            return links
    links.append(regions.leaves(now))
    return links


def _linked(docs: DataFrame, width: int, num: int, den: int, log: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tie, n_shingles, fp1, fp2), where tie is the hash of the text; and classes of equal sets
    (fp1, fp2, root, of): root is alike in linked classes, of is their least doc_id. A class is known in links by
    the number of its first row, so a doc_id may have several texts or be null."""
    eps = 1 - num / den
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    signed = stored(picked.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_sign(width, num, den), _SIGNED), "signed")
    plain = stored(signed.drop("cells"), "plain")
    usable = plain.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "row")).alias("r")
    reps = usable.groupBy("fp1", "fp2").agg(first, F.first("n_shingles").alias("n"), F.count("*").alias("times"))
    reps = stored(reps.select("fp1", "fp2", F.col("r.doc_id").alias("rep_id"), F.col("r.tie").alias("rep_tie"), F.col("r.row").alias("rep_row"), "n", "times"), "reps")
    copies = stored(usable.select("fp1", "fp2", "row").join(reps.where("times > 1"), ["fp1", "fp2"]).where("row <> rep_row").select("row"), "copies")
    once = signed.where("n_shingles > 0").select("row", "cells").join(_bounded(copies, copies.count()), "row", "left_anti")
    shared = _shared(once.select(F.col("row").alias("node"), "cells"))
    sizes = reps.select(F.col("rep_row").alias("node"), "n", "rep_id", "rep_tie")
    members = stored(shared.join(sizes.select("node", "n"), "node"), "members")
    discard(signed, copies)
    met = stored(members.select("node").distinct().join(sizes, "node").select("node", "rep_id", "rep_tie"), "met")
    n_met = met.count()
    same = lambda rows: rows.doc_id.eqNullSafe(F.col("rep_id")) & (rows.tie == F.col("rep_tie"))
    candidates = picked.join(_bounded(met, n_met), same(picked)).select("node", "text")
    if usable.select("doc_id", "tie").join(_bounded(met, n_met), same(usable)).count() > n_met:  # rows that repeat
        candidates = candidates.dropDuplicates(["node"])
    texts = stored(candidates, "texts")
    regions = _Regions(texts, width, num, den)
    least = members.groupBy("node").agg(F.min("region").alias("region"), F.max("n").alias("n")).where("region <> node")
    measured = regions.measure(stored(least.select("region", "node", "n"), "least"))
    found = stored(components(measured.where("close").select(F.col("node").alias("a"), F.col("region").alias("b"))), "found")
    left = stored(_unresolved(members, measured, found, eps), "open")
    if log is not None:
        log.append({"members": members.count(), "measured": measured.count(), "open": left.count()})
    if not left.isEmpty():
        every = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        for more in _join_regions(left, regions, eps, log):
            every = every.unionByName(more)
        found = stored(components(every), "found")
    discard(texts, members, met, measured, left)
    linked = found.join(reps, found.node == reps.rep_row)
    named = linked.groupBy("component").agg(F.min("rep_id").alias("least")).join(found, "component").select("node", "component", "least")
    classes = reps.join(named, reps.rep_row == named.node, "left").select("fp1", "fp2", F.coalesce("component", "rep_row").alias("root"), F.when(F.col("component").isNull(), F.col("rep_id")).otherwise(F.col("least")).alias("of"))
    return plain.select("doc_id", "tie", "n_shingles", "fp1", "fp2"), classes


def jaccard_components(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: component_id is the least doc_id reachable
    by links, a link being a Jaccard similarity of at least num / den of the sets of
    ``width``-word shingles (words lower-cased in A-Z)."""
    plain, classes = _linked(docs, width, num, den)
    out = plain.join(classes, ["fp1", "fp2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("of", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """One row of each group of linked rows, the one of the least doc_id (nulls last) and text hash; rows without
    words stay."""
    plain, classes = _linked(docs, width, num, den)
    rows = plain.where("n_shingles > 0").groupBy("fp1", "fp2", "doc_id", "tie").agg(F.count("*").alias("n"))
    first = rows.join(classes, ["fp1", "fp2"]).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "n")).alias("r"))
    wordless = plain.where("n_shingles = 0").select("doc_id", "tie").distinct().withColumn("n", F.lit(1).cast("bigint"))
    keys = stored(first.select("r.doc_id", "r.tie", "r.n").unionByName(wordless).toDF("_id", "_tie", "_n"), "keys")
    kept = lambda k: docs.join(k, docs.doc_id.cast("bigint").eqNullSafe(k["_id"]) & (F.xxhash64(docs.text) == k["_tie"]))
    out = kept(keys.where("_n = 1")).select(docs.columns)
    again = keys.where("_n > 1")
    return out if again.isEmpty() else out.unionByName(kept(again).dropDuplicates(["_id", "_tie"]).select(docs.columns))
