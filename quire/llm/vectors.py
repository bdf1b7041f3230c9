"""Near-duplicate vectors by an exact subspace pigeonhole join.

Unit vectors with cosine >= c have squared distance <= 2 - 2 c. All vectors are turned by
one fixed random rotation, which spreads their energy evenly, and cut into blocks of
dimensions. If a pair's squared distance in every block were above the block's share of that
budget, in proportion to its dimensions, their sum would be above the budget; so each close
pair is within its share in some block. Each block is joined by range: the first dimensions of the
block are cut into cells, a vector stands in its own cell and as a guest in lower
neighbouring cells within reach, and pairs within the block's share are candidates,
which are verified by their exact cosine in double precision. A pair found in several blocks counts in the
first that has it, which both vectors tell, so pairs are counted where they are found and never
written or shuffled.

Within a cell the range join goes on by halving: a set is halved at the median of its widest dimension, and
of two sets only rows nearer than the block's share to the other's bounding box stay, until few pairs are left to
compare. So unlike vectors of a cell are mostly told apart by boxes; like ones are compared, as every link counts.

Equal vectors of a label are one class with a weight. A cell of over ``CELL_ROWS`` is cut into
tiles of chunk pairs, so that no task holds a whole hot cell.

Nulls and edge cases: rows whose label or vec_id is null, or whose vector is null, empty, zero, or holds
null or non-finite components, link with nothing (n_links 0, own component; a null vec_id has a
null component and kept false); vectors of different lengths don't link; of rows that repeat a vec_id
each is judged by its own vector; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quire.llm.components import components
from quire.llm.textvec import mix
from quire.llm.workspace import runs, slices, stored

BLOCK_DIMS = 8
#: Cells are this many reaches wide.
CELL_REACH = 4.0
#: Rows of a cell, or of a chunk of one, that one task compares at once.
CELL_ROWS = 4_000
#: Vectors that share a cell, about, which sets how many dimensions are cut.
CELL_AIM = 400
#: Pairs of rows that are compared at once; above it sets are halved.
LEAF_PAIRS = 1 << 14
#: Candidates that are verified at once.
VERIFY = 50_000
SLACK = 1e-9


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_spans(dims: int) -> list[tuple[int, int]]:
    n = max(1, dims // BLOCK_DIMS)
    edge = [dims * k // n for k in range(n + 1)]
    return list(zip(edge[:-1], edge[1:], strict=True))


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows, without a Python object per element."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _outside(points: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Squared distances of points to the bounding box of others."""
    gap = np.maximum(np.maximum(box.min(axis=0) - points, points - box.max(axis=0)), 0)
    return np.einsum("ij,ij->i", gap, gap)


def near_pairs(p: np.ndarray, left: np.ndarray, right: np.ndarray | None, limit: float):
    """(i, j) arrays of rows of ``p`` within the squared distance ``limit``, one of ``left`` and one of ``right``
    or, where that is None, two of ``left``; each pair once, in pieces of at most about ``LEAF_PAIRS``."""
    todo = [(left, right)]
    while todo:
        a, b = todo.pop()
        if b is None:
            if len(a) * len(a) > LEAF_PAIRS:
                c, d = _halve(p, a)
                todo += [(c, None), (d, None), (c, d)]
                continue
            b = a
        else:
            b = b[_outside(p[b], p[a]) <= limit] if len(a) else a
            a = a[_outside(p[a], p[b]) <= limit] if len(b) else b
            if not len(a):
                continue
            if len(a) * len(b) > LEAF_PAIRS:
                more, other = (a, b) if len(a) >= len(b) else (b, a)
                todo += [(half, other) for half in _halve(p, more)]
                continue
        u, v = p[a], p[b]
        apart = np.einsum("ij,ij->i", u, u)[:, None] + np.einsum("ij,ij->i", v, v)[None, :] - 2 * (u @ v.T)
        i, j = np.nonzero(apart <= limit)
        if a is b:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield a[i], b[j]


def _halve(p: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows below and above the median of their widest dimension; equal ones may stand on either side."""
    at = p[rows]
    widest = int(np.argmax(at.max(axis=0) - at.min(axis=0)))
    order = np.argpartition(at[:, widest], len(rows) // 2)
    return rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]


def _pooled(pairs, least: int):
    """The same pairs in fewer pieces."""
    held, n = [], 0
    for piece in pairs:
        held.append(piece)
        n += len(piece[0])
        if n >= least:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _cells(cosine: float, cut_dims: int):
    """(block, cell, home) rows of each vector."""
    budget = 2 - 2 * cosine

    def run(batches):
        for batch in slices(batches, 1000):
            lengths = pc.list_value_length(batch.column("e")).to_numpy()
            for dims in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == dims)
                part = batch.take(pa.array(of))
                y = unit(_matrix(part.column("e"))) @ rotation(dims)
                label = part.column("label").to_numpy().astype(np.int64).view(np.uint64)
                source, block, cell, home = [], [], [], []
                for b, (lo, hi) in enumerate(block_spans(dims)):
                    reach = math.sqrt(budget * (hi - lo) / dims) + SLACK
                    cut = min(cut_dims, hi - lo)
                    at = y[:, lo : lo + cut] / (reach * CELL_REACH)
                    own = np.floor(at).astype(np.int64)
                    below = at - own <= 1 / CELL_REACH
                    above = own + 1 - at <= 1 / CELL_REACH
                    rows, place = np.arange(len(own)), own
                    for k in range(cut):  # own coordinate, and each neighbour within reach
                        more = []
                        for ok, step in ((below, -1), (above, 1)):
                            near = ok[rows, k]
                            moved = place[near].copy()
                            moved[:, k] += step
                            more.append((rows[near], moved))
                        rows = np.concatenate([rows, *[m[0] for m in more]])
                        place = np.concatenate([place, *[m[1] for m in more]])
                    gap = place - own[rows]
                    first = np.argmax(gap != 0, axis=1)
                    lead = gap[np.arange(len(gap)), first]
                    keep = lead <= 0  # guests go to lower cells only
                    rows, place, lead = rows[keep], place[keep], lead[keep]
                    key = mix(label[rows] + mix(np.full(len(rows), dims * 4096 + b, dtype=np.uint64)))
                    for k in range(cut):
                        key = mix(key + place[:, k].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    source.append(rows)
                    block.append(np.full(len(rows), b, dtype=np.int32))
                    cell.append(key.view(np.int64))
                    home.append(lead == 0)
                take = part.take(pa.array(np.concatenate(source)))
                out = pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(block)), pa.array(np.concatenate(cell)), pa.array(np.concatenate(home)), take.column("rep"), take.column("w"), take.column("e")],
                    names=["block", "cell", "home", "rep", "w", "e"],
                )
                yield from slices([out], 5000)

    return run


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each node the least node that it is connected to."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        least = least[least]
        if (least == before).all():
            return least


def _compare(cosine: float):
    """Links of each cell or tile: (rep, links, to): a weight of direct links, or a connecting edge."""
    budget = 2 - 2 * cosine

    def run(batches):
        for (block, _, tile, chunks), table in runs(batches, ["block", "cell", "tile", "chunks"]):
            ids, weight = table.column("rep").to_numpy(), table.column("w").to_numpy()
            home, chunk = table.column("home").to_numpy(zero_copy_only=False), table.column("chunk").to_numpy()
            x = unit(_matrix(table.column("e")))
            n, dims = x.shape
            low, high = tile // chunks, tile % chunks
            y = x @ rotation(dims)
            spans = block_spans(dims)
            share = [budget * (b - a) / dims + SLACK for a, b in spans]
            lo, hi = spans[block]
            left = np.flatnonzero(chunk == low)
            right = None if low == high else np.flatnonzero(chunk == high)
            found_i, found_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            links = np.zeros(n, dtype=np.int64)
            for i, j in _pooled(near_pairs(np.ascontiguousarray(y[:, lo:hi]), left, right, share[block] + SLACK), VERIFY):
                some = home[i] | home[j]
                i, j = i[some], j[some]
                ok = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                i, j = i[ok], j[ok]
                gap = (y[i] - y[j]) ** 2
                new = np.ones(len(i), dtype=bool)
                for k in range(block):  # a pair within an earlier block's share counts there
                    new &= gap[:, spans[k][0] : spans[k][1]].sum(axis=1) > share[k]
                i, j = i[new], j[new]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                found_i.append(i)
                found_j.append(j)
                if sum(map(len, found_i)) > 2_000_000:  # keep what connects
                    least = _forest(n, np.concatenate(found_i), np.concatenate(found_j))
                    found_i, found_j = [np.flatnonzero(least != np.arange(n))], [least[least != np.arange(n)]]
            least = _forest(n, np.concatenate(found_i), np.concatenate(found_j))
            some, tied = np.flatnonzero(links), np.flatnonzero(least != np.arange(n))
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[some], ids[tied]])), pa.array(np.concatenate([links[some], np.zeros(len(tied), dtype=np.int64)])), pa.array(np.concatenate([ids[some], ids[least[tied]]]))],
                    names=["rep", "links", "to"],
                )

    return run


def vector_links(vectors: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    e = F.col("e")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    picked = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("e"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0)
    marked = picked.withColumn("usable", F.coalesce(usable, F.lit(False)))
    keyed = marked.withColumns({"f1": F.when(F.col("usable"), F.xxhash64(F.lit(1), "e")), "f2": F.when(F.col("usable"), F.xxhash64(F.lit(2), "e"))})
    classes = keyed.where("usable").groupBy("label", "f1", "f2").agg(F.min("vec_id").alias("vec"), F.count("*").alias("w"), F.first("e").alias("e"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # a class has a number of its own, as a vec_id may repeat
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    cut_dims = min(BLOCK_DIMS, max(1, math.ceil(math.log(max(1, most / CELL_AIM), 4))))
    kind = dict(classes.dtypes)["e"]
    cells = classes.select("label", "rep", "w", "e").mapInArrow(_cells(cosine, cut_dims), f"block int, cell bigint, home boolean, rep bigint, w bigint, e {kind}")
    hot = cells.select("block", "cell").groupBy("block", "cell").count().where(F.col("count") > CELL_ROWS).select("block", "cell", F.ceil(F.col("count") / CELL_ROWS).alias("chunks"))
    tiled = cells.join(hot, ["block", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    tiled = tiled.withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    tiled = tiled.withColumn("tile", F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")).drop("other")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["block", "cell", "tile", "chunks"]
    found = stored(tiled.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(_compare(cosine), "rep bigint, links bigint, to bigint"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tied = components(found.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    known = classes.select("label", "f1", "f2", "rep", "vec", "w").join(links, "rep", "left").join(tied, F.col("rep") == F.col("node"), "left")
    least = known.where("component is not null").groupBy("component").agg(F.min("vec").alias("least"))
    known = known.join(least, "component", "left").select("label", "f1", "f2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("least", "vec").alias("of"))
    out = keyed.select("vec_id", "label", "f1", "f2").join(known, ["label", "f1", "f2"], "left")
    component = F.coalesce("of", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def links_sql(cosine: float, table: str = "embeddings") -> str:
    """The same rows in DuckDB from all pairs of a label; for small tables."""
    return f"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from {table}
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from v),
pairs as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {cosine!r}),
reach as (select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a),
least as (select a, least(a, min(b)) as c from reach group by a),
n as (select a, count(*) as n from pairs group by a)
select vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, coalesce(least.c, vec_id) as component_id, coalesce(coalesce(least.c, vec_id) = vec_id, false) as kept
from {table} left join n on n.a = vec_id left join least on least.a = vec_id"""
