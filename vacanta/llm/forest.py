"""Near-duplicate embeddings with a forest of random-projection trees.

Every tree splits recursively along random directions. A split sends what lies within a quantile band
around the median to both sides (spill), so near neighbours rarely part, and the band holds the same
share of rows whatever the data looks like. Thresholds are fitted on at most ``SAMPLE`` distinct
vectors; every vector is then routed through all trees. Leaves are compared all against all by blocked
matrix products, links are verified in double precision, and connected components unite them.

Groups that are dense around a vector do not go into the trees, which would cut through them. From the
sample, vectors with many links become pivots, until what is left has no such vector. What links with a
pivot is settled exactly: all its links lie within twice the link angle of the pivot, so a pivot's own
vectors are compared with all vectors there, in tasks of a row block and a column block cut by the
angle to the pivot. Blocks whose angles add up to the link angle at most are links without comparing,
blocks whose angles differ by more have none. Only pairs of vectors of no pivot are left to the trees.

A pair that meets in several leaves counts in the first of them only: each vector carries the list of
its leaves, so no pair leaves its task and nothing has to be made distinct later. Equal vectors are one
point with a number of copies, so a common vector costs as much as a rare one.

The number of leaves follows the number of vectors up to ``SAMPLE / 16`` leaves per tree, which keeps
leaves near ``LEAF`` vectors up to four million distinct vectors; beyond that leaves grow in
proportion and are still compared in blocks.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite component, link
with nothing; vectors of different lengths never link; rows with equal id and embedding are one vector;
a row with a null id is left out of all links and has a null component; an empty table gives an empty
table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.llm.components import components
from vacanta.sources.staging import stage

COSINE = 0.9
TREES = 12
#: Share of a node's vectors on either side of the median that go to both children.
SPILL = 0.06
#: Vectors per leaf that the depth aims at, before spill.
LEAF = 400
#: Most vectors that the thresholds are fitted on.
SAMPLE = 131_072
#: Rows of a leaf that are multiplied at once.
BLOCK = 1024
#: Links in the sample that make a pivot, at least; of a whole table it is half a leaf.
LEAST_DENSE = 32
#: Vectors of a pivot that a task holds on either side, about.
DENSE_BLOCK = 4096
#: Angles closer than this are left to the comparison.
MARGIN = 1e-6
#: Added to angles by a draw per point, so that equal angles can be cut.
JITTER = 1e-9


@dataclass
class Tree:
    """Nodes of a tree in level order; a node without children is a leaf."""

    direction: np.ndarray
    low: np.ndarray
    high: np.ndarray
    #: First of the two children, -1 for a leaf.
    child: np.ndarray
    #: Number of a leaf in the whole forest, -1 for an inner node.
    leaf: np.ndarray

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all rows of x; a row may be in several leaves."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, leaves = [], []
        while len(row):
            done = self.child[node] < 0
            rows.append(row[done])
            leaves.append(self.leaf[node[done]])
            row, node = row[~done], node[~done]
            if not len(row):
                break
            place = np.einsum("ij,ij->i", x[row], self.direction[node])
            left, right = place <= self.high[node], place >= self.low[node]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([self.child[node[left]], self.child[node[right]] + 1])
        return np.concatenate(rows), np.concatenate(leaves)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fit_tree(x: np.ndarray, depth: int, spill: float, seed: int, first_leaf: int) -> Tree:
    rng = np.random.default_rng(seed)
    direction, low, high, child, leaf = [], [], [], [], []
    level = [np.arange(len(x))]
    next_leaf, size = first_leaf, 1
    for at_depth in range(depth + 1):
        following = []
        for rows in level:
            d = rng.standard_normal(x.shape[1])
            place = x[rows] @ d
            a, b = (np.quantile(place, [0.5 - spill, 0.5 + spill])) if len(rows) >= 16 else (0.0, 0.0)
            direction.append(d)
            # No split without a spread: both sides would get everything.
            if at_depth < depth and len(rows) >= 16 and a < b:
                low.append(a)
                high.append(b)
                child.append(size)
                leaf.append(-1)
                size += 2
                following += [rows[place <= b], rows[place >= a]]
            else:
                low.append(0.0)
                high.append(0.0)
                child.append(-1)
                leaf.append(next_leaf)
                next_leaf += 1
        level = following
    return Tree(np.array(direction), np.array(low), np.array(high), np.array(child, np.int64), np.array(leaf, np.int64))


def fit_forest(x: np.ndarray, n_vectors: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, first_leaf: int = 0) -> list[Tree]:
    """Trees over a sample x of n_vectors unit vectors."""
    depth = max(0, int(np.ceil(np.log2(max(n_vectors, 1) / leaf))))
    out: list[Tree] = []
    for t in range(trees):
        out.append(fit_tree(x, depth, spill, 1000 + t, first_leaf))
        first_leaf = int(out[-1].leaf.max()) + 1
    return out


@dataclass
class Dense:
    """Pivots, and by pivot the inner cuts of the angle of its own vectors (rows) and of all that can link with them (columns)."""

    point: np.ndarray
    pivot: np.ndarray
    rows: list[np.ndarray]
    columns: list[np.ndarray]
    #: Cosine and angle of a link, and the largest angle to a pivot of what can link with its own vectors.
    least: float
    link: float
    reach: float

    def place(self, x: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pivot that each vector belongs to, -1 for none; its angles to all pivots, told apart by the point."""
        # Rounded, so that a vector's pivot does not depend on the rows beside it.
        cosine = np.round(np.clip(x @ self.pivot.T, -1, 1), 12)
        angle = np.arccos(cosine)
        own = cosine.argmax(axis=1) if len(self.pivot) else np.zeros(len(x), np.int64)
        linked = cosine[np.arange(len(x)), own] >= self.least if len(self.pivot) else np.zeros(len(x), bool)
        draw = (point.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.float64) / (1 << 24)
        return np.where(linked, own, -1), angle + JITTER * draw[:, None]

    def columns_of(self, pivot: int, row: int) -> np.ndarray:
        """Column blocks that can hold a link of a row block's vectors."""
        low, high = _span(self.rows[pivot], row, self.link)
        spans = [_span(self.columns[pivot], j, self.reach) for j in range(len(self.columns[pivot]) + 1)]
        return np.array([j for j, (a, b) in enumerate(spans) if a - high <= self.link + MARGIN and low - b <= self.link + MARGIN], np.int64)


def _span(cuts: np.ndarray, block: int, most: float) -> tuple[float, float]:
    return (cuts[block - 1] if block else 0.0), (cuts[block] if block < len(cuts) else most)


def fit_dense(x: np.ndarray, point: np.ndarray, n_vectors: int, least: float, leaf: int = LEAF, block: int = DENSE_BLOCK) -> Dense:
    """Pivots from a sample x of n_vectors unit vectors."""
    link = float(np.arccos(min(1.0, least)))
    reach = min(np.pi, 2 * link) + MARGIN
    rate = max(1.0, n_vectors / max(len(x), 1))
    enough = max(LEAST_DENSE, int(np.ceil(leaf / 2 / rate)))
    # A group of that many links holds eight candidates, by expectation.
    candidates = np.random.default_rng(77).permutation(len(x))[: 8 * -(-len(x) // enough)]
    small = x.astype(np.float32)
    links = np.concatenate([np.zeros(0, np.int64), *((small[candidates[a : a + 256]] @ small.T >= least).sum(axis=1) for a in range(0, len(candidates), 256))])
    order = np.lexsort((point[candidates], -links))
    free, chosen = np.arange(len(x)), []
    inside = np.ones(len(x), bool)
    for i in candidates[order[links[order] > enough]]:
        if not inside[i]:
            continue
        near = free[x[free] @ x[i] >= least]
        if len(near) > enough:
            chosen.append(i)
            inside[near] = False
            free = free[inside[free]]
    dense = Dense(point[chosen], x[chosen], [], [], least, link, reach)
    # Sizes are those of the sample, times what it stands for.
    rows, columns = [[] for _ in chosen], [[] for _ in chosen]
    for a in range(0, len(x) if chosen else 0, 4096):
        own, angle = dense.place(x[a : a + 4096], point[a : a + 4096])
        for p in range(len(chosen)):
            rows[p].append(angle[own == p, p])
            columns[p].append(angle[angle[:, p] <= reach, p])
    for cuts, found in ((dense.rows, rows), (dense.columns, columns)):
        for parts in found:
            angles = np.concatenate(parts)
            blocks = min(max(1, round(len(angles) * rate / block)), len(angles))
            cuts.append(np.quantile(angles, np.arange(1, blocks) / blocks) if blocks > 1 else np.zeros(0))
    return dense


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _vectors(column: pa.Array) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _route_dense(shared):
    """Vectors to the row and column blocks of all pivots that they can have links around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = shared.value
        wanted = [[dense.columns_of(p, i) for i in range(len(r) + 1)] for p, r in enumerate(dense.rows)]
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                own, angle = dense.place(_vectors(part.column("embedding")), part.column("point").to_numpy())
                # (row of the batch, pivot, row block, column block, as a row)
                sent = [np.zeros((0, 5), np.int64)]
                for p in np.flatnonzero((angle <= dense.reach + JITTER).any(axis=0)):
                    at = np.flatnonzero(angle[:, p] <= dense.reach + JITTER)
                    row = np.searchsorted(dense.rows[p], angle[at, p])
                    column = np.searchsorted(dense.columns[p], angle[at, p])
                    for i, columns in enumerate(wanted[p]):
                        mine = at[(own[at] == p) & (row == i)]
                        for j in columns:
                            sent.append(np.stack(np.broadcast_arrays(mine, p, i, j, 1), axis=1))
                        there = np.isin(column, columns)
                        sent.append(np.stack(np.broadcast_arrays(at[there], p, i, column[there], 0), axis=1))
                sent = np.concatenate(sent)
                for a in range(0, len(sent), 4096):
                    at, p, i, j, side = sent[a : a + 4096].T
                    rows = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p), pa.array(i), pa.array(j), pa.array(side == 1), pa.array(own[at]), pa.array(angle[at, p]), rows.column("point"), rows.column("copies"), rows.column("embedding")],
                        ["pivot", "row", "col", "is_row", "own", "angle", "point", "copies", "embedding"],
                    )

    return run


def _dense_links(shared, least: float):
    """Links of a row block's vectors inside a column block; all that have any are one with the pivot."""

    def run(table: pa.Table) -> pa.Table:
        dense, table = shared.value, table.combine_chunks()
        pivot = table["pivot"][0].as_py()
        side = table["is_row"].to_numpy(zero_copy_only=False).astype(bool)
        angle, copies = table["angle"].to_numpy(), table["copies"].to_numpy().astype(np.float64)
        point, own = table["point"].to_numpy(), table["own"].to_numpy()
        rows, columns = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(rows) or not len(columns):
            return pa.table({name: pa.array([], pa.int64()) for name in ("point", "links", "root")})
        from_rows, from_columns, reached = np.zeros(len(rows)), np.zeros(len(columns)), np.zeros(len(columns), bool)
        same = {p: k for k, p in enumerate(point[columns].tolist())}
        same = np.array([same.get(p, -1) for p in point[rows].tolist()])
        if angle[rows].max() + angle[columns].max() <= dense.link - MARGIN:
            from_rows += copies[columns].sum()
            from_columns += copies[rows].sum()
            reached[:] = True
            from_rows[same >= 0] -= copies[columns][same[same >= 0]]
        else:
            vectors = table["embedding"].combine_chunks()
            x, y = _vectors(vectors.take(pa.array(rows))), _vectors(vectors.take(pa.array(columns)))
            for a in range(0, len(rows), BLOCK):
                linked = x[a : a + BLOCK] @ y.T >= least
                itself = np.flatnonzero(same[a : a + BLOCK] >= 0)
                linked[itself, same[a : a + BLOCK][itself]] = False
                from_rows[a : a + BLOCK] = linked @ copies[columns]
                from_columns += copies[rows][a : a + BLOCK] @ linked
                reached |= linked.any(axis=0)
        # A pivot's vectors get all their links as rows; vectors of no pivot get those with rows here.
        free = own[columns] < 0
        others = np.flatnonzero(reached & (own[columns] != pivot))
        return pa.table(
            {
                "point": np.concatenate([point[rows], point[columns][others]]),
                "links": np.concatenate([from_rows, np.where(free, from_columns, 0)[others]]).astype(np.int64),
                "root": np.full(len(rows) + len(others), dense.point[pivot], np.int64),
            }
        )

    return run


def _route(trees: list[Tree], shared):
    """Vectors of no pivot to the leaves of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, _ = shared.value.place(_vectors(batch.column("embedding")), batch.column("point").to_numpy())
            batch = batch.take(pa.array(np.flatnonzero(own < 0)))
            n = batch.num_rows
            if not n:
                continue
            vectors = batch.column("embedding")
            x = _vectors(vectors)
            found = [t.route(x) for t in trees.value]
            row, leaf = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            cut = np.searchsorted(row, np.arange(n + 1))
            lists = pa.array([leaf[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
            for a in range(0, len(row), 4096):  # small batches: a row repeats its vector for each leaf
                at = pa.array(row[a : a + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[a : a + 4096]), batch.column("point").take(at), batch.column("copies").take(at), vectors.take(at), lists.take(at)],
                    ["leaf", "point", "copies", "embedding", "leaves"],
                )

    return run


def _leaf_links(least: float):
    """Links inside one leaf: per point the linked vectors that count here and the smallest point reached."""

    def run(table: pa.Table) -> pa.Table:
        m = table.num_rows
        point, copies = table["point"].to_numpy(), table["copies"].to_numpy().astype(np.float64)
        here = table["leaf"][0].as_py()
        order = np.argsort(point)
        point, copies = point[order], copies[order]
        x = unit(table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(m, -1)[order])
        lists = [np.frombuffer(b, np.int32) for b in table["leaves"].to_pylist()]
        lists = [lists[i][lists[i] < here] for i in order]
        codes, column = np.unique(np.concatenate(lists), return_inverse=True)
        earlier = np.zeros((m, len(codes)), np.float32)
        earlier[np.repeat(np.arange(m), [len(v) for v in lists]), column] = 1
        counted = np.zeros(m)
        a_side, b_side = [], []
        for start in range(0, m, BLOCK):
            rows = slice(start, min(start + BLOCK, m))
            linked = x[rows] @ x.T >= least
            linked[np.arange(linked.shape[0]), np.arange(rows.start, rows.stop)] = False
            counted[rows] = (linked & ((earlier[rows] @ earlier.T) == 0)) @ copies
            a, b = np.nonzero(linked)
            lower = b < a + start
            a_side.append(a[lower] + start)
            b_side.append(b[lower])
        label = np.arange(m)
        a, b = np.concatenate(a_side), np.concatenate(b_side)
        while len(a):
            lowest = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, lowest)
            np.minimum.at(new, b, lowest)
            new = new[new]
            if (new == label).all():
                break
            label = new
        keep = (counted > 0) | (label != np.arange(m))
        return pa.table({"point": point[keep], "links": counted[keep].astype(np.int64), "root": point[label[keep]]})

    return run


def near_embeddings(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """(id, n_links, component, kept) per vector of ``rows``."""
    spark = rows.sparkSession
    # Vectors travel as they were given, floats or doubles; all arithmetic is in double precision.
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    given = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("embedding")).distinct()
    good = given.where(F.col("id").isNotNull() & usable(F.col("embedding")))
    points = stage(good.groupBy("embedding").agg(F.min("id").alias("point"), F.count("*").alias("copies")).withColumn("size", F.size("embedding")), "points")
    found, first_leaf = None, 0
    for size, n in sorted((r["size"], r["n"]) for r in points.groupBy("size").agg(F.count("*").alias("n")).collect()):
        own = points.where(F.col("size") == size).select("point", "copies", "embedding")
        draw = F.pmod(F.xxhash64(F.lit(3), "point"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
        sample = own.where(draw).select("point", "embedding").orderBy(F.xxhash64("embedding")).toArrow().combine_chunks()
        x, point = _vectors(sample["embedding"].combine_chunks()) if sample.num_rows else np.zeros((0, size)), sample["point"].to_numpy()
        dense = fit_dense(x, point, n, least, leaf)
        settled = spark.sparkContext.broadcast(dense)  # pivots: vectors with links in the sample that do not overlap
        if len(dense.point):
            sent = own.mapInArrow(_route_dense(settled), f"pivot long, row long, col long, is_row boolean, own long, angle double, point long, copies long, embedding {kind}")
            links = sent.groupBy("pivot", "row", "col").applyInArrow(_dense_links(settled, least), "point long, links long, root long")
            found = links if found is None else found.unionByName(links)
            free = np.concatenate([dense.place(x[a : a + 4096], point[a : a + 4096])[0] for a in range(0, len(x), 4096)]) < 0
            n, x = max(1, int(np.ceil(n * free.mean()))), x[free]
        forest = fit_forest(x, n, trees, leaf, spill, first_leaf)
        first_leaf = int(forest[-1].leaf.max()) + 1
        shared = spark.sparkContext.broadcast(forest)  # at most SAMPLE / 8 nodes a tree
        routed = own.mapInArrow(_route(shared, settled), f"leaf long, point long, copies long, embedding {kind}, leaves binary")
        links = routed.groupBy("leaf").applyInArrow(_leaf_links(least), "point long, links long, root long")
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = spark.createDataFrame([], "point long, links long, root long")
    found = stage(found, "leaf_links")
    counts = found.groupBy("point").agg(F.sum("links").alias("links"))
    groups = components(found.where("point <> root").select(F.col("point").alias("a"), F.col("root").alias("b")))
    placed = points.join(counts, "point", "left").join(groups.withColumnRenamed("id", "point"), "point", "left")
    placed = stage(
        placed.select(
            "embedding",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "point").alias("component"),
        ),
        "placed",
    )
    linked = good.join(placed, "embedding").select("id", "n_links", "component")
    alone = given.where(~(F.col("id").isNotNull() & usable(F.col("embedding")))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
