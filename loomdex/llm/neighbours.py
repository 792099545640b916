"""The k most similar vectors for every vector: a hierarchical k-means tree searched best bin first.

The tree is fitted on bounded samples: its top on one, and where that leaves too few points for leaves of the
meant size, each of the top's leaves is split further on a sample of its own, in a task of its own. So leaves hold about
LEAF vectors at any size of the collection up to LEAF * MOST_LEAVES. Every vector is indexed, in the leaf that
its own search reaches first. A search keeps a priority queue of tree nodes and
opens first the one to which the way is shortest: the sum of the query's distances from the planes that part
each node on the way from the query's own side. A similar vector lies across a plane only if the query is close to it, however
far the centroids are from both, so this order meets the nearest vectors in far fewer leaves than the similarity of centroids does. How long
a way may be is widened until the
recall of a sample of queries against brute force over all vectors reaches the target. Searches are run
leaf by leaf, as products of matrices of bounded size. Similarities are computed
in double precision.

Identical vectors are one node of the search, so a vector that a third of all
rows share costs one row, and its copies are their own nearest neighbours.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.sources.tables import table, written

#: The sample on which the top of the tree is fitted, in vectors.
SAMPLE = 40_000
#: Vectors a leaf is meant to hold, points of a sample that a leaf takes at least, and the most leaves, which bounds what is sent to the executors (to some 90 MB of 64 dimensions).
LEAF, POINTS, MOST_LEAVES = 1_000, 20, 1 << 18
#: Leaves that lie together in the tree are one cell of about CELL vectors, or a part in CELLS of a small collection; a task searches up to BLOCK vectors held by a cell for up to ASKS that ask there.
CELL, CELLS, BLOCK, ASKS = 30_000, 16, 40_000, 120_000
#: Children of an inner node.
BRANCHES = 4
#: Recall against brute force that the calibration asks for, the number of queries on which it is measured, and the most leaves that a query may visit.
TARGET_RECALL, ASKED, MOST_VISITS = 0.99, 300, 4096


def unit(x: np.ndarray) -> np.ndarray:
    """The rows of x at length one, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first by the largest element: squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids of length one, and the nearest of each row."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, near, x)
        empty = np.linalg.norm(sums, axis=1) < 1e-9
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return c, (x @ c.T).argmax(1)


def grown(sample: np.ndarray, leaf_points: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree of k-means over a sample: centroids, the range of each node's children (equal ends for leaves), and how many points it has. Node 0 is the root."""
    centroids, points, children = [np.zeros(sample.shape[1])], [len(sample)], [(0, 0)]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        k = min(BRANCHES, -(-len(rows) // leaf_points))
        if k < 2 or np.ptp(sample[rows], axis=0).max() < 1e-12:
            continue
        c, near = kmeans(sample[rows], k, rng)
        first = len(centroids)
        children[node] = (first, first + k)
        for j in range(k):
            centroids.append(c[j])
            points.append(int((near == j).sum()))
            children.append((0, 0))
            if points[-1] < len(rows):
                todo.append((first + j, rows[near == j]))
    return np.array(centroids, dtype=np.float32), np.array(children), np.array(points)


def plan(total: int, sample_size: int = SAMPLE, leaf_size: int = LEAF) -> tuple[int, int, float]:
    """How a tree over so many vectors is fitted: points of a leaf of the top, vectors that a leaf of the whole tree is to hold, and the share of
    all vectors on which the top's leaves are split further (0 where the top is fine enough)."""
    leaf_size = max(leaf_size, -(-total // MOST_LEAVES))
    of_sample = min(1.0, sample_size / max(total, 1))
    points = round(leaf_size * of_sample)
    return max(points, min(POINTS, leaf_size)), leaf_size, 0.0 if points >= POINTS or of_sample == 1 else POINTS / leaf_size


class Tree:
    """A hierarchical k-means tree. children[node] is the range of its children, leaf[node] its leaf number or -1, cell[leaf] its cell.

    ``top`` is what grown() gives over a share ``of_top`` of all vectors; ``further`` has by leaf of the top the trees
    grown over a share ``of_further``. The nodes of these are compared with a query only where its search gets there.
    """

    def __init__(self, top: tuple[np.ndarray, np.ndarray, np.ndarray], of_top: float = 1.0, further: dict[int, tuple] | None = None, of_further: float = 1.0, cell_size: int = CELL):
        centroids, children, size = [top[0]], [top[1]], [top[2] / of_top]
        self.n_top = at = len(top[0])
        ends = np.flatnonzero(top[1][:, 0] == top[1][:, 1])
        grafts = []
        for leaf, (c, kids, points) in sorted((further or {}).items()):
            if len(c) > 1:
                node = int(ends[leaf])
                moved = np.where(kids == 0, 0, kids - 1 + at)  # its root is the top's leaf
                grafts.append((node, moved[0]))
                centroids.append(c[1:])
                children.append(moved[1:])
                size.append(points[1:] / of_further)
                at += len(c) - 1
        self.centroids, self.children = np.concatenate(centroids), np.concatenate(children)
        for node, kids in grafts:
            self.children[node] = kids
        # apart[node] has the node's distances from its siblings, those without one at 1.
        self.apart = np.ones((at, BRANCHES), dtype=np.float32)
        for a, b in np.unique(self.children[self.children[:, 0] < self.children[:, 1]], axis=0):
            gap = np.linalg.norm(self.centroids[a:b, None] - self.centroids[None, a:b], axis=2)
            self.apart[a:b, : b - a] = np.where(gap > 1e-6, gap, 1)
        size = np.concatenate(size)
        is_leaf = self.children[:, 0] == self.children[:, 1]
        self.n_leaves = int(is_leaf.sum())
        self.leaf = np.where(is_leaf, np.cumsum(is_leaf) - 1, -1)
        self.size = size[is_leaf]
        self.cell, self.n_cells, under = np.zeros(self.n_leaves, dtype=np.int32), 0, [(0, -1)]
        while under:  # a cell is the highest node that is small enough, or a leaf
            node, cell = under.pop()
            if cell < 0 and (size[node] <= cell_size or is_leaf[node]):
                cell, self.n_cells = self.n_cells, self.n_cells + 1
            if is_leaf[node]:
                self.cell[self.leaf[node]] = cell
            under += [(c, cell) for c in range(*self.children[node])]
        self.cuts = np.ones((2, self.n_cells), dtype=np.int32)  # of the vectors held in each cell, and of those that ask there

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "lists"}

    @cached_property
    def lists(self) -> tuple[list[int], list[list[int]], list[float]]:
        """leaf, children and size for loops of Python; made anew by each process."""
        return self.leaf.tolist(), self.children.tolist(), self.size.tolist()

    def cut(self, x: np.ndarray, total: int, visits: int, block: int, asks: int, reach: float = np.inf, least: int = 0) -> None:
        """Sets into how many parts each cell's held and asking vectors are cut, as the sample x of all vectors has it."""
        row, leaf, nth, _ = self.search(x, visits, reach, least)
        pairs = np.unique(np.stack([row, self.cell[leaf]]), axis=1)
        share = total / max(len(x), 1)
        held = np.bincount(self.cell[leaf[nth == 0]], minlength=self.n_cells) * share
        asking = np.bincount(pairs[1], minlength=self.n_cells) * share
        self.cuts = np.maximum(1, np.ceil(np.stack([held / block, asking / asks]))).astype(np.int32)

    def visit(self, x: np.ndarray, visits: int) -> np.ndarray:
        """For each row of x the first ``visits`` leaves of its search, -1 where there are no more."""
        row, leaf, nth, _ = self.search(x, visits)
        out = np.full((len(x), visits), -1, dtype=np.int32)
        out[row, nth] = leaf
        return out

    def search(self, x: np.ndarray, visits: int, reach: float = np.inf, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, nth, way): for each row of x the leaves of its search in order, up to ``visits`` of them and to ways of length ``reach``,
        or of what length it takes to meet leaves with ``least`` vectors in all."""
        counts, found, ways = [], [], []
        leaf, children, size = self.lists
        x = x.astype(np.float32)
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024]
            for q, top in zip(part, part @ self.centroids[: self.n_top].T, strict=True):
                queue, beyond, met, held = [(0.0, 0)], [], 0, 0.0
                while met < visits:
                    if not queue and beyond and held < least:
                        heapq.heapify(beyond)
                        queue, beyond = beyond, queue
                    if not queue or held >= least and queue[0][0] > reach:
                        break
                    way, node = heapq.heappop(queue)
                    if leaf[node] >= 0:
                        held += size[leaf[node]]
                        found.append(leaf[node])
                        ways.append(way)
                        met += 1
                        continue
                    a, b = children[node]
                    near = (top[a:b] if b <= self.n_top else self.centroids[a:b] @ q).tolist()
                    best = max(near)
                    for c, one, apart in zip(range(a, b), near, self.apart[a + near.index(best)].tolist(), strict=False):
                        if (to := way + (best - one) / apart) <= reach or way > reach:
                            heapq.heappush(queue, (to, c))
                        else:
                            beyond.append((to, c))
                counts.append(met)
        row = np.repeat(np.arange(len(x)), counts).astype(np.int64)
        return row, np.array(found, dtype=np.int32), np.arange(len(row)) - np.searchsorted(row, row), np.array(ways)


def fitted(nodes: DataFrame, total: int, sample: np.ndarray, dimension: int, sample_size: int, leaf_size: int, cell_size: int) -> Tree:
    """The tree over ``nodes`` (node, embedding), of which ``sample`` holds as many as there are up to the sample's size."""
    points, _, share = plan(total, sample_size, leaf_size)
    of_top = len(sample) / max(total, 1) or 1.0
    top = grown(sample, points, np.random.default_rng(11))
    tree = Tree(top, of_top, cell_size=cell_size)
    if not share:
        return tree
    shared, rate = nodes.sparkSession.sparkContext.broadcast(tree), share

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.visit(unit(_matrix(batch.column("embedding"), dimension)), 1)[:, 0] if batch.num_rows else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("embedding")], names=["leaf", "embedding"])

    def split(group: pa.Table) -> pa.Table:
        c, children, points = grown(unit(_matrix(group.column("embedding"), dimension)), POINTS, np.random.default_rng(11))
        return pa.table({"leaf": group.column("leaf").slice(0, 1), "c": pa.array([c.ravel().tolist()], pa.list_(pa.float32())), "children": pa.array([children.ravel().tolist()], pa.list_(pa.int32())), "points": pa.array([points.tolist()], pa.list_(pa.int32()))})

    some = nodes.where(F.pmod(F.xxhash64("node", F.lit(17)), F.lit(1_000_000)) < int(rate * 1_000_000)).select("embedding")
    parts = some.mapInArrow(assign, "leaf int, embedding array<float>").groupBy("leaf").applyInArrow(split, "leaf int, c array<float>, children array<int>, points array<int>")
    further = {r["leaf"]: (np.array(r["c"], dtype=np.float32).reshape(-1, dimension), np.array(r["children"]).reshape(-1, 2), np.array(r["points"])) for r in parts.toLocalIterator()}  # MOST_LEAVES bounds them
    return Tree(top, of_top, further, rate, cell_size)


def count(tree: Tree, nodes: DataFrame, dimension: int) -> None:
    """Sets the sizes of the leaves to the numbers of vectors that they hold."""
    if tree.n_leaves == 1:
        return
    shared = nodes.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.search(unit(_matrix(batch.column("embedding"), dimension)), 1)[1])], names=["leaf"])

    tree.size = np.zeros(tree.n_leaves)
    for leaf, n in nodes.select("embedding").mapInArrow(assign, "leaf int").groupBy("leaf").count().toLocalIterator():  # MOST_LEAVES bounds them
        tree.size[leaf] = n
    tree.__dict__.pop("lists", None)


def calibrate(tree: Tree, nodes: DataFrame, numbers: np.ndarray, queries: np.ndarray, k: int, target: float = TARGET_RECALL) -> tuple[float, float]:
    """The shortest reach of a search that gives the target recall, and that recall.

    It is measured against brute force: each of the (bounded) queries against all of ``nodes``, in one pass
    that returns k rows a query; fewer vectors than the index holds would lie further apart than they do in it.
    """
    if tree.n_leaves == 1:
        return np.inf, 1.0
    dimension, shared = queries.shape[1], nodes.sparkSession.sparkContext.broadcast((tree, numbers, queries))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, numbers, q = shared.value
        where = {int(i): n for n, i in enumerate(numbers)}
        for batch in batches:
            x = unit(_matrix(batch.column("embedding"), dimension))
            close = q @ x.T
            for n in np.flatnonzero(np.isin(own := batch.column("node").to_numpy(), numbers)):
                close[where[int(own[n])], n] = -np.inf
            take = min(k, len(x))
            best = np.argpartition(-close, take - 1, axis=1)[:, :take]
            used, back = np.unique(best, return_inverse=True)
            leaf = tree.visit(x[used], 1)[:, 0][back.reshape(best.shape)]
            row = np.repeat(np.arange(len(q)), take).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(leaf.ravel()), pa.array(np.take_along_axis(close, best, 1).ravel())], names=["query", "leaf", "close"])

    rows = nodes.select("node", "embedding").mapInArrow(nearest, "query int, leaf int, close double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("close")))
    true = rows.withColumn("n", rank).where(F.col("n") <= k).select("query", "leaf").toArrow()
    row, leaf, _, way = tree.search(queries, min(tree.n_leaves, MOST_VISITS))
    met = dict(zip(zip(row.tolist(), leaf.tolist(), strict=True), way.tolist(), strict=True))
    ways = np.sort([met.get(x, np.inf) for x in zip(true.column("query").to_pylist(), true.column("leaf").to_pylist(), strict=True)])
    reach = min(ways[min(len(ways) - 1, int(np.ceil(target * len(ways))) - 1)], way.max()) + 1e-6  # single precision may differ by that
    return float(reach), float((ways <= reach).mean())


def usable(chunks: DataFrame, dimension: int) -> DataFrame:
    """(id, embedding), each id once (its latest row), if the embedding has ``dimension`` elements, all finite and not all zero."""
    fine = (F.size("embedding") == dimension) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = chunks.where("id is not null").select("id", "embedding", "updated_at", F.xxhash64("embedding").alias("h"))
    # An id delivered again has the same values, as a rule; those that don't are found without moving the embeddings.
    by = rows.groupBy("id").agg(F.max_by("h", F.struct("updated_at", "h")).alias("latest"), F.min("h").alias("least"), F.max("h").alias("most"))
    differing = written(by.where("least <> most").select("id", "latest"))
    rows = rows.where(F.col("embedding").isNotNull() & fine)
    return rows.join(differing, "id", "left").where("latest is null or latest = h").select("id", "embedding")


def _matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def neighbours(vectors: DataFrame, k: int = 5, dimension: int = 64, **sizes: int) -> DataFrame:
    """(id, neighbour, similarity): for each id of ``vectors`` (id, embedding) its k most similar others.

    Of identical vectors the lesser ids come first. Repeated rows count once; the embeddings are usable (see usable()). Fewer than k + 1 vectors give what there are;
    an empty table gives an empty one. All vectors are indexed and all are queries.
    """
    return searched(vectors, k, dimension, **sizes)[0]


def searched(vectors: DataFrame, k: int = 5, dimension: int = 64, sample_size: int = SAMPLE, leaf_size: int = LEAF, cell_size: int = CELL, block: int = BLOCK, asks: int = ASKS) -> tuple[DataFrame, float]:
    """neighbours(), and the recall against brute force that the calibration measured on its queries."""
    spark = vectors.sparkSession
    # 1. The first k + 1 ids of each group of identical vectors; the group limit is applied before the shuffle.
    same = F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit("second"), "embedding").alias("b"))
    keyed = vectors.withColumn("same", same)
    firsts = keyed.withColumn("n", F.dense_rank().over(Window.partitionBy("same").orderBy("id"))).where(F.col("n") <= k + 1)
    nodes = firsts.groupBy("same").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("embedding").alias("embedding"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    total = nodes.count()

    # 2. The tree, from bounded samples.
    picked = nodes if total <= sample_size else nodes.orderBy(F.xxhash64("same", F.lit(7))).limit(sample_size)
    picked = picked.select("node", "embedding").toArrow()
    sample = unit(_matrix(picked.column("embedding"), dimension)) if total else np.zeros((0, dimension))
    tree = fitted(nodes, total, sample, dimension, sample_size, leaf_size, min(cell_size, max(leaf_size, -(-total // CELLS))))
    asked = np.unique(np.linspace(0, max(len(sample) - 1, 0), min(ASKED, len(sample))).astype(int))
    reach, recall = calibrate(tree, nodes, picked.column("node").to_numpy()[asked], sample[asked], k)
    count(tree, nodes, dimension)
    least = 2 * (k + 1)  # a search within reach of small leaves only goes on, so that each vector gets its k
    tree.cut(sample[:: max(1, len(sample) // 4000)], total, MOST_VISITS, block, asks, reach, least)
    shared = spark.sparkContext.broadcast((tree, reach))  # bounded by MOST_LEAVES

    # 3. One row for each cell that a node's search enters, with the leaves it visits there; held is the leaf that holds it. Where a
    # cell's held or asking vectors are cut, each part of the one meets each part of the other once. Role 1: held here, 2: asks here, 3: both.
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, reach = shared.value
        for batch in (whole.slice(lo, 2048) for whole in batches for lo in range(0, whole.num_rows, 2048)):
            row, leaf, nth, _ = tree.search(unit(_matrix(batch.column("embedding"), dimension)), MOST_VISITS, reach, least)
            cell = tree.cell[leaf]
            order = np.lexsort((nth, cell, row))
            row, leaf, cell, nth = row[order], leaf[order], cell[order], nth[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])]) if len(row) else np.zeros(0, dtype=int)
            ends = np.r_[first, len(row)]
            at, here = row[first], cell[first]
            held = np.where(nth[first] == 0, leaf[first], -1).astype(np.int32)
            salt = batch.column("node").to_numpy()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            parts, groups = tree.cuts[0][here], tree.cuts[1][here]
            part, group = (salt >> np.uint64(33)).astype(np.int64) % parts, (salt >> np.uint64(13)).astype(np.int64) % (1 << 20) % groups
            # Each asks in all parts; what is held goes to all groups that ask.
            asks = np.repeat(np.arange(len(first)), parts)
            to_part = np.arange(len(asks)) - np.repeat(np.cumsum(parts) - parts, parts)
            holds = np.repeat(np.flatnonzero(held >= 0), groups[held >= 0])
            to_group = np.arange(len(holds)) - np.repeat(np.cumsum(groups[held >= 0]) - groups[held >= 0], groups[held >= 0])
            both = (held[asks] >= 0) & (to_part == part[asks])
            only = to_group != group[holds]
            entry = np.r_[asks, holds[only]]
            role = np.r_[np.where(both, 3, 2), np.ones(int(only.sum()), dtype=np.int64)].astype(np.int32)
            n_leaves = np.where(role >= 2, np.diff(ends)[entry], 0)
            flat = np.repeat(ends[:-1][entry], n_leaves) + np.arange(n_leaves.sum()) - np.repeat(np.cumsum(n_leaves) - n_leaves, n_leaves)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_leaves)].astype(np.int32)), pa.array(leaf[flat]))
            take = pa.array(at[entry])
            columns = [pa.array(here[entry]), pa.array(np.r_[to_part, part[holds[only]]].astype(np.int32)), pa.array(np.r_[group[asks], to_group[only]].astype(np.int32)), pa.array(role), pa.array(held[entry]), lists]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("node").take(take), batch.column("embedding").take(take)], names=["cell", "part", "ask", "role", "held", "leaves", "node", "embedding"])

    placed = nodes.select("node", "embedding").mapInArrow(spread, "cell int, part int, ask int, role int, held int, leaves array<int>, node long, embedding array<float>")

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x, role = unit(_matrix(group.column("embedding"), dimension)), group.column("role").to_numpy()
        small, node, home = x.astype(np.float32), group.column("node").to_numpy(), group.column("held").to_numpy()
        lists = group.column("leaves").combine_chunks()
        row = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
        leaf = lists.flatten().to_numpy()
        row, leaf = row[role[row] >= 2], leaf[role[row] >= 2]
        row, leaf = row[order := np.argsort(leaf, kind="stable")], leaf[order]
        holders = np.flatnonzero((role & 1) == 1)
        holders = holders[np.argsort(home[holders], kind="stable")]
        who, near, sim = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        for one in np.unique(leaf):
            held = holders[slice(*np.searchsorted(home[holders], [one, one + 1]))]
            asking = row[slice(*np.searchsorted(leaf, [one, one + 1]))]
            take = min(k + 3, len(held))  # single precision finds a few more than k, double precision ranks them
            for lo in range(0, len(asking) if take else 0, 1024):
                q = asking[lo : lo + 1024]
                rough = small[q] @ small[held].T
                best = np.argpartition(-rough, take - 1, axis=1)[:, :take] if take < len(held) else np.tile(np.arange(len(held)), (len(q), 1))
                best = held[best]
                exact = np.einsum("qd,qtd->qt", x[q], x[best])
                exact[best == q[:, None]] = -np.inf
                who.append(np.repeat(q, take)), near.append(best.ravel()), sim.append(exact.ravel())
        who, near, sim = map(np.concatenate, (who, near, sim))
        order = np.lexsort((node[near], -sim, who))
        who, near, sim = who[order], near[order], sim[order]
        start = np.searchsorted(who, who, "left")
        keep = (np.arange(len(who)) - start < k) & (sim > -np.inf)
        who, near, sim = who[keep], near[keep], sim[keep]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, dtype=int)
        ends = pa.array(np.r_[first, len(who)].astype(np.int32))
        return pa.table({"node": node[who[first]], "near": pa.ListArray.from_arrays(ends, pa.array(node[near])), "similarity": pa.ListArray.from_arrays(ends, pa.array(sim))})

    found = placed.groupBy("cell", "part", "ask").applyInArrow(search, "node long, near array<long>, similarity array<double>")
    lists = F.flatten(F.collect_list(F.arrays_zip(F.transform("similarity", lambda x: -x).alias("far"), "near")))  # at most k from each cell that the node enters
    nearest = found.groupBy("node").agg(F.slice(F.array_sort(lists), 1, k).alias("nearest"))

    # 4. Back to ids: copies of a vector come first, then the copies of the nearest nodes, the lesser ids first.
    names = nodes.select("node", "ids")
    near = names.where(F.size("ids") <= k).join(nearest, "node").select("node", F.explode("nearest").alias("x")).select("node", F.col("x.far").alias("far"), F.col("x.near").alias("near"))
    near = near.join(names.select(F.col("node").alias("near"), F.col("ids").alias("near_ids")), "near")
    order = near.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("far", "near_ids"))).alias("order"))
    flat = F.slice(F.flatten(F.transform("order", lambda o: F.transform(o["near_ids"], lambda i: F.struct(i.alias("neighbour"), (-o["far"]).alias("similarity"))))), 1, k)
    own = lambda me: F.transform(F.filter("ids", lambda i: i != me), lambda i: F.struct(i.alias("neighbour"), F.lit(1.0).alias("similarity")))
    few = names.where(F.size("ids") <= k).join(order.select("node", flat.alias("flat")), "node", "left")
    few = few.select(F.explode("ids").alias("me"), "ids", F.coalesce("flat", F.array().cast("array<struct<neighbour:string,similarity:double>>")).alias("flat"))
    few = few.select(F.col("me").alias("id"), F.slice(F.concat(own(F.col("me")), "flat"), 1, k).alias("r"))
    crowded = written(nodes.where(F.size("ids") > k).select("same", "ids"))
    many = keyed.select("id", "same").join(crowded, "same").select("id", F.slice(own(F.col("id")), 1, k).alias("r"))
    return few.unionByName(many.distinct()).select("id", F.explode("r").alias("r")).select("id", "r.neighbour", "r.similarity"), recall


def _usable(spark, d: str) -> DataFrame:
    return usable(table(spark, d, "chunks_new", "id", "embedding", "updated_at"), 64)


def p3_found(spark, d: str) -> DataFrame:
    """Pairs of chunks of which one is among the five nearest of the other."""
    found = neighbours(_usable(spark, d))
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p3_neighbours(spark, d: str) -> DataFrame:
    """The five nearest of every usable chunk, with rank and similarity, and the recall that the search was calibrated to."""
    found, recall = searched(_usable(spark, d))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return found.select("id", "neighbour", F.round("similarity", 6).alias("similarity"), rank.alias("rank"), F.lit(round(recall, 4)).alias("measured_recall"))


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}
SQL = {}
