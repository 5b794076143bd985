"""Approximate nearest neighbours by a forest of random-projection trees.

The forest is fitted on a bounded sample (``SAMPLE`` vectors by hash): each inner node projects on a random direction and cuts half way.
The sample also tells how many leaves a search has to open: its own vectors are searched among its own, and the budget is the number of leaves
that finds ``target`` of the true neighbours.  Clustered vectors need few leaves; on vectors without any
structure no index can leave out much, and the budget says so.

Every vector is then put into its leaf of each tree.  A query walks all trees through one priority queue: the leaf that is least
far behind the cutting planes comes next, from whatever tree, until the budget is used.  Spark brings the opened leaves' vectors
and the queries together, leaf by leaf in cells of bounded size, and there distances are taken exactly, in double precision.

Equal vectors are one vector with its smallest ids, for queries as for candidates, so a vector that a third of the rows hold fills no
leaf and meets itself once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

K = 10
SAMPLE = 16_384  # vectors that the forest is fitted on
TREES, LEAF = 8, 64  # trees, and vectors of the sample in a leaf at most
ASKED = 128  # vectors of the sample that are searched to set the budget
TARGET = 0.99  # share of true neighbours in the sample that the budget has to find
CELL_ROWS, CELL_QUERIES = 4096, 2048
SEED = 7


@dataclass
class Tree:
    """Inner nodes by number: direction, cut, and the nodes below; a negative node is leaf ``-1 - node``."""

    plane: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(x), dtype=np.int64) if len(self.cut) else np.full(len(x), -1)
        while (at := np.flatnonzero(node >= 0)).size:
            n = node[at]
            side = (np.einsum("ij,ij->i", x[at], self.plane[n]) >= self.cut[n]).astype(int)
            node[at] = self.below[n, side]
        return -1 - node


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree over ``x``; equal projections are not torn apart, so a leaf may be larger than ``leaf``."""
    planes, cuts, below, leaves = [], [], [], 0
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
    while todo:
        idx, parent, side = todo.pop()
        number = None
        if len(idx) > leaf:
            plane = rng.standard_normal(x.shape[1])
            plane /= np.linalg.norm(plane)
            p = np.einsum("ij,j->i", x[idx], plane)
            mid = np.partition(p, [len(p) // 2 - 1, len(p) // 2])
            cut = float(mid[len(p) // 2 - 1] + mid[len(p) // 2]) / 2  # between two vectors, on neither
            right = p >= cut
            if 0 < right.sum() < len(idx):
                number = len(cuts)
                planes.append(plane)
                cuts.append(cut)
                below.append([0, 0])
                todo += [(idx[~right], number, 0), (idx[right], number, 1)]
        if number is None:
            number, leaves = -1 - leaves, leaves + 1
        if parent >= 0:
            below[parent][side] = number
    return Tree(np.array(planes).reshape(len(cuts), x.shape[1]), np.array(cuts), np.array(below, dtype=np.int64).reshape(-1, 2), leaves)


@dataclass
class Forest:
    trees: list[Tree]
    budget: int  # leaves that a search opens

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Row by tree, the leaf."""
        return np.stack([t.leaf_of(x) for t in self.trees], axis=1)

    def opened(self, x: np.ndarray, budget: int | None = None) -> Iterator[list[tuple[int, int]]]:
        """For each row, (tree, leaf) in the order of the queue."""
        margins = [x @ t.plane.T - t.cut for t in self.trees]
        below = [t.below.tolist() for t in self.trees]
        for i in range(len(x)):
            own = [m[i].tolist() for m in margins]
            queue = [(0.0, k, 0 if len(t.cut) else -1) for k, t in enumerate(self.trees)]
            out: list[tuple[int, int]] = []
            while queue and len(out) < (budget or self.budget):
                behind, k, node = heapq.heappop(queue)
                while node >= 0:
                    m = own[k][node]
                    near = m >= 0
                    # squared distances to the planes on the way, summed
                    heapq.heappush(queue, (behind + m * m, k, below[k][node][not near]))
                    node = below[k][node][near]
                out.append((k, -1 - node))
            yield out


def nearest(q: np.ndarray, c: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance) of each query's ``k`` nearest rows of ``c``, nearest first; ``order`` settles ties."""
    near = (q * q).sum(1)[:, None] - 2 * (q @ c.T) + (c * c).sum(1)[None, :]
    k = min(k, len(c))
    edge = np.partition(near, k - 1, axis=1)[:, k - 1]
    # the product rounds; what may be among the k nearest is measured exactly
    slack = 1e-9 * ((q * q).sum(1) + (c * c).sum(1).max())
    i, j = np.nonzero(near <= (edge + slack)[:, None])
    d = np.sqrt(((q[i] - c[j]) ** 2).sum(1))
    by = np.lexsort((order[j], d, i))
    i, j, d = i[by], j[by], d[by]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], d[place < k]


def fit(sample: np.ndarray, k: int = K, trees: int = TREES, leaf: int = LEAF, target: float = TARGET, asked: int = ASKED, seed: int = SEED) -> Forest:
    """A forest over the sample, and the budget that finds ``target`` of the ``k`` nearest within it."""
    rng = np.random.default_rng(seed)
    forest = Forest([grow(sample, leaf, rng) for _ in range(trees)], trees)
    n = len(sample)
    if n <= k + 1:
        forest.budget = sum(t.leaves for t in forest.trees)
        return forest
    at = rng.permutation(n)[:asked]
    leaves, first = forest.leaves_of(sample), []
    q, c, _ = nearest(sample[at], sample, np.arange(n), k + 1)
    for i, way in enumerate(forest.opened(sample[at], sum(t.leaves for t in forest.trees))):
        place = {x: p for p, x in enumerate(way)}
        for j in c[q == i].tolist():
            if j != at[i]:
                first.append(min(place[(t, leaf)] for t, leaf in enumerate(leaves[j].tolist())))
    forest.budget = int(np.sort(first)[min(len(first) - 1, int(np.ceil(target * len(first))) - 1)]) + 1
    return forest


def _matrix(col: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of doubles; shorter vectors as if zeros followed."""
    sizes = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(col), dim))
    out[np.repeat(np.arange(len(col)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _visits(vectors: DataFrame, forest: Forest, dim: int, searching: bool) -> DataFrame:
    """``vid, tree, leaf`` of each vector: its own leaf in every tree, or the leaves that its search opens."""
    shared = vectors.sparkSession.sparkContext.broadcast(forest)  # SAMPLE / LEAF * TREES directions at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, CELL_QUERIES):
                b = whole.slice(at, CELL_QUERIES)
                x, vid = _matrix(b.column("vec"), dim), b.column("vid").to_numpy(zero_copy_only=False)
                if searching:
                    ways = list(f.opened(x))
                    rows, pairs = np.repeat(vid, [len(w) for w in ways]), np.array([p for w in ways for p in w], dtype=np.int64).reshape(-1, 2)
                    tree, leaf = pairs[:, 0], pairs[:, 1]
                else:
                    own = f.leaves_of(x)
                    rows, tree, leaf = np.repeat(vid, own.shape[1]), np.tile(np.arange(own.shape[1]), len(x)), own.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(tree, pa.int32()), pa.array(leaf, pa.int32())], names=["vid", "tree", "leaf"])

    return vectors.select("vid", "vec").mapInArrow(run, "vid long, tree int, leaf int")


def usable(vec: str) -> Column:
    """True for vectors that take part: no null or non-finite component, and not all zero."""
    whole = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(whole & F.exists(vec, lambda x: x != 0), F.lit(False))


def search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, sample: int = SAMPLE,
           trees: int = TREES, leaf: int = LEAF, target: float = TARGET) -> DataFrame:
    """Each query row's ``k`` nearest other rows among the leaves that its search opens.

    Returns ``query_id, rank`` (from 1), the candidate's id under ``id_col``, and ``score`` (Euclidean distance of the vectors as stored, in double
    precision); all candidates found if there are fewer than ``k``.  Ties go to the smaller id, null ids last.

    ``is_query`` is a condition on the rows of ``rows`` (null: no query).  Null and empty vectors, zero vectors and vectors with null or non-finite components take no
    part.  Vectors of different lengths meet as if zeros followed.  Repeated rows are rows of their own: a query row's own row
    is left out, a repetition of it is not.  An empty table gives an empty result.  Other columns are not read.
    """
    t = Scratch(rows.sparkSession, "ann")
    src = t.put(rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable("vec")))
    # of equal vectors the k + 1 smallest ids are enough: Spark cuts to them before it shuffles
    order = [F.col("id").asc_nulls_last()]
    least = src.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy(*order))).where(F.col("r") <= k + 1)
    held = F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"])
    one = least.groupBy("vec").agg(held.alias("ids"))
    vectors = t.put(t.put(one).withColumn("vid", F.monotonically_increasing_id()))  # stored at once, so that numbers stay
    asking = t.put(src.where("asks").select("vec").distinct().join(vectors.select("vec", "vid"), "vec"))
    n, dim = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    share = min(1.0, sample / max(n, 1))
    chosen = vectors.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec").toArrow()  # about `sample` rows
    x = _matrix(chosen.column("vec").combine_chunks(), dim) if chosen.num_rows else np.zeros((0, dim))
    forest = fit(x[np.lexsort(x.T)] if dim else x, k, trees, leaf, target)  # sorted, so that reruns agree

    inside = t.put(_visits(vectors, forest, dim, False))
    wanted = t.put(_visits(asking, forest, dim, True))
    # a leaf is cut into cells of bounded size: candidates by p, queries by q; one row per leaf of the forest
    sizes = inside.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("rows")).join(
        wanted.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("queries")), ["tree", "leaf"]).select(
        "tree", "leaf", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("np"), F.ceil(F.col("queries") / CELL_QUERIES).cast("int").alias("nq"))
    sizes = F.broadcast(t.put(sizes))
    part = lambda n: F.pmod(F.xxhash64("vid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cand = (inside.join(sizes, ["tree", "leaf"]).select("vid", "tree", "leaf", part("np").alias("p"), every("nq").alias("q"))
            .join(vectors.select("vid", "vec", F.col("ids")[0].alias("id")), "vid"))
    asks = wanted.join(sizes, ["tree", "leaf"]).select("vid", "tree", "leaf", every("np").alias("p"), part("nq").alias("q")).join(asking, "vid").drop("ids")

    def meet(asked: pa.Table, found: pa.Table) -> pa.Table:
        # ids order ties; a null one stands last
        rank = np.argsort(pc.array_sort_indices(found.column("id").combine_chunks()).to_numpy())
        c, out = _matrix(found.column("vec").combine_chunks(), dim), []
        q = _matrix(asked.column("vec").combine_chunks(), dim)
        for s in range(0, len(q) if len(c) else 0, 128):
            i, j, d = nearest(q[s:s + 128], c, rank, k + 1)
            out.append((i + s, j, d))
        i, j, d = (np.concatenate([o[x] for o in out]) if out else np.zeros(0, np.int64) for x in range(3))
        return pa.table({"qid": asked.column("vid").take(pa.array(i)), "vid": found.column("vid").take(pa.array(j)),
                         "id": found.column("id").take(pa.array(j)), "d": pa.array(d, pa.float64())})

    cell = ["tree", "leaf", "p", "q"]
    kind = src.schema["id"].dataType.simpleString()
    met = asks.groupBy(*cell).cogroup(cand.groupBy(*cell)).applyInArrow(meet, f"qid long, vid long, id {kind}, d double")
    # a vector found through several trees is one: equal rows share a rank, and each task keeps the best it has
    best = Window.partitionBy("qid").orderBy("d", F.col("id").asc_nulls_last(), "vid")
    top = met.withColumn("r", F.dense_rank().over(best)).where(F.col("r") <= k + 1).select("qid", "vid", "d").distinct()
    # the ids of equal vectors, and the queries of equal vectors
    full = t.put(top.join(vectors.select("vid", "ids"), "vid").select("qid", "d", F.posexplode("ids").alias("n", "id")))
    firsts = Window.partitionBy("qid").orderBy("d", F.col("id").asc_nulls_last(), "n")
    lists = full.withColumn("r", F.row_number().over(firsts)).where(F.col("r") <= k + 1).groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("r", "id", "d"))).alias("found"))
    answers = t.put(asking.select(F.col("vid").alias("qid"), "vec").join(lists, "qid").select("vec", "found"))
    queries = src.where("asks").select(F.col("id").alias("query_id"), "vec")
    # one entry at distance 0 with the query's id is its own row
    own = F.array_position(F.transform("found", lambda x: (x["d"] == 0) & x["id"].eqNullSafe(F.col("query_id"))), True)
    others = F.filter("found", lambda x, i: i + 1 != F.when(own > 0, own).otherwise(k + 1))
    return queries.join(answers, "vec").select("query_id", F.posexplode(others).alias("r", "x")).where(F.col("r") < k).select(
        "query_id", (F.col("r") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.d").alias("score"))
