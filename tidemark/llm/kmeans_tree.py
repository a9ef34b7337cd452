"""Nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample on the driver; every row is then dealt to its leaf. A query
walks the tree with a priority queue, always opening the node whose centre promises the largest
inner product, and collects leaves in that order. How many leaves are visited is calibrated: exact
neighbours of a few queries over all rows show how far the visits must widen for the target recall.
Vectors and queries meet by leaf; leaves with many vectors or many queries are cut into blocks, so a
vector that a third of the rows share does not make one task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Rows the tree is fitted on at most, branches a node, sample rows a leaf.
SAMPLE, BRANCH, LEAF = 65536, 16, 192
#: Queries whose exact neighbours calibrate the visits, and the recall these must reach.
CALIBRATION, RECALL = 256, 0.98
BLOCK = 4096
#: Sampled vectors every query is held against first. The k-th nearest of these is a floor: what lies
#: under it in a leaf cannot be among the k nearest of leaves and seeds together, and is not sent on.
SEEDS = 4096


class Tree:
    """Nodes in one array; ``children`` of a leaf is empty and ``leaf`` numbers the leaves."""

    def __init__(self, sample: np.ndarray, branch: int | None = None, leaf: int | None = None, seed: int = 7):
        self.branch, self.size = branch or BRANCH, leaf or LEAF
        self.center: list = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])]
        self.children: list[list[int]] = [[]]
        rng, todo = np.random.default_rng(seed), [(0, sample)]
        while todo:
            node, x = todo.pop()
            if len(x) <= self.size:
                continue
            label, centers = _kmeans(x, min(self.branch, -(-len(x) // self.size)), rng)
            if len(centers) < 2:
                continue
            for k, c in enumerate(centers):
                self.children[node].append(len(self.center))
                self.center.append(c)
                self.children.append([])
                todo.append((self.children[node][-1], x[label == k]))
        self.center = np.array(self.center)
        self.leaves = [n for n, c in enumerate(self.children) if not c]
        self.leaf = {n: i for i, n in enumerate(self.leaves)}

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest centre at every level."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.center[kids]
            near = ((c * c).sum(1)[None] - 2 * x[rows] @ c.T).argmin(1)
            todo += [(kids[k], rows[near == k]) for k in np.unique(near)]
        return out

    def order(self, q: np.ndarray, enough) -> list[int]:
        """Leaves best bin first until ``enough(leaf)`` says so."""
        promise = self.center @ q
        queue, out = [(-promise[0], 0)], []
        while queue:
            _, node = heapq.heappop(queue)
            for k in self.children[node]:
                heapq.heappush(queue, (-promise[k], k))
            if not self.children[node]:
                out.append(self.leaf[node])
                if enough(self.leaf[node]):
                    break
        return out


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8):
    """Lloyd's rounds from distinct rows; clusters that lose all rows are left out."""
    pool = np.unique(x[rng.permutation(len(x))[: 16 * k]], axis=0)
    c = pool[rng.permutation(len(pool))[:k]]
    for _ in range(rounds):
        label = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(label, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, label, x)
        c = sums[n > 0] / n[n > 0, None]
    label = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
    used = np.unique(label)
    return np.searchsorted(used, label), c[used]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: vectors that are not null, not zero and hold only finite numbers, of the most frequent dimension (of equally frequent ones the larger).

    A null vec_id takes no part. Of rows that repeat a vec_id the least vector counts.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.where(F.size("embedding") == (sizes[0].d if sizes else 0))
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def exact_scores(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of q[i] and v[j], summed in the order of the components, so equal vectors score equally."""
    out = np.zeros(len(i))
    for a, b in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(v.T), strict=True):
        out += a[i] * b[j]
    return out


def best(qid, q, vid, v, k: int, floor: np.ndarray | None = None):
    """Of every query the k largest inner products over ``v``, without its own row: (row of the query, id, score), nearest first.

    Products under a query's ``floor`` may be left out. All queries are worked on at once: rough
    products choose pairs, with room for rounding, and only those are scored exactly.
    """
    rough = q @ v.T
    rough[qid[:, None] == vid[None]] = -np.inf
    floor = np.full(len(q), -np.inf) if floor is None else floor.copy()
    hit = rough >= floor[:, None]
    many = np.flatnonzero(hit.sum(1) > k)
    if len(many):
        last = np.partition(rough[many], len(v) - k, axis=1)[:, len(v) - k]
        floor[many] = np.maximum(floor[many], below(last))
        hit[many] = rough[many] >= floor[many, None]
    i, j = np.nonzero(hit & (rough > -np.inf))
    s = exact_scores(q, v, i, j)
    order = np.lexsort((vid[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], vid[j[keep]], s[keep]


def below(score: np.ndarray) -> np.ndarray:
    """A little less than ``score``, by more than the rounding of a rough product."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(score), score - 1e-9 * (1 + np.abs(score)), -np.inf)


FOUND = pa.struct([("loss", pa.float64()), ("vec_id", pa.int64())])
FOUND_SQL = "query_id long, found array<struct<loss:double,vec_id:long>>"


def _cells(n: int, i, vid, s) -> pa.Array:
    """What each of n queries found, as one list a query."""
    at = np.searchsorted(i, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(-s), pa.array(vid, pa.int64())], fields=list(FOUND)))


def _rows(qid, found) -> pa.RecordBatch:
    """(query_id, found) of the queries that found any."""
    i, vid, s = found
    some, at = np.unique(i, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(qid[some], pa.int64()), _cells(len(some), at, vid, s)], names=["query_id", "found"])


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what each query's blocks found; a vector may be found by a block and among the seeds."""
    near = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, 2 * k)
    every = found.groupBy("query_id").agg(F.slice(F.array_distinct(near), 1, k).alias("found"))
    rows = every.select("query_id", F.posexplode("found").alias("pos", "x"))
    return rows.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("x.loss")).alias("score"))


def brute_force(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """Exact neighbours of a bounded list of (vec_id, vector) over all usable rows."""
    if not queries:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = rows.sparkSession.sparkContext.broadcast((np.array([x for x, _ in queries], np.int64), np.array([x for _, x in queries], np.float64)))

    def f(batches):
        qid, q = sent.value
        for b in batches:
            if b.num_rows:
                yield _rows(qid, best(qid, q, b.column("vec_id").to_numpy(), _matrix(b.column("embedding")), k))

    return _merge(rows.mapInArrow(f, FOUND_SQL), k)


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` (a Column) selects, its k nearest among all other rows.

    Ties go to the smaller vec_id. Rows that do not take part (see :func:`usable`) are neither
    queries nor candidates. Few rows mean a tree of one leaf, so the search is then exact.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "ann-rows")
    n = rows.count()
    part = min(1.0, 1.2 * SAMPLE / max(n, 1))
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1
    sample = rows.where(draw).limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return brute_force(rows, [], k)
    drawn = _matrix(sample.column("embedding"))
    tree = spark.sparkContext.broadcast(Tree(drawn))  # at most 2 SAMPLE / LEAF * BRANCH centres
    seeds = spark.sparkContext.broadcast((sample.column("vec_id").to_numpy()[:SEEDS], drawn[:SEEDS]))
    dealt = rows.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.value.assign(_matrix(b.column("embedding"))) if b.num_rows else [], pa.int64())], names=["vec_id", "embedding", "leaf"]) for b in it), f"vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, leaf long")
    dealt = materialize(dealt, "ann-leaves")
    sizes = {r.leaf: r.n for r in dealt.groupBy("leaf").agg(F.count("vec_id").alias("n")).collect()}  # a row for each leaf
    queries = dealt.where(is_query).select("vec_id", "embedding")
    visits = _calibrate(rows, dealt, queries, tree.value, k)
    walk = spark.sparkContext.broadcast((sizes, visits))

    def route(batches):
        size, most = walk.value
        for b in batches:
            if not b.num_rows:
                continue
            qid, q, leaves = b.column("vec_id").to_numpy(), _matrix(b.column("embedding")), []
            for x in q:
                seen = [0, 0]

                def enough(leaf, seen=seen):
                    seen[0] += 1
                    seen[1] += size.get(leaf, 0)
                    return seen[0] >= most and seen[1] > k

                leaves.append([x for x in tree.value.order(x, enough) if x in size])
            parts = [best(qid[i : i + 256], q[i : i + 256], *seeds.value, k) for i in range(0, len(q), 256)]
            i, vid, s = (np.concatenate(x) for x in zip(*((p[0] + 256 * n, p[1], p[2]) for n, p in enumerate(parts)), strict=True))
            at = np.searchsorted(i, np.arange(len(q) + 1))
            floor = np.full(len(q), -np.inf)
            full = np.flatnonzero(np.diff(at) == k)
            floor[full] = below(s[at[full] + k - 1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves, pa.list_(pa.int64())), pa.array(floor), _cells(len(q), i, vid, s)], names=["vec_id", "embedding", "leaves", "floor", "found"])

    kind = rows.schema["embedding"].dataType.simpleString()
    walked = materialize(queries.mapInArrow(route, f"vec_id long, embedding {kind}, leaves array<long>, floor double, found array<struct<loss:double,vec_id:long>>"), "ann-routed")
    routed = walked.select("vec_id", "embedding", "floor", F.explode("leaves").alias("leaf"))
    asked = {r.leaf: r.n for r in routed.groupBy("leaf").agg(F.count("vec_id").alias("n")).collect()}
    # blocks of a leaf: its vectors by its queries; each row goes to every block of the other side
    cut = spark.createDataFrame([(x, -(-sizes[x] // BLOCK), -(-asked[x] // BLOCK)) for x in asked], "leaf long, vb int, qb int")
    cut = F.broadcast(cut)  # a row for each leaf of the bounded tree
    hashed = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    left = dealt.join(cut, "leaf").withColumns({"v": hashed(F.col("vb")), "q": F.explode(F.sequence(F.lit(0), F.col("qb") - 1))})
    right = routed.join(cut, "leaf").withColumns({"q": hashed(F.col("qb")), "v": F.explode(F.sequence(F.lit(0), F.col("vb") - 1))})

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "found": pa.array([], pa.list_(FOUND))})
        vid, v = a.column("vec_id").to_numpy(), _matrix(a.column("embedding"))
        qid, q, floor = b.column("vec_id").to_numpy(), _matrix(b.column("embedding")), b.column("floor").to_numpy()
        parts = (slice(i, i + 256) for i in range(0, len(qid), 256))
        return pa.Table.from_batches([_rows(qid[p], best(qid[p], q[p], vid, v, k, floor[p])) for p in parts])

    group = ["leaf", "v", "q"]
    found = left.select(*group, "vec_id", "embedding").groupBy(*group).cogroup(right.select(*group, "vec_id", "embedding", "floor").groupBy(*group)).applyInArrow(score, FOUND_SQL)
    return _merge(found.unionByName(walked.select(F.col("vec_id").alias("query_id"), "found")), k)


def _calibrate(rows, dealt, queries, tree: Tree, k: int) -> int:
    """Leaf visits at which the calibration queries find RECALL of their exact neighbours."""
    few = [(r.vec_id, r.embedding) for r in queries.orderBy(F.xxhash64("vec_id")).limit(CALIBRATION).collect()]
    if len(tree.leaves) == 1 or not few:
        return 1
    truth = brute_force(rows, few, k).select("query_id", "vec_id")
    # at most CALIBRATION * k pairs; each is joined to the leaf of its vector
    pairs = F.broadcast(truth).join(dealt.select("vec_id", "leaf"), "vec_id").collect()
    rank = {q: {leaf: i for i, leaf in enumerate(tree.order(np.array(v, np.float64), lambda _: False))} for q, v in few}
    need = sorted(rank[r.query_id][r.leaf] + 1 for r in pairs)
    return need[min(len(need) - 1, int(np.ceil(RECALL * len(need))) - 1)] if need else 1


def op8_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose vec_id is divisible by 20; odd rows as in :func:`search`."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
