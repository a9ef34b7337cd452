"""Near-duplicate join: MinHash LSH forest with exact verification of word-shingle Jaccard similarity.

1. Texts with equal sets of five-word shingles collapse into one node (its digest), with a weight.
2. Every node has a MinHash label in each of ``TREES`` prefix tries. Matched prefixes are shortened
   from the full label until two sets at the threshold meet in some trie with the target recall; that
   depth follows from the target and the number of tries, so it is the same for all nodes, and only
   the minima of that prefix are computed. Nodes that share a prefix are sorted next to one another.
3. A pair is examined in the first trie in which it meets, nowhere else; prefixes with many nodes are
   cut into blocks, and pairs of blocks are tasks of their own. A node whose pairs all met earlier is
   dropped before any shingles move.
4. Each task computes exact similarities of its pairs and passes on, for each node, its number of
   links and one link to its group, not the pairs themselves.
5. Groups grow together by alternating large-star and small-star joins, kept in the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix, shingles, slices, utf8, word_hashes

SHINGLE = 5
#: Similarity of links as a fraction: 4/5.
ABOVE, BELOW = 4, 5
TREES, LABEL, RECALL = 24, 8, 0.9995
#: Nodes of a prefix that one task compares at most with one another; larger prefixes are cut into blocks of about half as many.
BLOCK = 2048
#: Ways in which the rows of one node or group are dealt out where they meet what is known of it.
SALT = 16


def prefix_length(recall: float = RECALL, trees: int = TREES, label: int = LABEL) -> int:
    """The longest prefix with which two sets at the threshold share a trie's prefix somewhere with probability ``recall``."""
    s, depth = ABOVE / BELOW, label
    while depth > 1 and 1 - (1 - s**depth) ** trees < recall:
        depth -= 1
    return depth


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n], x[n:] | np.uint64(1)


def sets(raw: np.ndarray, offsets: np.ndarray):
    """Sorted distinct shingle hashes of all rows and the rows' offsets in them."""
    h, row = shingles(*word_hashes(raw, offsets), SHINGLE)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(offsets)))


def _node(h: np.ndarray) -> bytes | None:
    return hashlib.md5(h.tobytes()).digest() if len(h) else None


def labels(h: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """A key for each row and trie: hashes of the first ``depth`` minima of its label."""
    xor, times = _seeds(TREES * LABEL)
    full = np.flatnonzero(cut[1:] > cut[:-1])
    out = np.zeros((len(cut) - 1, TREES), np.uint64)
    if not len(full):
        return out
    for t in range(TREES):
        key = np.zeros(len(full), np.uint64)
        for k in range(t * LABEL, t * LABEL + depth):
            key = mix(key + np.minimum.reduceat((h ^ xor[k]) * times[k], cut[full]))
        out[full, t] = key
    return out


def _sketch(depth: int):
    def f(batches):
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            node, size, keys = [], [], []
            for i, j in slices(at, 1 << 20):
                h, cut = sets(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                node += [_node(h[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                size.append(np.diff(cut))
                keys.append(labels(h, cut, depth))
            flat = np.concatenate(keys).view(np.int64).ravel() if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(node) + 1, dtype=np.int32) * TREES, pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(node, pa.binary()), pa.array(np.concatenate(size) if size else [], pa.int64()), lists], names=["doc_id", "h", "node", "size", "keys"])

    return f


def _groups(batches, key: list[str]):
    """Tables of successive rows with equal keys, from sorted batches."""
    held: list = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in key]
        new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]
        starts = np.flatnonzero(new)
        if last is not None and tuple(c[0] for c in cols) == last:
            starts = starts[1:]
        elif held:
            yield pa.Table.from_batches(held)
            held = []
        last = tuple(c[-1] for c in cols)
        edge = [0, *starts[starts > 0].tolist(), b.num_rows]
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            if x and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(t: pa.Table) -> np.ndarray:
    """Which pairs of a task's nodes (upper triangle) it has to compare: those that meet here first and whose sizes allow the threshold."""
    n = t.num_rows
    keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(n, TREES)
    tree, bi, bj = (t.column(c)[0].as_py() for c in ("tree", "bi", "bj"))
    size, block = t.column("size").to_numpy(), t.column("block").to_numpy()
    m = keys[:, None, tree] == keys[None, :, tree]
    m &= np.arange(n)[:, None] < np.arange(n)[None]
    if bi != bj:
        m &= block[:, None] != block[None]
    m &= (size[:, None] * BELOW >= size[None] * ABOVE) & (size[None] * BELOW >= size[:, None] * ABOVE)
    for k in range(tree):
        m &= keys[:, None, k] != keys[None, :, k]
    return m


TASK = ["bucket", "bi", "bj"]


def _prune(batches):
    for t in _groups(batches, TASK):
        if t.num_rows > 1:
            m = _pairs(t)
            need = m.any(0) | m.any(1)
            if need.any():
                yield from t.filter(pa.array(need)).to_batches()


def _verify(batches):
    for t in _groups(batches, TASK):
        if t.num_rows < 2:
            continue
        m = _pairs(t)
        x, y = np.nonzero(m)
        if not len(x):
            continue
        data = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        size = np.array([len(s) for s in data])
        inter = _intersections(data, x, y)
        link = inter * BELOW >= ABOVE * (size[x] + size[y] - inter)
        x, y = x[link], y[link]
        if not len(x):
            continue
        weight = t.column("weight").to_numpy()
        links = np.zeros(t.num_rows, np.int64)
        np.add.at(links, x, weight[y])
        np.add.at(links, y, weight[x])
        root = np.arange(t.num_rows)
        while True:  # the least row number spreads over the links
            before = root.copy()
            np.minimum.at(root, x, root[y])
            np.minimum.at(root, y, root[x])
            root = root[root]
            if (root == before).all():
                break
        node = t.column("node").to_pylist()
        has = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in has], pa.binary()), pa.array([node[root[i]] for i in has], pa.binary()), pa.array(links[has])], names=["node", "peer", "links"])


def _intersections(data: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at x and y."""
    every, place = np.unique(np.concatenate(data), return_inverse=True)
    cut = np.r_[0, np.cumsum([len(s) for s in data])]
    df = np.bincount(place, minlength=len(every))
    common = np.flatnonzero(df > 1)
    column = np.full(len(every), -1)
    column[common] = np.arange(len(common))
    if len(x) * np.diff(cut).mean() * 8 < len(data) ** 2 * len(common) * 0.1:  # few pairs: one by one
        out = np.empty(len(x), np.int64)
        mark, last = np.zeros(len(every), bool), -1
        for k, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            if i != last:
                if last >= 0:
                    mark[place[cut[last] : cut[last + 1]]] = False
                mark[place[cut[i] : cut[i + 1]]] = True
                last = i
            out[k] = np.count_nonzero(mark[place[cut[j] : cut[j + 1]]])
        return out
    total = np.zeros((len(data), len(data)), np.float32)
    col, row = column[place], np.repeat(np.arange(len(data)), np.diff(cut))
    for a in range(0, len(common), 4096):
        hit = (col >= a) & (col < a + 4096)
        part = np.zeros((len(data), 4096), np.float32)
        part[row[hit], col[hit] - a] = 1
        total += part @ part.T
    return total[x, y].astype(np.int64)


def _fetch(batches):
    """Shingles of the rows whose set is the wanted node."""
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        wanted = batch.column("node").to_pylist()
        for i, j in slices(at, 1 << 20):
            h, cut = sets(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            rows = [(wanted[i + k], h[cut[k] : cut[k + 1]]) for k in range(j - i)]
            rows = [(w, s.tobytes()) for w, s in rows if _node(s) == w]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.binary())], names=["node", "shingles"])


def _salted(rows: DataFrame, told: DataFrame, key: str, *by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined by ``key`` to ``told``, which has one row a key; rows of a key are dealt out SALT ways by ``by``."""
    many = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALT)).cast("int"))
    return many.join(told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (node, peer); the root is the least node of the component."""
    e = materialize(edges.where("node <> peer").select(F.greatest("node", "peer").alias("u"), F.least("node", "peer").alias("v")).distinct(), "stars")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(e)
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _salted(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _salted(large, least, "u", "v")
        e = materialize(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = state(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("the components did not settle")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of every row of ``docs``.

    n_links counts the other rows at a similarity of at least 0.8; rows with an equal set of shingles
    are linked as well. class_id is the least doc_id that links lead to. Words are lower-cased and
    separated by white space; a text of fewer than five words has one shingle of all its words; null,
    empty and blank texts have no links and are a class of their own. A row without a doc_id is linked
    and counted like any other, and its class_id is null if no row of its class has one. Rows that
    repeat a doc_id are compared like rows of different documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    sketch = materialize(hashed.mapInArrow(_sketch(prefix_length()), "doc_id long, h long, node binary, size long, keys array<long>"), "jaccard-sketch")
    nodes = sketch.where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("owner"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = materialize(nodes, "jaccard-nodes")
    entries = nodes.select("node", F.posexplode("keys").alias("tree", "key")).select("node", "tree", F.xxhash64("tree", "key").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(entries.join(shared, "bucket"), "jaccard-met")
    blocks = F.when(F.col("n") <= BLOCK, 1).otherwise(F.ceil(F.col("n") * 2 / BLOCK)).cast("int")
    met = met.withColumn("nb", blocks).withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("nb")).cast("int"))
    met = met.join(nodes.select("node", "weight", "size", "keys"), "node")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    tasks = met.select("bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "tree", "block", "node", "weight", "size", "keys")
    slim = "bucket long, bi int, bj int, tree int, block int, node binary, weight long, size long, keys array<long>"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = materialize(tasks.repartition(parts, *TASK).sortWithinPartitions(*TASK).mapInArrow(_prune, slim), "jaccard-tasks")
    # shingles of the nodes that are left, each from one row that has them
    wanted = asked.select("node").distinct().join(nodes.select("node", "owner"), "node").select("node", F.col("owner.doc_id").alias("d"), F.col("owner.h").alias("oh"))
    held = hashed.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("oh"))).select("text", "node")
    shingled = materialize(held.mapInArrow(_fetch, "node binary, shingles binary"), "jaccard-shingles")
    if shingled.groupBy("node").count().where("count > 1").limit(1).count():
        shingled = shingled.groupBy("node").agg(F.first("shingles").alias("shingles"))
    full = asked.join(shingled, "node").select(*asked.columns, "shingles")
    found = full.repartition(parts, *TASK).sortWithinPartitions(*TASK).mapInArrow(_verify, "node binary, peer binary, links long")
    found = materialize(found, "jaccard-links")
    roots = components(found.select("node", "peer"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.select("node", "weight", "least").join(links, "node", "left").join(roots, "node", "left")
    told = told.where("weight > 1 OR links IS NOT NULL").withColumn("root", F.coalesce("root", "node"))
    least = told.groupBy("root").agg(F.min("least").alias("class_id"))
    told = _salted(told, least, "root", "node").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = _salted(sketch.select("doc_id", "h", "node"), told.withColumn("known", F.lit(True)), "node", "doc_id", "h", how="left")
    return out.select("doc_id", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, that with the least doc_id. Rows that share a doc_id are one document; rows without one stay."""
    gone = join(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id == F.col("_gone"), "left_anti")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document; see :func:`join`."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common * 5 >= 4 * (x.size + y.size - common)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
k AS (SELECT d, min(c) AS class_id FROM r GROUP BY d),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links FROM documents JOIN k ON k.d = doc_id LEFT JOIN l ON l.a = doc_id
"""
