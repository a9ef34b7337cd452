"""Exact removal of repeated 50-byte strings by a distributed merge sort of suffixes.

Whether a string of ``LENGTH`` bytes repeats is decided on sorted suffixes, but only those that
start at *anchors* are sorted: every window of 50 bytes holds 27 substrings of 24 bytes, and the one
with the least hash (leftmost among equals) is the window's anchor. Equal windows have equal anchors
at equal distances, so two equal windows always meet at their anchor. Successive windows with one
anchor form one element: the suffix from the anchor on, followed by the reversed bytes before it.

1. Documents are packed into compressed runs, written once to the shared folder.
2. A first exchange finds the anchors that more than one document has (hashes only, a superset).
3. Each run sorts its elements, drops equal ones keeping the least doc_id, front-codes them (length of
   the prefix shared with the one before, then the rest) and deals them out by anchor. A loser tree
   merges the runs of a bucket; it knows how long a prefix every contender shares with the last
   output, and compares bytes only behind it. Elements that share an anchor come out together, and
   for each of their windows the least doc_id is found and sent back to the run.
4. Each run marks the windows that a smaller doc_id has, and hashes what is left.

An anchor that very many documents have is dealt out window by window, so that no task gets all of
them. Equal strings within a run are exchanged once, so an exact copy costs one entry a run.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, rows_of, slices, utf8, words8

LENGTH, KMER = 50, 24
WIDE = LENGTH - KMER + 1
WIDTH = LENGTH + WIDE - 1
RUN_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20
#: An anchor in so many documents is dealt out window by window.
HOT = 4096
NO_ID = np.iinfo(np.int64).max
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _pack(a) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype)


def pack_runs(batches):
    """(doc_id, text) batches into rows of some MB: ids, lengths and compressed bytes."""
    part, n, ids, nulls, lens, data, held = TaskContext.get().partitionId(), 0, [], [], [], [], 0

    def row():
        blob = zstandard.compress(b"".join(data), 1)
        return pa.RecordBatch.from_pydict({"run": pa.array([(part << 32) | n], pa.int64()), "ids": [np.concatenate(ids).tobytes()], "nulls": [np.concatenate(nulls).tobytes()], "lens": [np.concatenate(lens).tobytes()], "bytes": pa.array([sum(map(len, data))], pa.int64()), "data": [blob]})

    for batch in batches:
        raw, at = utf8(batch.column("text"))
        none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        key = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in slices(at, 1 << 20):
            ids.append(key[i:j])
            nulls.append(none[i:j])
            lens.append(np.diff(at[i : j + 1]))
            data.append(raw[at[i] : at[j]].tobytes())
            held += len(data[-1])
            if held >= RUN_BYTES:
                yield row()
                n, ids, nulls, lens, data, held = n + 1, [], [], [], [], 0
    if ids:
        yield row()


def _anchors(raw: np.ndarray, offsets: np.ndarray):
    """Elements of a run: anchor hash, row, anchor position, first and last window start."""
    out = []
    for i, j in slices(offsets, 1 << 20):
        data, ends = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(data) < LENGTH:
            continue
        w = words8(data)
        h = w[: len(data) - KMER + 1] * _A + w[8 : len(data) - KMER + 9] * _B + w[16 : len(data) - KMER + 17] * _C
        h = mix(h)
        m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[: len(data) - LENGTH + 1], m[WIDE - 16 : WIDE - 16 + len(data) - LENGTH + 1])
        anchor = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lens = np.diff(ends)
        row = np.repeat(np.arange(j - i), np.maximum(lens - LENGTH + 1, 0))
        if not len(row):
            continue
        start = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(lens - LENGTH + 1, 0)) - np.maximum(lens - LENGTH + 1, 0), np.maximum(lens - LENGTH + 1, 0)) + ends[row]
        a = anchor[start]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (row[1:] != row[:-1])])
        last = np.r_[new[1:], len(a)] - 1
        out.append((mix(h[a[new]] ^ _B), row[new] + i, a[new] + offsets[i], start[new] + offsets[i], start[last] + offsets[i]))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Run:
    """A run opened for reading: bytes, offsets, elements and their unique anchors by bucket."""

    def __init__(self, r: dict, buckets: int):
        self.ids, lens = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["lens"], np.int64)
        self.raw = np.frombuffer(zstandard.decompress(r["data"]), np.uint8) if r["bytes"] else np.zeros(0, np.uint8)
        self.offsets = np.r_[0, np.cumsum(lens)]
        h, self.row, self.p, self.s0, self.s1 = _anchors(self.raw, self.offsets)
        self.bucket = (h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        key = (self.bucket << np.uint64(32)) | (h >> np.uint64(32))
        order = np.argsort(key, kind="stable")
        k, d = key[order], self.row[order]
        first = np.r_[True, k[1:] != k[:-1]][: len(k)]
        self.at = np.empty(len(k), np.int64)  # of each element, its place among the unique anchors
        self.at[order] = np.cumsum(first) - 1
        own = np.flatnonzero(first)
        docs = np.add.reduceat((first | np.r_[True, d[1:] != d[:-1]][: len(k)]).astype(np.int64), own) if len(own) else own
        self.keys, self.docs = k[own], np.minimum(docs, 255).astype(np.uint8)
        self.cuts = np.searchsorted(self.keys >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))

    def elements(self, verdicts: list, buckets: int):
        """Sorted distinct elements that may repeat: their matrix, lengths, right lengths, bucket, least doc_id, and the occurrences (element, row, anchor)."""
        v = np.zeros(len(self.keys), np.uint8)
        for x in verdicts or []:
            b = x["bucket"]
            v[self.cuts[b] : self.cuts[b + 1]] = _unpack(x["verdict"], np.uint8)
        mine = v[self.at] if len(self.at) else v
        one, hot = np.flatnonzero(mine == 1), np.flatnonzero(mine == 2)
        row, p, lo, hi, bucket = self.row[one], self.p[one], self.p[one] - self.s1[one], self.p[one] - self.s0[one], self.bucket[one].astype(np.int64)
        if len(hot):
            n = self.s1[hot] - self.s0[hot] + 1
            o = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.p[hot] - self.s1[hot], n)
            row, p, lo, hi = np.r_[row, np.repeat(self.row[hot], n)], np.r_[p, np.repeat(self.p[hot], n)], np.r_[lo, o], np.r_[hi, o]
            bucket = np.r_[bucket, np.full(len(o), -1)]
        if not len(p):
            return None
        right, length = LENGTH - lo, LENGTH - lo + hi
        m = np.zeros((len(p), 80), np.uint8)
        c = np.arange(WIDTH)
        for i in range(0, len(p), 1 << 16):
            s = slice(i, i + (1 << 16))
            back = c[None] - right[s, None]
            at = np.where(back < 0, p[s, None] + c[None], p[s, None] - 1 - back)
            m[s, :WIDTH] = np.where(c[None] < length[s, None], self.raw[np.clip(at, 0, len(self.raw) - 1)], 0)
        if len(hot):
            x = np.flatnonzero(bucket < 0)
            w = m[x].view("<u8").reshape(len(x), 10)
            g = np.zeros(len(x), np.uint64)
            for k in range(10):
                g = mix(g + w[:, k] + np.uint64(k))
            bucket[x] = (mix(g ^ right[x].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        w = m.view(">u8").reshape(len(m), 10)
        order = np.lexsort((self.ids[row], right, length, *(w[:, k] for k in range(9, -1, -1)), bucket))
        m, right, length, bucket, row, p = m[order], right[order], length[order], bucket[order], row[order], p[order]
        new = np.r_[True, (m[1:] != m[:-1]).any(1) | (right[1:] != right[:-1]) | (length[1:] != length[:-1]) | (bucket[1:] != bucket[:-1])]
        own = np.flatnonzero(new)
        return m[own], length[own], right[own], bucket[own], self.ids[row][own], (np.cumsum(new) - 1, row, p)


def _ask(buckets: int):
    def f(batches):
        for r in rows_of(batches):
            run = _Run(r, buckets)
            out = {"bucket": [], "run": [], "keys": [], "docs": []}
            for b in np.flatnonzero(np.diff(run.cuts)).tolist():
                i, j = run.cuts[b], run.cuts[b + 1]
                out["bucket"].append(b)
                out["run"].append(r["run"])
                out["keys"].append(run.keys[i:j].astype(np.uint32).tobytes())
                out["docs"].append(_pack(run.docs[i:j]))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int64()), ("run", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())]))

    return f


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: 0 for anchors that one document has, 1 if more, 2 if very many."""
    keys = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    docs = [_unpack(x, np.uint8) for x in table.column("docs").to_pylist()]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(docs), minlength=len(every))
    v = np.where(total >= HOT, 2, np.where(total > 1, 1, 0)).astype(np.uint8)[where]
    cut = np.cumsum([len(x) for x in keys])[:-1]
    return pa.table({"run": table.column("run"), "bucket": table.column("bucket"), "verdict": pa.array([_pack(x) for x in np.split(v, cut)], pa.binary())})


def _front_code(buckets: int):
    def f(batches):
        for r in rows_of(batches):
            found = _Run(r, buckets).elements(r["verdicts"], buckets)
            if found is None:
                continue
            m, length, right, bucket, least, _ = found
            same = np.zeros(len(m), np.int64)
            if len(m) > 1:
                differ = m[1:] != m[:-1]
                same[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), 80), np.minimum(length[1:], length[:-1]))
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            out = {"bucket": [], "run": [], "head": [], "ids": [], "rest": []}
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                i, j = cuts[b], cuts[b + 1]
                shared = same[i:j].copy()
                shared[0] = 0
                col = np.arange(80)[None]
                rest = m[i:j][(col >= shared[:, None]) & (col < length[i:j, None])]
                out["bucket"].append(b)
                out["run"].append(r["run"])
                out["head"].append(_pack(np.stack([shared, length[i:j], right[i:j]]).astype(np.uint8)))
                out["ids"].append(_pack(least[i:j]))
                out["rest"].append(_pack(rest))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int64()), ("run", pa.int64()), ("head", pa.binary()), ("ids", pa.binary()), ("rest", pa.binary())]))

    return f


def _read_run(head: bytes, rest: bytes):
    """Front-coded elements in order: (string, right length, bytes shared with the one before)."""
    shared, length, right = _unpack(head, np.uint8).reshape(3, -1).tolist()
    raw, at, s = zstandard.decompress(rest) if rest else b"", 0, b""
    for n, total, r in zip(shared, length, right, strict=True):
        s = s[:n] + raw[at : at + total - n]
        at += total - n
        yield s, r, n


def merge(runs: list):
    """Loser tree over sorted runs of (string, right, shared): yields (run number, string, right, bytes shared with the output before).

    Every contender carries how many bytes it shares with the last output; the longer share wins
    unseen, and only equal shares lead to a comparison, of the bytes behind it.
    """
    k = len(runs)
    heads: list = [next(r, None) for r in runs]
    share = [0] * k
    tree = [-1] * k

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None and x is not None
        if share[a] != share[b]:
            return share[a] > share[b]
        n, s, t = share[a], x[0], y[0]
        if s == t:
            won = x[1] <= y[1]
            n = len(s)
        else:
            top = min(len(s), len(t))
            while n < top and s[n] == t[n]:
                n += 1
            won = n == len(s) or n < len(t) and s[n] < t[n]
        share[b if won else a] = n
        return won

    for i in range(k):  # each leaf climbs until it meets an empty node
        w, node = i, (i + k) // 2
        while node:
            if tree[node] < 0:
                tree[node] = w
                w = -1
                break
            if beats(tree[node], w):
                tree[node], w = w, tree[node]
            node //= 2
        if w >= 0:
            tree[0] = w
    w = tree[0]
    while heads[w] is not None:
        s, right, _ = heads[w]
        yield w, s, right, share[w]
        nxt = heads[w] = next(runs[w], None)
        share[w] = nxt[2] if nxt else 0
        node = (w + k) // 2
        while node:
            c = tree[node]
            if not beats(w, c):
                tree[node], w = w, c
            node //= 2


def _least(group: list) -> list[list[int]]:
    """group: (string, right, least doc_id) distinct elements of one anchor. For each, the least doc_id of each of its windows."""
    best: dict = {}
    for s, right, d in group:
        for o in range(LENGTH - right, len(s) - right + 1):
            w = (s[: LENGTH - o], s[right : right + o])
            if best.get(w, NO_ID) >= d:
                best[w] = d
    return [[best[s[: LENGTH - o], s[right : right + o]] for o in range(LENGTH - right, len(s) - right + 1)] for s, right, _ in group]


def _merge_bucket(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    ids = [_unpack(r["ids"], np.int64).tolist() for r in rows]
    sizes = [_unpack(r["head"], np.uint8).reshape(3, -1).astype(np.int64) for r in rows]
    counts = [x[1] - LENGTH + 1 for x in sizes]
    reply = [np.repeat(np.array(d, np.int64), c) for d, c in zip(ids, counts, strict=True)]
    starts = [(np.cumsum(c) - c).tolist() for c in counts]
    at = [0] * len(rows)
    group, places = [], []  # distinct elements of an anchor; where each stands in the runs

    def settle():
        if len(group) > 1:
            for found, where in zip(_least(group), places, strict=True):
                for run, i in where:
                    reply[run][starts[run][i] : starts[run][i] + len(found)] = found
        elif len(places[0]) > 1:
            s, right, d = group[0]
            for run, i in places[0]:
                reply[run][starts[run][i] : starts[run][i] + len(s) - LENGTH + 1] = d

    before = None
    for run, s, right, share in merge([_read_run(r["head"], r["rest"]) for r in rows]):
        i = at[run]
        at[run] = i + 1
        d = ids[run][i]
        if before is None or share < KMER:
            if group:
                settle()
            group, places = [], []
        elif share == len(s) == len(before[0]) and right == before[1]:
            places[-1].append((run, i))
            if d < group[-1][2]:
                group[-1] = (s, right, d)
            continue
        group.append((s, right, d))
        places.append([(run, i)])
        before = (s, right)
    if group:
        settle()
    return pa.table({"run": table.column("run"), "bucket": table.column("bucket"), "least": pa.array([_pack(x) for x in reply], pa.binary())})


def _resolve(buckets: int):
    def f(batches):
        for r in rows_of(batches):
            run = _Run(r, buckets)
            cover = np.zeros(len(run.raw) + 1, np.int32)
            found = run.elements(r["verdicts"], buckets)
            if found is not None:
                _, length, right, _, least, (elem, row, p) = found
                n = length - LENGTH + 1
                least = np.repeat(least, n)
                base = np.cumsum(n) - n
                replies = sorted((x["bucket"], x["least"]) for x in r["replies"] or [])
                if replies:
                    least = np.concatenate([_unpack(x, np.int64) for _, x in replies])
                for i in range(0, len(elem), 1 << 18):
                    e = elem[i : i + (1 << 18)]
                    k = n[e]
                    j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    o = j + np.repeat(LENGTH - right[e], k)
                    hit = least[np.repeat(base[e], k) + j] < np.repeat(run.ids[row[i : i + (1 << 18)]], k)
                    s = (np.repeat(p[i : i + (1 << 18)], k) - o)[hit]
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + LENGTH, -1)
            gone = np.cumsum(cover[:-1]) > 0
            out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            nulls = np.frombuffer(r["nulls"], np.uint8)
            for k, d in enumerate(run.ids.tolist()):
                a, b = run.offsets[k], run.offsets[k + 1]
                g = gone[a:b]
                out["doc_id"].append(None if nulls[k] else d)
                out["n_bytes"].append(int(b - a))
                out["n_removed"].append(int(g.sum()))
                out["n_spans"].append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
                out["kept_sha256"].append(hashlib.sha256(run.raw[a:b][~g].tobytes()).hexdigest())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return f


RUN_SCHEMA = "run long, ids binary, nulls binary, lens binary, bytes long, data binary"
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame) -> DataFrame:
    """Per document, what is left without each byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    Null or empty texts have no bytes. A null doc_id ranks with the largest possible one, after every other. Rows that repeat a
    doc_id are not compared with one another. Columns other than doc_id and text are not read.
    """
    runs = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack_runs, RUN_SCHEMA), "suffix-runs")
    total = runs.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(12, -(-total // BUCKET_BYTES))
    asked = runs.mapInArrow(_ask(buckets), "bucket long, run long, keys binary, docs binary")
    verdicts = asked.groupBy("bucket").applyInArrow(_count, "run long, bucket long, verdict binary")
    verdicts = materialize(verdicts.groupBy("run").agg(F.collect_list(F.struct("bucket", "verdict")).alias("verdicts")), "suffix-verdicts")
    held = runs.join(verdicts, "run", "left")
    coded = held.mapInArrow(_front_code(buckets), "bucket long, run long, head binary, ids binary, rest binary")
    merged = coded.groupBy("bucket").applyInArrow(_merge_bucket, "run long, bucket long, least binary")
    replies = materialize(merged.groupBy("run").agg(F.collect_list(F.struct("bucket", "least")).alias("replies")), "suffix-replies")
    return held.join(replies, "run", "left").mapInArrow(_resolve(buckets), RESULT_SCHEMA)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document's bytes; see :func:`dedup`."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: 50 bytes are 100 hexadecimal digits of the text. Takes 24 s for the 1000 documents at scale 0.01.
OP3_SQL = r"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT *, unnest(range(0, len(h) // 2 - 49)) AS i FROM b)),
f AS (SELECT w, min(doc_id) AS least FROM s GROUP BY w HAVING min(doc_id) < max(doc_id)),
m AS (SELECT r, i FROM s JOIN f USING (w) WHERE least < doc_id),
k AS (SELECT r, i, coalesce(i > lag(i) OVER o + 50, true) AS new FROM m WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, sum(CAST(new AS INT)) OVER (PARTITION BY r ORDER BY i) AS run FROM k),
x AS (SELECT r, run, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY r, run),
y AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM x),
d AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(z) AS z FROM y JOIN b USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * z + 1), h))) AS kept_sha256
FROM b LEFT JOIN d USING (r)
"""
