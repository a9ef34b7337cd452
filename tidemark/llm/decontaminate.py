"""Benchmark passages in documents: q-gram counts in diagonal bands, then banded alignment.

Texts are compared as code points: lower-case letters and digits, every other run of characters being
one space. Each benchmark item is cut into windows of ``WINDOW`` code points at steps of ``STEP`` (a
shorter item is one window). By the q-gram lemma, a window that aligns with at most e edits keeps at
least ``len + 1 - q (e + 1)`` of its q-grams, all within e diagonals of one another. Matching q-grams
are therefore counted in overlapping bands of diagonals: bands of width 2 (e + 1) at steps of e + 1, of
which one holds any e + 1 successive diagonals. Bands that reach the bound are aligned with a dynamic
program restricted to the band; those within the budget are matches. A verbatim passage of
``WINDOW + STEP`` code points of an item always holds a window whole.

Items of fewer than ``SHORT`` code points say too little for edits to be allowed: they are matched
exactly and as whole words, by hashes of as many code points from each beginning of a word on.

Documents stay where they are. The benchmark is the query set: it is read in blocks of bounded size
and each block visits all documents once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, utf8

Q, WINDOW, STEP, RATE = 8, 80, 20, 0.075
#: Items with fewer code points are matched exactly, as whole words.
SHORT = 32
#: Bytes of benchmark text sent to the executors at once.
BLOCK_BYTES = 4 << 20

SPACE = 32
_MAP = np.arange(1 << 16, dtype=np.uint16)
_MAP[:128] = SPACE
_MAP[48:58] = np.arange(48, 58)
_MAP[97:123] = np.arange(97, 123)


def points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of rows of UTF-8, folded into 16 bits, and the new offsets."""
    lens = np.diff(np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets])
    text = data.tobytes().decode("utf-8", "replace")
    if len(text) != lens.sum():  # damaged text
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        text, lens = "".join(rows), np.array([len(x) for x in rows], np.int64)
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8).astype(np.uint16), np.r_[0, np.cumsum(lens)]
    p = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return ((p ^ (p >> 16)) & 0xFFFF).astype(np.uint16), np.r_[0, np.cumsum(lens)]


def normalize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case UTF-8 rows as code points, with every run of other signs as one space and none at either end."""
    p, offsets = points(data, offsets)
    m = _MAP[p]
    solid = m != SPACE
    before = np.zeros(len(m), bool)
    before[1:] = solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    keep = solid | before  # a space stays behind a letter
    kept = np.r_[0, np.cumsum(keep)]
    cut = kept[offsets]
    out = m[keep]
    last = cut[1:][(cut[1:] > cut[:-1])] - 1
    ends = last[out[last] == SPACE]
    if len(ends):
        out = np.delete(out, ends)
        cut = cut - np.searchsorted(ends, cut)
    return out, cut


def qgrams(p: np.ndarray) -> np.ndarray:
    """Hashes of the Q code points from each place on; len(p) - Q + 1 values."""
    if len(p) < Q:
        return np.zeros(0, np.uint64)
    two = p[:-1].astype(np.uint32) | (p[1:].astype(np.uint32) << np.uint32(16))
    four = two[:-2].astype(np.uint64) | (two[2:].astype(np.uint64) << np.uint64(32))
    return mix(four[:-4] * np.uint64(0x9E3779B97F4A7C15) + four[4:])


_P = np.uint64(0xD6E8FEB86659FD93)


_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def _prefix_hashes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of code points times powers of an odd number up to each place, and these powers."""
    power = np.full(len(p) + 1, _P, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    return np.r_[np.uint64(0), np.cumsum((p.astype(np.uint64) + np.uint64(1)) * power[:-1])], power


def budget(length: int) -> int:
    """Edits allowed in a window of ``length``; never so many that the lemma's bound is below one q-gram."""
    return max(0, min(int(RATE * length), (length - Q) // Q))


class Index:
    """Windows of a block of benchmark items, a sorted table of their q-grams, and the short items."""

    def __init__(self, items: list[tuple[int, str]]):
        """``items`` are lower-case already."""
        windows, self.item = [], []
        self.short: dict[int, list] = {}  # by length: (code points, item)
        for i, text in items:
            raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
            b, _ = normalize(raw, np.array([0, len(raw)]))
            if len(b) < SHORT:
                if len(b):
                    self.short.setdefault(len(b), []).append((b, i))
                continue
            starts = [*range(0, len(b) - WINDOW, STEP), len(b) - WINDOW] if len(b) > WINDOW else [0]
            for s in starts:
                windows.append(b[s : s + WINDOW])
                self.item.append(i)
        self.length = np.array([len(w) for w in windows], np.int64)
        self.text = np.zeros((len(windows), WINDOW), np.uint16)
        for k, w in enumerate(windows):
            self.text[k, : len(w)] = w
        self.edits = np.array([budget(n) for n in self.length], np.int64)
        self.bound = self.length + 1 - Q * (self.edits + 1)
        grams = [qgrams(w) for w in windows]
        g = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(g, kind="stable")
        self.window = np.repeat(np.arange(len(windows), dtype=np.int32), [len(x) for x in grams])[order]
        self.place = np.concatenate([*(np.arange(len(x), dtype=np.int32) for x in grams), np.zeros(0, np.int32)])[order]
        self.grams, first = np.unique(g[order], return_index=True)
        self.cuts = np.r_[first, len(g)]
        self.table = np.zeros(1 << 22, bool)  # a first look before the search in the sorted table
        self.table[self._slot(self.grams)] = True
        self.hashes = {}  # of short items by length: sorted hashes and the items' numbers
        for n, some in self.short.items():
            h = np.array([_prefix_hashes(b)[0][-1] for b, _ in some], np.uint64)
            order = np.argsort(h)
            self.hashes[n] = h[order], order

    def whole(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item, end) of short items that stand in a row as whole words."""
        if not self.short or not len(data):
            return
        begin = np.r_[True, data[:-1] == SPACE]
        begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        at = np.flatnonzero(begin & (data != SPACE))
        row = np.searchsorted(offsets, at, "right") - 1
        sums, _ = _prefix_hashes(data)
        back = np.full(len(data), _INVERSE, np.uint64)  # takes a hash from its place to place 0
        back[0] = 1
        back = np.multiply.accumulate(back)
        for n, (hashes, order) in self.hashes.items():
            k = np.flatnonzero(at + n <= offsets[row + 1])
            k = k[(at[k] + n == offsets[row[k] + 1]) | (data[np.minimum(at[k] + n, len(data) - 1)] == SPACE)]
            h = sums[at[k] + n] - sums[at[k]]
            x = h * back[at[k]]
            lo, hi = np.searchsorted(hashes, x, "left"), np.searchsorted(hashes, x, "right")
            for j in np.flatnonzero(hi > lo):
                a = at[k[j]]
                for o in order[lo[j] : hi[j]]:
                    points_, item = self.short[n][o]
                    if (data[a : a + n] == points_).all():
                        yield int(row[k[j]]), item, int(a + n - offsets[row[k[j]]])

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def bands(self, data: np.ndarray, offsets: np.ndarray):
        """(row, window, band) that hold enough shared q-grams; band b covers diagonals from b (e + 1) on, twice as many."""
        g = qgrams(data)
        at = np.flatnonzero(self.table[self._slot(g)])
        k = np.searchsorted(self.grams, g[at])
        hit = (k < len(self.grams)) & (self.grams[np.minimum(k, len(self.grams) - 1)] == g[at])
        at, k = at[hit], k[hit]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[row + 1]
        at, k, row = at[inside], k[inside], row[inside]
        found = []
        # a q-gram may stand in many windows: matches are counted a part at a time, whole rows together
        n = self.cuts[k + 1] - self.cuts[k]
        for i, j in slices(np.r_[0, np.cumsum(np.bincount(row, weights=n, minlength=len(offsets) - 1).astype(np.int64))], 1 << 20):
            s = slice(*np.searchsorted(row, [i, j]))
            m = n[s]
            if not len(m):
                continue
            e = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.cuts[k[s]], m)
            w = self.window[e]
            d = np.repeat(at[s] - offsets[row[s]], m) - self.place[e] + WINDOW
            b = d // (self.edits[w] + 1)
            pair = np.repeat(row[s] - i, m) * len(self.length) + w.astype(np.int64)
            span = int(offsets[i : j + 1].max() - offsets[i]) + 2 * WINDOW + 2
            key = np.concatenate([pair * span + b, pair * span + b - 1])
            key, count = np.unique(key[key >= 0], return_counts=True)
            pair, b = key // span, key % span
            ok = count >= self.bound[pair % len(self.length)]
            found.append((pair[ok] // len(self.length) + i, pair[ok] % len(self.length), b[ok]))
        if not found:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def align(self, data: np.ndarray, offsets: np.ndarray, row, window, band):
        """Least edits of each window within its band, ends in the document being free, and where the alignment ends."""
        e1 = self.edits[window] + 1
        low = band * e1 - WINDOW - 1  # one diagonal more on either side, for cells at the rim
        wide = int(2 * e1.max() + 3)
        col = np.arange(wide)
        base, size = offsets[row], offsets[row + 1] - offsets[row]
        far = 1 << 20
        # cell (i, c): window code points [0, i) against those of the document ending at low + i + c
        at = low[:, None] + col[None]
        inside = col[None] < (2 * e1 + 3)[:, None]
        cost = np.where(inside & (at >= 0) & (at <= size[:, None]), 0, far)
        best = cost.copy()
        for i in range(1, int(self.length[window].max()) + 1):
            at = low[:, None] + i + col[None]
            ok = inside & (at >= 0) & (at <= size[:, None])
            point = data[np.clip(base[:, None] + at - 1, 0, len(data) - 1)]
            differ = (point != self.text[window, i - 1][:, None]) | (at < 1)
            new = np.minimum(cost + np.where(at < 1, far, differ), np.c_[cost[:, 1:], np.full(len(cost), far)] + 1)
            new = np.where(ok, new, far)
            new = np.minimum.accumulate(new - col, axis=1) + col
            new = np.where(ok, new, far)
            live = (i <= self.length[window])[:, None]
            cost = np.where(live, new, cost)
            best = cost
        end = best.argmin(1)
        return best[np.arange(len(best)), end], low + self.length[window] + end


def find(batches, index: Index):
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        doc = batch.column("doc_id")
        for i, j in slices(at, 2 << 20):
            data, offsets = normalize(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            best: dict = {}

            def note(r, item, window, edits, end, best=best, i=i):
                seen = best.setdefault((r + i, item), [set(), edits, end])
                seen[0].add(window)
                seen[1:] = min((seen[1], seen[2]), (edits, end))

            for r, item, end in index.whole(data, offsets):
                note(r, item, None, 0, end)
            if len(index.length) and len(data) >= Q:
                row, window, band = index.bands(data, offsets)
                for s in range(0, len(row), 4096):
                    p = slice(s, s + 4096)
                    edits, end = index.align(data, offsets, row[p], window[p], band[p])
                    for k in np.flatnonzero(edits <= index.edits[window[p]]):
                        note(int(row[s + k]), index.item[window[s + k]], int(window[s + k]), int(edits[k]), int(end[k]))
            if not best:
                continue
            keys = list(best)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": doc.take(pa.array([r for r, _ in keys], pa.int64())).cast(pa.int64()),
                    "item_id": pa.array([b for _, b in keys], pa.int64()),
                    "n_windows": pa.array([len(best[x][0]) for x in keys], pa.int64()),
                    "edits": pa.array([best[x][1] for x in keys], pa.int64()),
                    "end": pa.array([best[x][2] for x in keys], pa.int64()),
                }
            )


SCHEMA = "doc_id long, item_id long, n_windows long, edits long, end long"


def _blocks(benchmark: DataFrame):
    """Items in blocks of at most BLOCK_BYTES; the bound holds for what is on the driver at a time."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).where("text IS NOT NULL")
    total = sized.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // BLOCK_BYTES))
    for b in range(n):
        yield [tuple(r) for r in (sized if n == 1 else sized.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == b)).collect()]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents that hold a passage of a benchmark item, with the number of its windows found, the least edits and where that window ends in the normalized text.

    Texts and items that are null or hold no letter or digit match nothing; repeated items that share an
    item_id are one item, repeated documents each give rows of their own; a null doc_id or item_id is
    reported as null. A short item counts as one window. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    out = None
    for items in _blocks(benchmark):
        index = spark.sparkContext.broadcast(Index(items))
        part = rows.mapInArrow(lambda b, index=index: find(b, index.value), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold benchmark passages. Rows with a null doc_id stay."""
    bad = matches(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs.doc_id == F.col("_bad"), "left_anti")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items; see :func:`matches`."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
