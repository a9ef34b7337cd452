"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text, and by repetition.

Trusted text is that of documents labelled good. The model runs over n-grams of Unicode code points,
n up to ``ORDER``. Its counts are summed over all trusted text by a shuffle and stay in a table that
is sharded by n-gram; the orders below and the probabilities are joins of such tables.

1. Documents are packed once into compressed batches, written as a bucketed table: whatever is joined
   to a batch later is dealt to its bucket, and the texts are never shuffled.
2. Ids of trusted documents are joined to the batches' ids; batches count the n-grams of these.
3. A batch asks the model table for its distinct n-grams and their suffixes and contexts: an n-gram
   that thousands of its documents hold is asked for once. The answers come back to the batch, which
   adds up the cost of each document.

A word said over and over can be likely under any such model, so the share of a document's word pairs
that it held before is a second measure. A document is rejected if either lies above a quantile of the
trusted documents' in its language. A trusted document's own cost takes n-grams that occur once in all
trusted text as never seen, so that the quantile holds for documents that were not counted, too.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix, scratch, slices, utf8, word_hashes

#: Order of the model and bits of a symbol in an n-gram's number, the last symbol lowest.
ORDER, BITS = 4, 16
#: Size of the alphabet below the lowest order.
ALPHABET = 1 << BITS
#: Quantile of trusted perplexities, by language, and the factor above it from which documents are rejected.
QUANTILE, SLACK = 0.98, 1.1
#: What the share of repeated pairs may lie above its quantile, besides the factor.
REPEAT_SLACK = 0.05
#: Languages with fewer trusted documents are held to the quantile of all.
LEAST_TRUSTED = 20
#: Documents with fewer symbols are judged with that many more of average perplexity.
PRIOR = 40
#: Least discount: the estimates can be zero or less where few counts recur, and a context that leaves
#: nothing to the order below would give an n-gram never seen the probability zero.
LEAST_DISCOUNT = 0.05
#: Bytes and rows of a batch, and bytes that are worked on at once.
BATCH_BYTES, BATCH_ROWS, CHUNK_BYTES = 16 << 20, 1 << 16, 1 << 20
#: Distinct n-grams that a counting task holds before it passes them on.
HELD_GRAMS = 1 << 21

_START, _SHIFT = 1, np.uint64(BITS)
_MASKS = {n: np.uint64((1 << (BITS * n)) - 1) for n in range(1, ORDER + 1)}


# -- batches ---------------------------------------------------------------------------------------

BATCH_SQL = "batch long, ids array<long>, langs array<string>, sizes array<long>, cuts array<int>, chunks array<binary>"
_BATCH = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("cuts", pa.list_(pa.int32())), ("chunks", pa.list_(pa.binary()))])


def _pack(batches):
    """(doc_id, lang, text) rows into batches: ids, languages, bytes of each text, rows of each chunk, compressed chunks."""
    part, n = TaskContext.get().partitionId(), 0
    held: dict = {k: [] for k in ("ids", "langs", "sizes", "cuts", "chunks")}
    total = 0

    def row():
        return pa.RecordBatch.from_pydict({"batch": [(part << 24) | n], **{k: [v] for k, v in held.items()}}, _BATCH)

    for b in batches:
        raw, at = utf8(b.column("text"))
        ids, langs = b.column("doc_id").to_pylist(), b.column("lang").to_pylist()
        for lo in range(0, b.num_rows, BATCH_ROWS):  # a chunk never has more rows than a batch
            hi = min(b.num_rows, lo + BATCH_ROWS)
            for i, j in slices(at[lo : hi + 1], CHUNK_BYTES):
                i, j = i + lo, j + lo
                if held["ids"] and (total + at[j] - at[i] > BATCH_BYTES or len(held["ids"]) + j - i > BATCH_ROWS):
                    yield row()
                    held, n, total = {k: [] for k in held}, n + 1, 0
                held["ids"] += ids[i:j]
                held["langs"] += langs[i:j]
                held["sizes"] += np.diff(at[i : j + 1]).tolist()
                held["cuts"].append(j - i)
                held["chunks"].append(zstandard.compress(raw[at[i] : at[j]].tobytes(), 3))
                total += at[j] - at[i]
    if held["ids"]:
        yield row()


def pack(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, lang, text) as a table of batches bucketed by batch; null texts are empty, ids and languages may be null."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_pack, BATCH_SQL)
    name = f"lm_batches_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "batch").option("path", scratch(spark, "lm-batches")).option("compression", "none").format("parquet").saveAsTable(name)
    return spark.table(name)


def _open(sizes: list, cuts: list, chunks: list):
    """(first row, rows, bytes, offsets) of each chunk of a batch."""
    sizes, row = np.array(sizes, np.int64), 0
    for n, blob in zip(cuts, chunks, strict=True):
        yield row, n, zstandard.decompress(blob), np.r_[0, np.cumsum(sizes[row : row + n])]
        row += n


# -- n-grams ---------------------------------------------------------------------------------------


def symbols(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of rows of UTF-8, each row led by ORDER - 1 start symbols, and the new offsets. White space but line ends is one symbol, and so are digits; code points above 16 bits are folded into these."""
    data = np.frombuffer(raw, np.uint8)
    lens = np.diff(np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets])
    text = raw.decode("utf-8", "replace")
    if len(text) != lens.sum():  # damaged text
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        text, lens = "".join(rows), np.array([len(x) for x in rows], np.int64)
    s = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    s = np.where((s >= 48) & (s <= 57), 48, np.where((s == 9) | (s == 13) | (s == 0xA0), 32, s))
    s = np.maximum(np.where(s < ALPHABET, s, (s ^ (s >> 16)) & (ALPHABET - 1)), _START + 1)
    row = np.repeat(np.arange(len(lens)), lens)
    out = np.full(len(s) + (ORDER - 1) * len(lens), _START, np.uint64)
    out[np.arange(len(s)) + (ORDER - 1) * (row + 1)] = s
    return out, np.r_[0, np.cumsum(lens + ORDER - 1)]


def grams(s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of the n-gram of the highest order that ends at each symbol but the start symbols."""
    if len(s) < ORDER:
        return np.zeros(0, np.uint64)
    g = s[: len(s) - ORDER + 1].copy()
    for k in range(1, ORDER):
        g = (g << _SHIFT) | s[k : len(s) - ORDER + 1 + k]
    lens = np.diff(offsets) - (ORDER - 1)
    row = np.repeat(np.arange(len(lens)), lens)
    return g[np.arange(lens.sum()) + (ORDER - 1) * row]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def _total(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (n-gram, count) parts by n-gram."""
    g, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    g, at = np.unique(g, return_inverse=True)
    return g, np.bincount(at, weights=c, minlength=len(g)).astype(np.int64)


def _count(batches):
    """(gram, c) of the trusted rows of each batch, summed within the task."""
    held, size = [], 0
    for b in batches:
        for picked, *batch in zip(*(b.column(c).to_pylist() for c in ("picked", "sizes", "cuts", "chunks")), strict=True):
            trusted = np.zeros(len(batch[0]), bool)
            trusted[picked] = True
            for row, n, raw, at in _open(*batch):
                s, ends = symbols(raw, at)
                lens = np.diff(ends) - (ORDER - 1)
                g = np.sort(grams(s, ends)[np.repeat(trusted[row : row + n], lens)])
                if not len(g):
                    continue
                first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                held.append((g[first], np.diff(np.r_[first, len(g)])))
                size += len(first)
                if size > HELD_GRAMS:
                    held = [_total(held)]
                    size = len(held[0][0])
                    if size > HELD_GRAMS // 2:
                        yield pa.RecordBatch.from_arrays([_long(held[0][0]), pa.array(held[0][1])], names=["gram", "c"])
                        held, size = [], 0
    if held:
        g, c = _total(held)
        yield pa.RecordBatch.from_arrays([_long(g), pa.array(c)], names=["gram", "c"])


def counts(packed: DataFrame, trusted: DataFrame) -> DataFrame:
    """(gram, c): how often each n-gram of the highest order occurs in the documents whose id is in ``trusted`` (good)."""
    ids = packed.select("batch", F.posexplode("ids").alias("pos", "id"))
    picked = ids.join(trusted, F.col("id") == F.col("good"), "left_semi").groupBy("batch").agg(F.collect_list("pos").alias("picked"))
    rows = packed.join(picked.withColumnRenamed("batch", "_b"), F.col("batch") == F.col("_b")).select("picked", "sizes", "cuts", "chunks")
    return rows.mapInArrow(_count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


# -- model -----------------------------------------------------------------------------------------


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    n = {r.c: r.n for r in table.where("c <= 4").groupBy("c").agg(F.count("gram").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, LEAST_DISCOUNT), k) for k, x in enumerate(d, 1))


def _suffix(gram, n: int):
    """The last n symbols of an n-gram's number."""
    return F.col(gram).bitwiseAND(F.lit((1 << (BITS * n)) - 1))


def model(table: DataFrame) -> DataFrame:
    """(gram, p, gamma): interpolated probability of each n-gram seen, n = 1 .. ORDER, and the weight it leaves to the order below as the context of others.

    ``table`` holds the counts of the highest order. Lower orders count the different symbols before
    an n-gram (continuation counts). No two n-grams share a number, whatever their lengths; the empty
    context is 0. p is negative where an n-gram of the highest order occurs once. Nulls stand for what
    an n-gram is not.
    """
    order: dict[int, DataFrame] = {ORDER: table}
    for n in range(ORDER - 1, 0, -1):
        order[n] = materialize(order[n + 1].groupBy(_suffix("gram", n).alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"lm-order{n}")
    below, parts = None, []
    for n in range(1, ORDER + 1):
        d = _discounts(order[n])
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = order[n].withColumns({"context": F.shiftrightunsigned("gram", BITS), "cut": cut})
        totals = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum("cut").alias("left"))
        rows = rows.join(totals, "context")
        if n == 1:
            rows = rows.withColumn("lower", F.lit(1.0 / ALPHABET))
        else:
            rows = rows.join(below.select(F.col("gram").alias("suffix"), F.abs("p").alias("lower")), _suffix("gram", n - 1) == F.col("suffix"))
        p = (F.col("c") - F.col("cut") + F.col("left") * F.col("lower")) / F.col("total")
        if n == ORDER:
            p = F.when(F.col("c") == 1, -p).otherwise(p)
        below = materialize(rows.select("gram", p.alias("p")), f"lm-p{n}")
        parts.append(below.select("gram", "p", F.lit(None).cast("double").alias("gamma")))
        parts.append(totals.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), (F.col("left") / F.col("total")).alias("gamma")))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("gram").agg(F.max("p").cast("float").alias("p"), F.max("gamma").cast("float").alias("gamma"))


def train(packed: DataFrame, trusted: DataFrame) -> DataFrame:
    """The model of the documents of ``packed`` whose ids are in ``trusted`` (good), as a table in the shared folder."""
    return materialize(model(materialize(counts(packed, trusted), "lm-counts")), "lm-model")


# -- scores ----------------------------------------------------------------------------------------


def _distinct(sizes, cuts, chunks) -> np.ndarray:
    """Distinct n-grams of the highest order of a batch."""
    found: list = []
    for _, _, raw, at in _open(sizes, cuts, chunks):
        g = np.sort(grams(*symbols(raw, at)))
        found.append(g[np.r_[True, g[1:] != g[:-1]]] if len(g) else g)
        if len(found) > 8:
            found = [np.unique(np.concatenate(found))]
    return np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))


def _keys(top: np.ndarray) -> np.ndarray:
    """All that the n-grams of the highest order need: they, their suffixes and the contexts of both."""
    out = [np.zeros(1, np.uint64)]
    for n in range(ORDER, 0, -1):
        out += [top, np.unique(top >> _SHIFT)]
        top = np.unique(top & _MASKS[n - 1]) if n > 1 else top
    return np.unique(np.concatenate(out))


def _ask(batches):
    for b in batches:
        for key, *batch in zip(*(b.column(c).to_pylist() for c in ("batch", "sizes", "cuts", "chunks")), strict=True):
            k = _keys(_distinct(*batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), key, np.int64)), _long(k)], names=["to", "key"])


def costs(top: np.ndarray, key: np.ndarray, p: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """-log2 probability of each n-gram of the highest order in ``top``, and that with n-grams that occur once taken as never seen.

    ``key`` is sorted; p and gamma are NaN where the table has none.
    """

    def at(x, values, otherwise):
        if not len(key):
            return np.full(len(x), otherwise)
        k = np.minimum(np.searchsorted(key, x), len(key) - 1)
        v = np.where(key[k] == x, values[k], np.nan)
        return np.where(np.isnan(v), otherwise, v)

    full = np.full(len(top), 1.0 / ALPHABET)
    for n in range(1, ORDER + 1):
        g = top & _MASKS[n]
        seen = at(g, p, np.nan)
        lower = full * at(g >> _SHIFT, gamma, 1.0)
        full = np.where(np.isnan(seen), lower, np.abs(seen))
    return -np.log2(full), -np.log2(np.where(seen < 0, lower, full))


class _Lookup:
    """Costs of n-grams of the highest order: of those in the table by place (a table by hash first, a search for what that lost), of others as they come."""

    def __init__(self, key: np.ndarray, p: np.ndarray, gamma: np.ndarray, bits: int = 21):
        self.told, self.shift = (key, p, gamma), np.uint64(64 - bits)
        self.top = key[key > _MASKS[ORDER - 1]]
        self.cost = costs(self.top, *self.told)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[self._slot(self.top)] = np.arange(len(self.top))

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, g: np.ndarray) -> list[np.ndarray]:
        out = [np.empty(len(g)), np.empty(len(g))]
        lost = np.arange(len(g))
        if len(self.top):
            k = self.table[self._slot(g)]
            lost = np.flatnonzero(self.top[k] != g)
            k[lost] = np.minimum(np.searchsorted(self.top, g[lost]), len(self.top) - 1)
            lost = lost[self.top[k[lost]] != g[lost]]
            out = [c[k] for c in self.cost]
        if len(lost):
            new, at = np.unique(g[lost], return_inverse=True)
            for x, c in zip(out, costs(new, *self.told), strict=True):
                x[lost] = c[at]
        return out


def repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of each row's pairs of neighbouring words, ends included, that the row held before."""
    h, at = word_hashes(data, offsets)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n + 1)
    w = np.full(len(row), np.uint64(0xE4D0F7E87E4D0F7E))  # what ends a text, and begins the next
    ends = np.cumsum(n + 1) - 1
    inner = np.ones(len(row), bool)
    inner[ends] = False
    w[inner] = h
    before = np.r_[w[-1:], w[:-1]]
    pair = mix(before * np.uint64(0xD6E8FEB86659FD93) + w)
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (pair >> np.uint64(20)))
    again = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(44)).astype(np.int64), minlength=len(n))
    return again / (n + 1)


SCORE = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("bits", pa.float64()), ("own_bits", pa.float64()), ("repeats", pa.float64())])
SCORE_SQL = "doc_id long, lang string, n_symbols long, bits double, own_bits double, repeats double"


def _score(batch: pa.Table, answers: pa.Table) -> pa.Table:
    """Scores of the documents of one batch."""
    key = answers.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    key, p, gamma = key[order], *(answers.column(c).to_numpy().astype(np.float64)[order] for c in ("p", "gamma"))
    find, out = _Lookup(key, p, gamma), []
    for ids, langs, *rest in zip(*(batch.column(c).to_pylist() for c in ("ids", "langs", "sizes", "cuts", "chunks")), strict=True):
        for row, n, raw, at in _open(*rest):
            s, ends = symbols(raw, at)
            lens = np.diff(ends) - (ORDER - 1)
            stop = np.cumsum(lens)
            runs = (np.r_[0.0, np.cumsum(c)] for c in find(grams(s, ends)))
            bits = [r[stop] - r[stop - lens] for r in runs]
            again = repeats(np.frombuffer(raw, np.uint8), at)
            out.append(pa.table([pa.array(ids[row : row + n], pa.int64()), pa.array(langs[row : row + n], pa.string()), pa.array(lens, pa.int64()), *map(pa.array, bits), pa.array(again)], schema=SCORE))
    return pa.concat_tables(out) if out else SCORE.empty_table()


def score(packed: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, bits, own_bits (n-grams that occur once being unseen) and repeats of each packed document; empty texts have 0 symbols and bits."""
    asked = packed.select("batch", "sizes", "cuts", "chunks").mapInArrow(_ask, "to long, key long")
    told = asked.join(table.withColumnRenamed("gram", "key"), "key")
    return packed.groupBy("batch").cogroup(told.groupBy("to")).applyInArrow(_score, SCORE_SQL)


def good_ids(labels: DataFrame) -> DataFrame:
    """Ids of trusted documents: labelled good and never bad."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("good"))
    return rows.agg(F.min("quality").alias("q")).where("q = 1").select("good")


def thresholds(known: DataFrame) -> tuple[DataFrame, tuple]:
    """Of trusted documents' (lang, rate, again): quantiles by language with enough of them, and those of all (null without any)."""
    cut = lambda df: df.agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(c, QUANTILE, 10000).alias(f"q_{c}") for c in ("rate", "again")))
    every = cut(known).first()
    by = cut(known.groupBy("lang")).where(F.col("n") >= LEAST_TRUSTED).withColumnRenamed("lang", "_lang").drop("n")
    return by, (every.q_rate, every.q_again)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity and repeats with their thresholds, and keep of every row of ``docs``.

    Perplexity is per symbol, the text being continued by PRIOR symbols of the trusted documents'
    average cost, so that very short texts are not judged on a few symbols. Null and empty texts have
    that average and stay; a text at a threshold stays. Without trusted documents nothing is rejected.
    A null language is a language of its own. Rows that repeat a doc_id are scored one by one. Other
    columns are not read.
    """
    good = good_ids(labels)
    packed = pack(docs)
    scored = score(packed, train(packed, good)).join(good, F.col("doc_id") == good.good, "left")
    # only ids and scores from here on
    bits = F.when(F.col("good").isNull(), F.col("bits")).otherwise(F.col("own_bits"))
    scored = materialize(scored.select("doc_id", "lang", "n_symbols", bits.alias("bits"), "repeats", F.col("good").isNotNull().alias("known")), "lm-scores")
    known = scored.where("known AND n_symbols > 0")
    mean = known.agg(F.sum("bits") / F.sum("n_symbols")).first()[0]
    measure = {"rate": (F.col("bits") + PRIOR * F.lit(float(mean or 0.0))) / (F.col("n_symbols") + PRIOR), "again": F.col("repeats")}
    by, every = thresholds(known.withColumns(measure))
    top = lambda c, v: F.coalesce(F.col(f"q_{c}"), F.lit(float("inf") if v is None else float(v)))
    joined = scored.withColumns(measure).join(by, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    joined = joined.withColumns({"most_rate": top("rate", every[0]) + float(np.log2(SLACK)), "most_again": top("again", every[1]) * SLACK + REPEAT_SLACK})
    two = lambda c: F.pow(F.lit(2.0), F.col(c))
    keep = (F.col("rate") <= F.col("most_rate")) & (F.col("again") <= F.col("most_again"))
    return joined.select("doc_id", "lang", "n_symbols", two("rate").alias("perplexity"), two("most_rate").alias("threshold"), F.col("again").alias("repeats"), F.col("most_again").alias("repeats_threshold"), keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without rejected documents. Of rows that share a doc_id all go if one is rejected; rows without a doc_id stay."""
    bad = classify(docs, labels).where("NOT keep AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs.doc_id == F.col("_bad"), "left_anti")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity and repetition with their thresholds, and whether it is kept; see :func:`classify` for odd rows."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
