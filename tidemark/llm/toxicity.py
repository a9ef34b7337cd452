"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A window is a word between spaces. Its distance is the share of its bytes, compressed with the
dictionary of ordinary text, that the dictionary of toxic text saves. The dictionaries hold what
labelled text of one kind repeats and the other does not: the toxic one the words that toxic documents
have in many different surroundings (so that copies of a document count once) and ordinary ones hardly,
the ordinary one the words that ordinary documents repeat most. On labelled documents apart from these,
a logistic regression on the numbers of windows at or above each distance calibrates the thresholds.

zstandard's own trainer over whole labelled texts, with windows of one to eight words, told held-out
documents apart far worse (README): it keeps what is frequent in toxic text, most of which is ordinary.
So in effect the toxic dictionary is a learned word list, and compression finds its words and their
inflections. The learner sees a bounded sample of labelled rows; every document is scored over its
whole text, where it lies.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Labelled documents learned from at most, by label, those whose ids hash lowest; of a longer text this many characters from a place that its hash picks.
TOXIC_DOCS, ORDINARY_DOCS, TEXT_CHARS = 2500, 3500, 20000
#: Surroundings in which a toxic word must occur, how much more often than in ordinary documents, and the likelihood ratio (G) that chance must be beaten by.
SURROUNDINGS, RATIO, EVIDENCE = 4, 8.0, 16.0
#: Bytes of a dictionary, words of ordinary text in it, and the compression level.
DICT_BYTES, ORDINARY_WORDS, LEVEL = 65536, 4000, 12
#: Distances in steps of 1/GRADES, and those that are told apart.
GRADES = 16
DISTANCES = tuple(range(3, 13))
#: Begins every window and ends both dictionaries: what is compressed is never too short for a block that uses matches.
CARRIER = b"\x02 0b6e:Zq;window|of~text^#7:"
#: Ends every window, since the compressor looks for no match in the last bytes.
TAIL = b"\x01;^}|<*\x03{"
CACHE_WORDS = 500_000


def _compressor(words: list[str]):
    """A compressor with a dictionary of the strongest of ``words`` that DICT_BYTES hold, the last ones cheapest to reach."""
    size, n = 1, 0
    while n < len(words) and size + len(words[-1 - n].encode()) + 1 <= DICT_BYTES:
        size += len(words[-1 - n].encode()) + 1
        n += 1
    data = (" " + " ".join(words[len(words) - n :]) + " ").encode() + CARRIER
    held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


class Distance(dict):
    """Distance of each word seen so far; emptied when full."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        super().__init__()
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.carrier = len(self.toxic.compress(CARRIER + TAIL))

    def __missing__(self, word: str) -> int:
        w = CARRIER + f" {word} ".encode("utf-8", "replace") + TAIL
        a, b = len(self.ordinary.compress(w)) - self.carrier, len(self.toxic.compress(w)) - self.carrier
        self[word] = d = max(0, min(GRADES - 1, GRADES * (a - b) // max(a, 1)))
        return d

    def features(self, text: str | None) -> np.ndarray:
        """log(1 + windows at or above each of DISTANCES)."""
        words = (text or "").lower().split()
        n = np.zeros(GRADES, np.int64)
        for i in range(0, len(words), CACHE_WORDS):
            if len(self) > CACHE_WORDS:
                self.clear()
            part = words[i : i + CACHE_WORDS]
            n += np.bincount(np.fromiter(map(self.__getitem__, part), np.int8, len(part)), minlength=GRADES)
        over = n[::-1].cumsum()[::-1]
        return np.log1p(over[list(DISTANCES)])


def _surroundings(texts: list[str]) -> Counter:
    """In how many different surroundings (the words before and after) each word occurs."""
    seen = set()
    for t in texts:
        w = ["", *t.lower().split(), ""]
        seen.update(zip(w, w[1:], w[2:], strict=False))
    return Counter(x[1] for x in seen)


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[list[str], list[str]]:
    """Words of the two dictionaries, the strongest last."""
    a, b = _surroundings(toxic), _surroundings(ordinary)
    na, nb = sum(a.values()) + 1, sum(b.values()) + 1
    lift = {w: (n / na) / ((b[w] + 0.5) / nb) for w, n in a.items() if n >= SURROUNDINGS}
    ea, eb = na / (na + nb), nb / (na + nb)
    g = lambda x, y: 2 * (x * np.log(x / ((x + y) * ea)) + (y * np.log(y / ((x + y) * eb)) if y else 0.0))
    bad = sorted((w for w, x in lift.items() if x >= RATIO and g(a[w], b[w]) >= EVIDENCE), key=lambda w: (a[w], w))
    good = sorted((w for w in b if w not in lift or lift[w] < 2), key=lambda w: (b[w], w))
    return bad, good[-ORDINARY_WORDS:]


class Model:
    """Dictionaries and calibrated weights; ``share`` is the score if labels of one kind are missing."""

    def __init__(self, rows: list[tuple[str, int]]):
        texts = {k: [t for t, y in rows if y == k] for k in (0, 1)}
        self.share, self.weights = (len(texts[1]) / len(rows) if rows else 0.0), None
        self.words: tuple = ([], [])
        if not texts[0] or not texts[1]:
            return
        fit = {k: [t for i, t in enumerate(x) if i % 3 or len(x) < 3] for k, x in texts.items()}
        self.words = dictionaries(fit[1], fit[0])
        distance = Distance(*self.words)
        held = [(t, k) for k, x in texts.items() for i, t in enumerate(x) if i % 3 == 0]
        self.weights = _logistic(np.array([distance.features(t) for t, _ in held]), np.array([k for _, k in held]))

    def scorer(self):
        distance = Distance(*self.words) if self.weights is not None else None

        def score(text: str | None) -> float:
            if distance is None:
                return self.share
            z = self.weights[0] + self.weights[1:] @ distance.features(text)
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Intercept and weights by Newton's method with a ridge; weights are kept from being negative, since more toxic windows never speak for a text."""
    a = np.c_[np.ones(len(x)), x]
    free = np.ones(a.shape[1], bool)
    while True:
        w = np.zeros(a.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
            g = a.T @ (y - p) - ridge * w
            w[free] += np.linalg.solve(h[np.ix_(free, free)], g[free])
        bad = (w < 0) & free
        bad[0] = False
        if not bad.any():
            return w
        free &= ~bad


def _remainder(c) -> F.Column:
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5, F.lit(1))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled documents whose crc32(doc_id as text) mod 5 is not 0; of several labels of a doc_id the greatest counts.

    Null ids, labels and texts teach nothing; of documents that share an id the least text does. With
    labels of one kind only, or none, every text gets the share of toxic ones, 0 without any.
    """
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    rows = rows.where(_remainder(F.col("id")) != 0)
    few = [rows.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in ((1, TOXIC_DOCS), (0, ORDINARY_DOCS))]
    picked = F.broadcast(few[0].unionByName(few[1]))  # at most TOXIC_DOCS + ORDINARY_DOCS ids
    begin = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - TEXT_CHARS, F.lit(0)) + 1).cast("int") + 1
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.substring("text", begin, F.lit(TEXT_CHARS)).alias("text")).join(picked, "id")
    got = texts.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).collect()
    got.sort(key=lambda r: hash_order(r.id))
    return Model([(r.text, r.y) for r in got])


def hash_order(i: int) -> tuple[int, int]:
    return (i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, i


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts are scored as texts without words, a null doc_id is not held out."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches):
        s = sent.value.scorer()
        for b in batches:
            x = [s(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(x, pa.float64()), pa.array([int(v >= 0.5) for v in x], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (_remainder(F.col("doc_id").cast("long")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(f, "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of the labels that are not held out; odd rows as in :func:`fit` and :func:`score`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
