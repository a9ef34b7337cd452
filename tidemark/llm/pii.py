"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans.

The field labels the tokens around digits and at-signs, the latter also spelled out. A segment of at most ``MAX_TOKENS`` tokens is
scored as a whole (its shape, digit count, check sum, the characters beside it) for each kind, other
tokens stand alone, and labels of neighbouring segments interact; dynamic programming finds the
best segmentation. It is trained by gradient steps on the log-likelihood, on a bounded sample of
documents whose base spans serve as labels, together with rewritten forms of these (telephone
numbers without their prefix, spelled out at-signs and dots, addresses without digits). Decoded spans that touch no base span are added.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


KINDS = ("email", "ip", "card", "phone")
#: Documents the field is trained on at most, islands of them, and passes over these.
TRAIN_DOCS, TRAIN_ISLANDS, EPOCHS = 1500, 900, 4
MAX_TOKENS = 24
#: Digits of a candidate without at-sign, and single spaces in it.
LEAST_DIGITS, MOST_DIGITS, MOST_SPACES = 7, 23, 6
#: Log-odds by which a segmentation with a span must beat the best one without.
MARGIN = 2.0

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: At-signs and dots spelled out, with the spaces that part them from a name; bare words only before what may be a host (no article or the like).
_AT = r" ?[(\[]at[)\]] ?| at (?!(?:the|an?|this|that|these|those|each|every|his|her|its|my|your|our|their|one|no) )(?=[a-z0-9-]++(?:\.[a-z0-9-]| dot [a-z0-9-]| ?[(\[]dot[)\]]))"
_DOT = r" ?[(\[]dot[)\]] ?| dot (?=[a-z0-9-])"
_SIGN = re.compile(f"[0-9@]|{_AT}|{_DOT}", re.I)
_SPELLED_AT, _SPELLED_DOT = re.compile(_AT, re.I), re.compile(_DOT, re.I)
_MARK = re.compile(f"@|{_AT}", re.I)
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS, _JOINS, _HOST = "0123456789", ".-", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_WORD_END = re.compile(r"[^\s]*+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind, then start; linear in the text."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        i = at
        while i > free and text[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append(("email", i, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    for m in _digits(_IP, text):
        if all(len(x) < 4 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _digits(pattern, text: str):
    """Matches that begin where a run of digits begins; other starts in a run fail as its first does."""
    at, n = 0, len(text)
    while at < n:
        m = _RUN.search(text, at)
        if not m:
            return
        hit = pattern.match(text, m.start())
        if hit:
            yield hit
            at = hit.end()
        else:
            at = m.end()


_RUN = re.compile(r"[0-9]++")


def _shape(s: str) -> str:
    """Runs of digits and letters as one sign each, with lengths for short runs of digits."""
    out = []
    for t in _TOKEN.findall(s):
        if t[0] in "0123456789":
            out.append(f"d{len(t)}" if len(t) < 5 else "D")
        elif t.isalpha() and t.isascii():
            out.append("a")
        else:
            out.append(t)
    return "".join(out)


def _side(c: str) -> str:
    return "_" if not c or c.isspace() else "d" if c in "0123456789" else "a" if c.isalpha() else c


def _spelled(s: str) -> str:
    """Spelled out at-signs, up to two, whether a host follows the first, and whether it spells a dot."""
    at = list(_SPELLED_AT.finditer(s))
    host = s[at[0].end() :] if at else ""
    return f"{min(len(at), 2)}{'.' in host}{bool(_SPELLED_DOT.search(host))}"


def segment_features(text: str, i: int, j: int) -> list[str]:
    s = text[i:j]
    digits = re.sub("[^0-9]", "", s)
    shape = _shape(s)
    parts = s.split(".")
    byte = len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 and int(p) <= 255 for p in parts)
    flat = re.sub(r"d\d|D", "d", shape)
    return [
        "bias",
        f"digits={min(len(digits), 20)}",
        f"flat={flat}" if len(flat) < 16 else "flat=long",
        f"shape={shape}" if len(shape) < 24 else "shape=long",
        f"luhn={len(digits) in (16, 17, 18, 19) and luhn(digits)}",
        f"bytes={byte}",
        f"at={s.count('@')}{'.' in s.partition('@')[2]}",
        f"spelled={_spelled(s)}",
        f"plus={s[0] == '+'}",
        f"letters={any(c.isalpha() for c in s)}",
        f"left={_side(text[i - 1 : i])}",
        f"right={_side(text[j : j + 1])}",
        f"spaces={min(s.count(' '), 4)}",
    ]


def islands(text: str):
    """(start, end) of stretches without white space that hold a digit or at-sign or stand beside a spelled out one, and single spaces between such."""
    out: list[tuple[int, int]] = []
    done = 0
    for m in _SIGN.finditer(text):
        if m.end() <= done or (m[0].lower() == " dot " and m.start() != done):
            continue  # a bare "dot" goes on with an island, but opens none
        lo, hi = m.start(), _WORD_END.match(text, m.end()).end()
        while lo > done and not text[lo - 1].isspace():
            lo -= 1
        if out and (lo <= done or (lo == done + 1 and text[done] == " ")):
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
        done = hi
    return out


class Field:
    """Weights by label and feature; label 0 is a token outside of any span."""

    def __init__(self):
        self.w: list[dict[str, float]] = [{} for _ in range(len(KINDS) + 1)]
        self.t = [[0.0] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)]

    def segments(self, text: str, lo: int, hi: int):
        """Token boundaries of an island and its candidate segments (first, last, exclusive) by last token.

        Candidates are runs of digits and their separators with as many digits as a kind can have, and
        words around one at-sign, so their number stays in proportion to the text. Neither may be cut
        out of a longer run of its own signs.
        """
        inside = text[lo:hi]
        marks = [(m.start(), m.end()) for m in _MARK.finditer(text, lo, hi)]
        if not marks and sum(map(inside.count, "0123456789")) < 4:
            return (), []
        cut = array("q", [lo])
        cut.extend(m.end() for m in _TOKEN.finditer(text, lo, hi))
        n, found = len(cut) - 1, []
        for j in range(1, n + 1):
            b = cut[j]
            if text[b - 1] not in _DIGITS or (text[b : b + 1] in _JOINS and text[b + 1 : b + 2] in _DIGITS and b + 1 < len(text)):
                continue
            digits = spaces = 0
            for i in range(j - 1, max(-1, j - 1 - MAX_TOKENS), -1):
                a = cut[i]
                c = text[a]
                if c in _DIGITS:
                    digits += cut[i + 1] - a
                    if digits > MOST_DIGITS:
                        break
                elif c == " ":
                    spaces += 1
                    if spaces > MOST_SPACES:
                        break
                    continue
                elif c not in "+(":
                    if c in ").-":
                        continue
                    break
                joined = a > 1 and text[a - 1] in ".-" and text[a - 2] in _DIGITS
                if not joined and (digits >= LEAST_DIGITS or (j - i == 7 and _QUAD.fullmatch(text, a, b))):
                    found.append((i, j))
                if c == "+":
                    break
        for k, (x, y) in enumerate(marks):
            first, last = bisect_left(cut, x), bisect_left(cut, y)
            low, high = marks[k - 1][1] if k else lo, marks[k + 1][0] if k + 1 < len(marks) else hi
            starts = []
            for i in range(first - 1, max(-1, first - MAX_TOKENS), -1):
                a = cut[i]
                if a < low or text[a] == "\n":
                    break
                if (text[a].isalnum() or text[a] in "+(") and text[a - 1 : a] not in _LOCAL:
                    starts.append(i)
            for j in range(last + 1, min(n, last + MAX_TOKENS) + 1):
                b = cut[j]
                if b > high or text[b - 1] == "\n":
                    break
                after = text[b : b + 2]
                if text[b - 1].isalnum() and not (after[:1] in _HOST and after) and not (after[:1] == "." and after[1:] in _HOST and after[1:]):
                    found += [(i, j) for i in starts if j - i <= MAX_TOKENS]
        return cut, sorted(set(found), key=lambda x: (x[1], -x[0]))

    def lattice(self, text: str, lo: int, hi: int):
        """Token boundaries of an island and, by their last token, its candidate segments (first, features)."""
        cut, found = self.segments(text, lo, hi)
        if not found:
            cut = [lo] + [m.end() for m in _TOKEN.finditer(text, lo, hi)]
        ends: list = [[] for _ in range(len(cut) - 1)]
        for i, j in found:
            ends[j - 1].append((i, segment_features(text, cut[i], cut[j])))
        return cut, ends

    def token(self, text: str, i: int, j: int) -> list[str]:
        c = text[i]
        return ["bias", "d" if c in "0123456789" else "a" if c.isalpha() else f"c={c}", f"n={min(j - i, 20)}"]

    def score(self, label: int, features: list[str]) -> float:
        w = self.w[label]
        return sum(w.get(f, 0.0) for f in features)

    def decode(self, text: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
        """The best segmentation of an island.

        A token that no candidate covers stands alone in any case, so stretches of candidates that
        touch one another are decoded by themselves, each from the label of a lone token.
        """
        cut, found = self.segments(text, lo, hi)
        out: list = []
        stretch: list = []
        end = -1
        for i, j in [*sorted(found), (len(cut) + 1, 0)]:
            if stretch and i > end:
                stretch.sort(key=lambda x: (x[1], -x[0]))
                out += self._best(text, cut, first, end, stretch)
                stretch = []
            first = first if stretch else i
            end = max(end, j)
            stretch.append((i, j))
        return out

    def _best(self, text: str, cut, first: int, last: int, found: list) -> list[tuple[str, int, int]]:
        """Viterbi over tokens first .. last; scores are kept for MAX_TOKENS tokens only, of the rest where they came from."""
        y = range(len(KINDS) + 1)
        ring = [[-math.inf] * len(y) for _ in range(MAX_TOKENS + 1)]
        ring[first % len(ring)] = [0.0] + [-math.inf] * len(KINDS)
        come, label = array("i", [0]) * (len(y) * (last - first)), array("b", [0]) * (len(y) * (last - first))
        at = 0
        for j in range(first + 1, last + 1):
            row, base = [-math.inf] * len(y), len(y) * (j - first - 1)
            s, before = self.score(0, self.token(text, cut[j - 1], cut[j])), ring[(j - 1) % len(ring)]
            for p in y:
                v = before[p] + self.t[p][0] + s
                if v > row[0]:
                    row[0], come[base], label[base] = v, j - 1, p
            while at < len(found) and found[at][1] == j:
                i = found[at][0]
                at += 1
                f, before = segment_features(text, cut[i], cut[j]), ring[i % len(ring)]
                for k in y[1:]:
                    s = self.score(k, f) - MARGIN
                    for p in y:
                        v = before[p] + self.t[p][k] + s
                        if v > row[k]:
                            row[k], come[base + k], label[base + k] = v, i, p
            ring[j % len(ring)] = row
        after = [v + self.t[k][0] * (last < len(cut) - 1) for k, v in enumerate(row)]
        out, j, k = [], last, max(y, key=after.__getitem__)
        while j > first:
            i, p = come[len(y) * (j - first - 1) + k], label[len(y) * (j - first - 1) + k]
            if k:
                out.append((KINDS[k - 1], cut[i], cut[j]))
            j, k = i, p
        return out[::-1]

    def step(self, text: str, lo: int, hi: int, gold: list[tuple[str, int, int]], rate: float) -> float:
        """One gradient step on the log-likelihood of an island; returns the log-likelihood before it."""
        cut, ends = self.lattice(text, lo, hi)
        n, y = len(cut) - 1, range(len(KINDS) + 1)
        place = {c: k for k, c in enumerate(cut)}
        edges = []  # (first, last, label, features)
        for j in range(1, n + 1):
            edges.append((j - 1, j, 0, self.token(text, cut[j - 1], cut[j])))
            edges += [(i, j, k, f) for i, f in ends[j - 1] for k in y[1:]]
        wanted = {(place[a], place[b], KINDS.index(kind) + 1) for kind, a, b in gold if a in place and b in place}
        known = {(i, j, k) for i, j, k, _ in edges}
        if len(wanted) < len(gold) or not wanted <= known:
            return 0.0  # a span that no lattice path has teaches nothing
        inner = {t for i, j, _ in wanted for t in range(i, j)}
        wanted |= {(t, t + 1, 0) for t in range(n) if t not in inner}
        s = [self.score(k, f) for _, _, k, f in edges]
        forward = [[-math.inf] * len(y) for _ in range(n + 1)]
        forward[0][0] = 0.0
        into = [None] * (n + 1)
        for e, (i, j, k, _) in enumerate(edges):
            if into[i] is None:
                into[i] = [_logsum([forward[i][p] + self.t[p][k2] for p in y]) for k2 in y]
            forward[j][k] = _logsum([forward[j][k], into[i][k] + s[e]])
        total = _logsum(forward[n])
        backward = [[-math.inf] * len(y) for _ in range(n)] + [[0.0] * len(y)]
        out: list = [[-math.inf] * len(y) for _ in range(n + 1)]  # of a label that begins at a boundary
        grad_t = [[0.0] * len(y) for _ in y]
        done = n
        share = [0.0] * len(edges)
        for e in range(len(edges) - 1, -1, -1):
            i, j, k, _ = edges[e]
            while done > j:
                done -= 1
            share[e] = math.exp(min(0.0, into[i][k] + s[e] + backward[j][k] - total))
            out[i][k] = _logsum([out[i][k], s[e] + backward[j][k]])
            if e == 0 or edges[e - 1][1] != j:  # every edge that ends at j is done, and so is all that begins at j - 1
                b = j - 1
                backward[b] = [_logsum([self.t[p][k2] + out[b][k2] for k2 in y]) for p in y]
        for p in y:
            for k in y:
                for b in range(n):
                    v = forward[b][p] + self.t[p][k] + out[b][k] - total
                    if v > -30:
                        grad_t[p][k] -= math.exp(min(0.0, v))
        like, last = 0.0, 0
        for i, j, k in sorted(wanted):
            grad_t[last][k] += 1
            like += self.t[last][k]
            last = k
        for e, (i, j, k, f) in enumerate(edges):
            own = (i, j, k) in wanted
            like += s[e] * own
            g = own - share[e]
            if abs(g) > 1e-4:
                w = self.w[k]
                for x in f:
                    w[x] = w.get(x, 0.0) + rate * g
        for p in y:
            for k in y:
                self.t[p][k] += rate * grad_t[p][k]
        return like - total


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def rewritten(text: str, gold: list[tuple[str, int, int]], rng) -> tuple[str, list]:
    """An island with one form changed: a telephone number without its prefix, a spelled out at-sign, with or without digits and dots."""
    kind, a, b = gold[0]
    s = text[a:b]
    if kind == "phone" and "(" in s:
        s = s[s.index("(") :] if rng.random() < 0.5 else s[s.index("(") + 1 :].replace(") ", "-")
    elif kind == "email":
        name, _, host = s.partition("@")
        if rng.random() < 0.5:
            name, host = (re.sub(r"[._%+-]?[0-9]+", "", x) for x in (name, host))
        if not name[:1].isalnum() or not host[:1].isalnum() or not host[-1].isalnum():
            name, _, host = s.partition("@")
        at = rng.choice(["(at)", "[at]", " (at) ", " [at] ", " at "])
        if rng.random() < 0.3:
            host = host.replace(".", " dot " if at == " at " else at.replace("at", "dot"))
        s = name + at + host
    else:
        return text, gold
    return text[:a] + s + text[b:], [(kind, a, a + len(s))]


def train(texts: list[str], seed: int = 3) -> Field:
    """A field fitted on at most TRAIN_ISLANDS islands of ``texts``: those that hold base spans and as many others, and rewritten forms."""
    rng, held, other = random.Random(seed), [], []
    for t in texts:
        spans = base_spans(t)
        for lo, hi in islands(t):
            if hi - lo > 200:
                continue
            gold = sorted(((k, a, b) for k, a, b in spans if a >= lo and b <= hi), key=lambda x: x[1])
            window = t[max(0, lo - 12) : hi + 12]
            d = max(0, lo - 12)
            item = (window, lo - d, hi - d, [(k, a - d, b - d) for k, a, b in gold])
            (held if gold else other).append(item)
    rng.shuffle(held)
    rng.shuffle(other)
    data = held[: TRAIN_ISLANDS // 2] + other[: TRAIN_ISLANDS // 4]
    for w, lo, hi, gold in held[: TRAIN_ISLANDS // 4]:
        if len(gold) == 1:
            t, g = rewritten(w, gold, rng)
            if t != w:
                data.append((t, lo, hi + len(t) - len(w), g))
    field = Field()
    for epoch in range(EPOCHS):
        rng.shuffle(data)
        for item in data:
            field.step(*item, rate=0.3 / (1 + epoch))
    return field


def find(text: str | None, field: Field):
    """Base spans and all spans, both by kind and start."""
    text = text or ""
    base = base_spans(text)
    taken = sorted((x, y) for _, x, y in base)
    added, at, reach = [], 0, 0  # decoded spans come in order, so one pass over the base spans will do
    for lo, hi in islands(text):
        for kind, a, b in field.decode(text, lo, hi):
            while at < len(taken) and taken[at][0] < b:
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= a:
                added.append((kind, a, b))
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return base, sorted(base + added, key=order)


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def fit(docs: DataFrame) -> Field:
    """Train on at most TRAIN_DOCS documents with a digit or at-sign, those whose ids hash lowest."""
    rows = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= 20000)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    # a bound on h that about twice as many rows stay below: else each partition would send the driver TRAIN_DOCS texts
    low = min(1.0, 2 * TRAIN_DOCS / max(rows.count(), 1))
    picked = rows.where(F.col("h") <= min(int((2 * low - 1) * 2**63), 2**63 - 1)).orderBy("h").limit(TRAIN_DOCS).select("text").collect()
    return train([r.text for r in picked])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Spans of each row, in code points with exclusive ends. Null texts are empty; ids may repeat or be null; other columns are not read."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(field or fit(docs))

    def f(batches):
        for b in batches:
            out: list = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                base, every = find(t, sent.value)
                n = [sum(k == x for x, _, _ in base) for k in KINDS]
                out.append((d, *n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(every)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(f, SCHEMA)


def mask_text(text: str, spans) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans one bracket covers all, named by the first."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text``; null texts stay null, other columns stay as they are."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(field or fit(docs))

    def f(batches):
        for b in batches:
            k = b.schema.get_field_index("text")
            texts = [t and mask_text(t, find(t, sent.value)[1]) for t in b.column(k).to_pylist()]
            yield b.set_column(k, "text", pa.array(texts, b.schema.field(k).type))

    return docs.mapInArrow(f, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans; odd rows as in :func:`detect`."""
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
