"""Token packing by best-fit decreasing, as piece lists or as id matrices.

A document's ids end with ``END``. Overlong documents are first cut into full windows; what remains
is sorted by length within a bounded buffer and each piece goes to the open window with the least
room that still holds it, found in a segment tree indexed by room. Tasks pack what they read, so
nothing is shuffled: a sequence holds documents of one input partition, and its id starts with that
partition's number.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

WINDOW, END, PAD = 2048, 1, 0
#: Remainders that a task sorts and packs at once, and windows that it keeps open for the next ones.
BUFFER, OPEN_WINDOWS = 4096, 2048
CACHE_WORDS = 500_000
#: Python's split() also cuts at these, which the tokenizer does not take for white space.
_ODD = re.compile("[\x1c-\x1f]")
#: Letters with punctuation behind them, which the tokenizer takes apart and lower-cases; precomposed, so that normalizing changes nothing.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,!?;:|*$%&#()\"]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ids(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_letters() -> list[str]:
    """The letter that stands for each byte before a byte-level model: printable ones for themselves, the others follow from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Words(dict):
    """Ids (little-endian uint32 bytes) of white-space separated words, by word.

    The tokenizer never joins text across white space, so a text's ids are those of its words in
    order, and in ``word_bpe_49k`` those of a word of letters and punctuation are those of its
    lower-case letters and its punctuation. Letters go straight to the model, byte by byte as it
    takes them; a tokenizer that does otherwise with a sample is asked for every word. Both caches
    are emptied when full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.parts: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.splits = all(_ids(self.tokenizer, x) == self._letters(y) + _ids(self.tokenizer, z) for x, y, z in (("Aé,.", "aé", ",."), ("Straßenbahnhöfe!", "straßenbahnhöfe", "!"), ("internationally;", "internationally", ";")))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return _ids(self.tokenizer, text)
        words = text.split()
        if len(words) > CACHE_WORDS:  # a very long text, a part at a time
            return b"".join(self._some(words[i : i + CACHE_WORDS]) for i in range(0, len(words), CACHE_WORDS))
        return self._some(words)

    def _some(self, words: list[str]) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        return b"".join(map(self.__getitem__, words))

    def __missing__(self, word: str) -> bytes:
        if self.splits and word.isalpha() and word.isascii():
            part, marks = word.lower(), ""
        elif self.splits and (m := _SIMPLE.fullmatch(word)):
            part, marks = m[1].lower(), m[2]
        else:
            ids = self[word] = _ids(self.tokenizer, word)
            return ids
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts[part] = self._letters(part)
        if marks:
            more = self.parts.get(marks)
            if more is None:
                more = self.parts[marks] = _ids(self.tokenizer, marks)
            ids += more
        self[word] = ids
        return ids

    def _letters(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join(map(self.letters.__getitem__, part.encode()))
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()


class Rooms:
    """Open windows by remaining room, in a segment tree over 0..width."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, room: int, n: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += n
            k >>= 1

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the tightest window with at least ``need``."""
        count, k = self.count, need + self.size
        while not count[k]:  # up to the first subtree on the right that has an open window
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.size:
            k <<= 1
            if not count[k]:
                k += 1
        self._add(k - self.size, -1)
        return k - self.size, self.open[k - self.size].pop()


class Packer:
    """Places pieces of at most ``width`` tokens; windows stay open between calls."""

    def __init__(self, width: int = WINDOW):
        self.width, self.next, self.rooms = width, 0, Rooms(width)

    def full(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, lengths: list[int]) -> list[tuple[int, int]]:
        """(window, offset) of each length."""
        out: list = [None] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            n = lengths[i]
            room, window = self.rooms.take(n) or (self.width, self.full())
            out[i] = (window, self.width - room)
            if room > n:
                self.rooms.put(room - n, window)
        return out


def _tokens(batches, path: str):
    words, end = Words(path), np.array([END], "<u4").tobytes()
    for batch in batches:
        for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            yield d, words.ids(t) + end


def sequences(batches, path: str, width: int):
    """Packed sequences of a task, as lists of (offset, doc_id, start, ids, ids of the document).

    Full windows go out at once. BUFFER remainders are placed at a time; of the windows still open
    after that the tightest go out until OPEN_WINDOWS are left.
    """
    packer, held, rest = Packer(width), {}, []

    def settle(most: int):
        for piece, (window, offset) in zip(rest, packer.place([len(x[2]) // 4 for x in rest]), strict=True):
            held.setdefault(window, []).append((offset, *piece))
        rest.clear()
        done = [w for w, x in held.items() if sum(len(s[3]) for s in x) == 4 * width]
        done += [packer.rooms.take(1)[1] for _ in range(len(held) - len(done) - most)]
        for w in done:
            yield sorted(held.pop(w), key=lambda s: s[0])

    for d, ids in _tokens(batches, path):
        for start in range(0, len(ids) // 4, width):
            part = ids[4 * start : 4 * (start + width)]
            if len(part) == 4 * width:
                yield [(0, d, start, part, len(ids) // 4)]
            else:
                rest.append((d, start, part, len(ids) // 4))
        if len(rest) >= BUFFER:
            yield from settle(OPEN_WINDOWS)
    yield from settle(0)


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(path: str, width: int):
    def f(batches):
        base, rows = TaskContext.get().partitionId() << 32, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=PIECES)
        for n, segments in enumerate(sequences(batches, path, width)):
            rows += [(d, start, len(part) // 4, zlib.crc32(part), total, base | n, offset) for offset, d, start, part, total in segments]
            if len(rows) >= 8192:
                yield out()
                rows = []
        if rows:
            yield out()

    return f


def pack(docs: DataFrame, tokenizer: str | None = None, width: int = WINDOW) -> DataFrame:
    """Pieces of the documents and where they stand. Each row of ``docs`` is a document of its own, whatever its doc_id; a null or empty text has the one id END."""
    path = tokenizer or default_tokenizer()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(path, width), PIECES_SQL)


MATRIX = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("id_bytes", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))])
MATRIX_SQL = "sequence_id long, ids binary, width int, id_bytes int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"


def _matrices(path: str, width: int, id_bytes: int):
    kind = f"<u{id_bytes}"

    def f(batches):
        base = TaskContext.get().partitionId() << 32
        cols: dict = {k: [] for k in MATRIX.names}
        for n, segments in enumerate(sequences(batches, path, width)):
            ids = np.frombuffer(b"".join(s[3] for s in segments), "<u4")
            row = np.full(width, PAD, kind)
            row[: len(ids)] = ids
            offsets = [s[0] for s in segments]
            for k, v in zip(MATRIX.names, (base | n, row.tobytes(), width, id_bytes, [*offsets, len(ids)], offsets, [s[1] for s in segments], [s[2] for s in segments]), strict=True):
                cols[k].append(v)
            if len(cols["ids"]) >= 1024:
                yield pa.RecordBatch.from_pydict(cols, MATRIX)
                cols = {k: [] for k in cols}
        if cols["ids"]:
            yield pa.RecordBatch.from_pydict(cols, MATRIX)

    return f


def write_matrices(docs: DataFrame, path: str, tokenizer: str | None = None, width: int = WINDOW) -> None:
    """Write packed sequences below ``path``: one row a sequence with its ``width`` ids (little-endian, two bytes where the vocabulary allows), cumulative segment lengths, and the positions at which position ids start again from 0.

    Pieces of a document name it in doc_ids and its ids before them in doc_starts, so texts' ids can
    be put together again. Nulls and empty texts are as in :func:`pack`.
    """
    from tokenizers import Tokenizer

    name = tokenizer or default_tokenizer()
    id_bytes = 2 if max(Tokenizer.from_file(name).get_vocab_size(), END + 1) <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_matrices(name, width, id_bytes), MATRIX_SQL)
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATRIX_SQL).parquet(path)


def _digest(batches):
    for batch in batches:
        out = []
        for ids, cu, size in zip(batch.column("ids").to_pylist(), batch.column("cu_seqlens").to_pylist(), batch.column("id_bytes").to_pylist(), strict=True):
            row = np.frombuffer(ids, f"<u{size}").astype("<u4")
            out.append((cu[-1], len(cu) - 1, zlib.crc32(row[: cu[-1]].tobytes()), int((row[cu[-1] :] != PAD).sum())))
        cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4
        names = ["sequence_id", "cu_seqlens", "position_resets", "doc_ids", "doc_starts"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + cols, names=[*names, "n_tokens", "n_segments", "ids_crc32", "bad_padding"])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places; odd rows as in :func:`pack`."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices as written and read again: a row for each sequence, with the CRC-32 of its ids."""
    path = scratch(spark, "matrices")
    write_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_matrices(spark, path).mapInArrow(_digest, "sequence_id long, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>, n_tokens long, n_segments long, ids_crc32 long, bad_padding long")
