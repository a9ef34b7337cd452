"""Helpers shared by the training-data operators: shared storage and byte-level batch access."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary folder if Spark runs in this process alone, else one in the warehouse, which a cluster shares."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        alone = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        _local[app] = tempfile.mkdtemp(prefix="tidemark-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidemark"
        spark.sparkContext.setCheckpointDir(_local[app])
    return _local[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session ended first: the cluster's own cleaning of the folder applies
        return


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(batches):
    """Rows of Arrow batches as dicts, one at a time: a batch may hold many large rows, but no copy of them all."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column as one uint8 array, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int):
    """Row ranges [i, j) of at most ``most`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one uint64 (little end first); len(data) - 7 values."""
    a = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << np.uint16(8))
    b = a[:-2].astype(np.uint32) | (a[2:].astype(np.uint32) << np.uint32(16))
    return b[:-4].astype(np.uint64) | (b[4:].astype(np.uint64) << np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words, and each row's word offsets."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = solid[first]
    begins = np.flatnonzero(start)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    # a word's hash: its bytes times powers of an odd number, summed from its first byte on
    lane = np.arange(len(data), dtype=np.int64)
    owner = np.cumsum(start) - 1
    inside = (lane - begins[np.maximum(owner, 0)]) if len(begins) else lane
    power = _powers(int(inside[solid].max()) + 1)
    term = np.where(solid, (data.astype(np.uint64) + np.uint64(1)) * power[np.where(solid, inside, 0)], np.uint64(0))
    sums = np.add.reduceat(term, begins)
    return mix(sums), np.searchsorted(begins, offsets)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive words in each row and their row numbers; a shorter row gives one shingle of all its words."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.diff(offsets)
    power = _powers(n)
    row = np.repeat(np.arange(len(count)), count)
    left = offsets[1:][row] - np.arange(len(hashes))
    acc = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        ok = left > k
        part = hashes[k:] * power[k]
        acc[: len(part)] += np.where(ok[: len(part)], part, np.uint64(0))
    keep = (left >= n) | ((count[row] < n) & (left == count[row]))
    return mix(acc[keep] ^ _P), row[keep]
