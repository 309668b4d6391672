"""Tables that cut lineage in the folder all executors share, and small helpers for partition-wise operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Used only where ``spark.checkpoint.dir`` is unset, as in tests on one machine.
LOCAL_SHARED = "/tmp/checkpoints"

_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; sets one only where it is unset, on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
    return named or LOCAL_SHARED


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean, spark)
    _written.add(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Remove the files of tables that ``table`` wrote and no later step reads."""
    for df in frames:
        for path in {p for p in _written if any(p in f for f in df.inputFiles()[:1])}:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.discard(path)


def _clean(spark: SparkSession) -> None:
    for path in list(_written):
        with contextlib.suppress(Exception):  # the session may be gone at exit
            _delete(spark, path)


def in_batches(rows: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Arrow batches joined or sliced to about ``limit`` bytes of buffers each."""
    held, size = [], 0
    for batch in rows:
        if not batch.num_rows:
            continue
        step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += part.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _bits(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    x = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x & np.uint64(size - 1)).astype(np.int64), ((x >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)


def bloom(ids: DataFrame, most: int = 1 << 26, parts: int = 8) -> np.ndarray:
    """A Bloom filter, as a bit array, of the one long column of ``ids``: ten bits an id, ``most`` bits in all.

    So its size has a bound; beyond it more other ids pass, which a later join drops.
    """
    size = 1 << max(10, min(most.bit_length() - 1, (10 * ids.count()).bit_length()))

    def fill(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, bool)
        for b in rows:
            for at in _bits(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), size):
                seen[at] = True
        yield pa.record_batch({"bits": pa.array([np.packbits(seen).tobytes()], pa.binary())})

    found = np.zeros(size // 8, np.uint8)
    for row in ids.repartition(parts).mapInArrow(fill, "bits binary").toLocalIterator():
        found |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return found


def passing(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose ``key`` is, or may be, among ``ids``: a semi-join's work done before any shuffle."""
    held = rows.sparkSession.sparkContext.broadcast(bloom(ids))

    def make() -> Callable[[pa.Table], pa.Table]:
        bits = np.unpackbits(held.value).view(bool)

        def step(t: pa.Table) -> pa.Table:
            x = pc.fill_null(t[key], 0).to_numpy().astype(np.int64)
            a, b = _bits(x, len(bits))
            return t.filter(pa.array(bits[a] & bits[b]))

        return step

    return rows.mapInArrow(mapper(make), rows.schema)


def whole_groups(rows: Iterator[pa.RecordBatch], keys: list[str], limit: int = 1 << 23) -> Iterator[pa.Table]:
    """Tables of whole groups from rows that arrive sorted by ``keys``; a group may span batches."""
    rest: pa.Table | None = None
    for part in in_batches(rows, limit):
        part = part if rest is None else pa.concat_tables([rest, part])
        last = [part[k][-1].as_py() for k in keys]
        cut = part.num_rows
        while cut and [part[k][cut - 1].as_py() for k in keys] == last:
            cut -= 1
        if cut:
            yield part.slice(0, cut)
        rest = part.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mapper(make: Callable[[], Callable[[pa.Table], pa.Table | None]], limit: int = 1 << 22) -> Callable:
    """A ``mapInArrow`` function; ``make`` runs once in each task."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in in_batches(rows, limit):
            out = step(part)
            if out is not None and out.num_rows:
                yield from out.to_batches()
        give_back()

    return run


def give_back() -> None:
    """Freed memory goes back to the system: a worker outlives its task, and waits beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
