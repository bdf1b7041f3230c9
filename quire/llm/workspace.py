"""Folders that the driver and all executors share, and small Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Bytes of a record batch that a kernel gets at once, about.
SLICE_BYTES = 1 << 23


def shared_root(spark: SparkSession) -> str:
    """The URI in ``spark.checkpoint.dir``. Where that is unset, a local folder, which only a local master
    can use; on a cluster that is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        there = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="quire-")
        there = _own[app]
    return there if "://" in there else "file://" + there


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run of an operator, made on the shared file system."""
    uri = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return uri


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: lineage ends here,
    and a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    uri = f"{fresh_dir(spark, name)}/table"
    df.write.parquet(uri)
    out = spark.read.schema(df.schema).parquet(uri)
    out._stored_in = uri
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for these tables, when nothing reads them any more. The driver's JVM collects
    garbage, after which Spark removes the shuffle files of plans that are gone."""
    for df in tables:
        system, path = fs.FileSystem.from_uri(df._stored_in.removesuffix("/table"))
        system.delete_dir(path)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def publish(system: fs.FileSystem, path: str, write) -> None:
    """Let ``write(stream)`` fill a file that appears under ``path`` only when complete,
    so a repeated or speculative attempt replaces it with the same bytes."""
    attempt = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(attempt) as out:
        write(out)
    try:
        system.move(attempt, path)
    except OSError:  # some file systems refuse to replace what another attempt has finished
        if system.get_file_info(path).type != fs.FileType.File:
            raise
        system.delete_file(attempt)


def ragged(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from numpy arrays without a Python object per element."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def planes(values: np.ndarray) -> bytes:
    """Numbers by byte planes; those of small ones are mostly zeros, which compress well."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(np.int64)[:, 0]


def dealt(part: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """(order by part, start of each part there, its end)."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)).tolist()
    return order, [0, *ends[:-1]], ends


def slices(batches, rows: int, limit: int = SLICE_BYTES):
    """Record batches of at most ``rows`` rows and ``limit`` bytes, a longer row alone. At
    the end of the input the worker gives free memory back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from _halved(batch.slice(at, rows), limit)
    release()


def _halved(batch: pa.RecordBatch, limit: int):
    if batch.num_rows <= 1 or batch.nbytes <= limit:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from _halved(batch.slice(0, half), limit)
        yield from _halved(batch.slice(half), limit)


def release() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def runs(batches, keys: list[str]):
    """(key, table) of neighbouring rows with equal keys; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist() + [batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, pa.Table.from_batches(held)
