"""What the corpus operators share: input shaping, shared scratch space and Arrow chunks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Bytes of text that one NumPy pass works on; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 21
#: Bytes of an Arrow batch between an executor and its Python worker, of which both hold several at a time.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as an empty one; whatever other columns there are go."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names like these that `docs` does not have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def text_digest(column):
    """The SHA-256 of a text, a null text being empty."""
    return F.unhex(F.sha2(F.coalesce(column.cast("string"), F.lit("")), 256))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which `clean` deletes."""
    path = shared_folder(spark, name)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Folders that this process has made, by Spark application.
_made: dict[str, list[str]] = {}


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(conf).delete(where, True)


def clean(spark: SparkSession) -> int:
    """Deletes the intermediate folders of this application, once no result that reads them is needed any more."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def release(*frames: DataFrame) -> None:
    """Deletes tables that `stored` made, once all that was made of them is stored itself."""
    for df in frames:
        _delete(df.sparkSession, [df.stored_at])
        _made[df.sparkSession.sparkContext.applicationId].remove(df.stored_at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder: later uses read them, and no executor's loss undoes them.

    The shuffle files of the plan that made them have no further use and go at once."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(setting, before)
    out = spark.read.parquet(path)
    out.stored_at = path
    return out


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that a plan reads; for files, their size. Where it has none, the bytes of the
    string columns, which are counted."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n < 1 << 56:
        return n
    sizes = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return sum(x or 0 for x in df.agg(*sizes).first()) if sizes else 0


def shards(df: DataFrame, per_shard: int = 24 << 20) -> int:
    """How many shards keep each near a constant size, however large the input is."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // per_shard))


def by_shard(df: DataFrame, n: int) -> DataFrame:
    """The rows dealt out by their column `shard`, 0 to n - 1: one partition each, so that no task gets two by chance."""
    return df.repartitionById(n, F.col("shard"))


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most BATCH_BYTES, or one row; a lower limit of its own stays.

    By Spark's default a batch has up to 64 MB. Plans are executed later, so the setting stays."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    bytes_ = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if bytes_(spark.conf.get(setting)) > BATCH_BYTES:
        spark.conf.set(setting, f"{BATCH_BYTES}b")


def _trim() -> None:
    """Gives memory that this process has freed back to the system, where the allocators know how."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` for mapInArrow in a worker that keeps nothing beside it: neither the encoders of tasks before, for workers
    outlive tasks, nor memory that it has freed itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sys.modules.get("millrace.llm.tokens")
        if tokens is not None:
            tokens.encoder.cache_clear()
        _trim()
        yield from work(batches)
        _trim()

    return run


class Chunk(NamedTuple):
    """Consecutive documents of one Arrow batch: rows [at, at + n) of it, their bytes joined."""

    batch: pa.RecordBatch
    at: int
    data: np.ndarray
    starts: np.ndarray  # n + 1 byte offsets into data

    @property
    def n(self) -> int:
        return len(self.starts) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name)).slice(self.at, self.n)

    def ids(self) -> np.ndarray:
        """Ids as int64; a null id counts as the smallest of all."""
        return self.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The batches cut into chunks of about `limit` bytes of text, without a copy of the text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a = batch.column(batch.schema.get_field_index(column))
        kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
        _, offsets, data = a.buffers()
        ends = np.frombuffer(offsets, kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
            yield Chunk(batch, i, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            i = j


def binary(values: Iterable[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A batch with just the schema's columns, in its order."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
