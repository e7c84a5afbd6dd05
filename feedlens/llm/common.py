"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(c.cast("string"), F.lit("")), UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster must name one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="feedlens-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_written: list[str] = []


def cut(df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that a lost executor costs no recomputation of what stands above. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/feedlens-{tag}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*frames: DataFrame) -> None:
    """Removes tables that cut() wrote and nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            path = file.rpartition("/")[0]
            if "/feedlens-" in path:
                _delete(df.sparkSession, path)
                _written[:] = [x for x in _written if not path.endswith(x.rpartition("/")[2])]


def clear(spark: SparkSession) -> None:
    """Removes all tables that cut() wrote in this process; call it when the results read from them are stored."""
    while _written:
        _delete(spark, _written.pop())


def by_rows(
    batches: Iterator[pa.RecordBatch], texts: str, work: Callable[[list, pa.RecordBatch], pa.RecordBatch], rows: int = 256
) -> Iterator[pa.RecordBatch]:
    """Calls work(list of the column `texts`, slice) on slices of few rows, which bounds a worker's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield work(part.column(texts).to_pylist(), part)
    pa.default_memory_pool().release_unused()
