"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]"
WS_RUN = WS + "+"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast below this many bytes, by its counted rows.
BROADCAST_BYTES = 24 << 20

#: Rows of a batch that goes to Python.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_folders: dict[str, str] = {}
#: The paths made in a session, in order.
_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what ``spark.checkpoint.dir`` names. Where that is unset a temporary
    folder serves, but only in local mode; on a cluster this is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="quire-")
    return "file://" + _own_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/quire-{uuid.uuid4().hex[:12]}-{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    made_paths(spark).append(path)
    return path


def made_paths(spark: SparkSession) -> list[str]:
    """The paths that this session made and hasn't dropped, in order."""
    return _made.setdefault(spark.sparkContext.applicationId, [])


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        made_paths(spark).remove(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Texts go to Python ``rows`` at a time at most while this holds: both sides keep a batch in memory, and whole texts are long."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(min(rows, int(before or rows)) if int(before or rows) > 0 else rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if its counted rows stay below ``limit`` bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def text_of(column: str) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of ``df``, whatever its own are called."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def named_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` for a select, also where names hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_bits(rows: int, per_block: int) -> int:
    """Bits of a block number such that a block holds about ``per_block`` of ``rows`` rows."""
    return max(1, (max(1, rows) // per_block).bit_length())
