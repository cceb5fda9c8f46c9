"""Helpers shared by the corpus operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the five control characters \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
#: Stands for a null id wherever ids are compared: null ids come after all others.
NULL_ID = (1 << 63) - 1
#: Bytes of texts or sets that a Python worker takes at once, about.
BATCH_BYTES = 2 << 20
_SETTING = "spark.checkpoint.dir"
#: Setting under which a finished query's shuffle files are deleted at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Setting of the bytes in a batch of rows that goes to Python, at most.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Written tables that are not discarded yet.
_made: list[DataFrame] = []


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="corpus-")


def work_folder(spark: SparkSession) -> str:
    """Folder that all executors share. A temporary one stands in only for a local master without the setting."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"{_SETTING} must name a folder that all executors share")
    return _local_folder()


def frozen(df: DataFrame, name: str, by: str | None = None, batch: int | None = None) -> DataFrame:
    """The table written to the shared folder and read back: computed once, and it outlives lost executors.

    With ``by`` it is written in buckets of that column, so that grouping or joining by it later moves no row of it. With ``batch`` Python
    functions behind it get batches of about that many bytes instead of 10,000 rows of any length. The files go when the session's file
    system closes.
    """
    spark = df.sparkSession
    number = uuid.uuid4().hex
    path, table = f"{work_folder(spark)}/{name}-{number}", f"{name}_{number}".replace("-", "_")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    # Once the table is written, the shuffles behind it are of no more use.
    settings = {_CLEANUP: "true"} | ({_BATCH: str(batch)} if batch else {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        if by is None:
            df.write.parquet(path)
        else:
            df.write.bucketBy(partitions(spark), by).saveAsTable(table, format="parquet", path=path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path) if by is None else spark.table(table)
    out.written_at, out.written_as = jvm_path, None if by is None else table
    _made.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frozen table that nothing reads any more."""
    path = df.written_at
    if df.written_as:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.written_as}")
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _made[:] = [table for table in _made if table is not df]


def written() -> list[DataFrame]:
    """Written tables that are not discarded."""
    return list(_made)


def discard_since(before: list[DataFrame], *kept: DataFrame) -> None:
    """Delete the tables written after ``before`` (``written`` of then), but for the ones that are kept."""
    for table in written():
        if not any(table is other for other in (*before, *kept)):
            discard(table)


def small_batches(batches: Iterator[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about ``size`` bytes: what Python makes of one stays small, however many rows arrive at once."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_or_last(column: Column) -> Column:
    """A long that orders null ids last."""
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def id_or_null(column: Column) -> Column:
    """Undo ``id_or_last``."""
    return F.nullif(column, F.lit(NULL_ID))


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(column, upper, upper.lower())


def spread(key: Column, rows: int) -> Column:
    """Salt that splits a hot key: a part for each 100,000 rows of the table, 64 at least."""
    return F.pmod(F.xxhash64(key), F.lit(max(64, -(-rows // 100_000)))).cast("int")


def as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order."""
    return df.select(*[F.col(f"`{c}`") for c in like.columns])
