"""Flight tables as CSV files."""

from __future__ import annotations

import csv
import functools
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelens.fixed_values import CSV_MISSING
from farelens.functions import null_if_nan
from farelens.schema import FLIGHT_SCHEMA


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column; done once, right after a read."""
    floating = {
        field.name: null_if_nan(F.col(field.name))
        for field in df.schema.fields
        if isinstance(field.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floating) if floating else df


class FlightScan(NamedTuple):
    """Rows whose values all fit their columns, and what is wrong with the others: file, line, column, value."""

    rows: DataFrame
    rejects: DataFrame


def _first_line(spark: SparkSession, file: str) -> str:
    """First line of a file of any store that Spark reads, unpacked if need be."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        unpacked = stream if codec is None else codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(unpacked, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def _by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files by the column names in their first line; one short read for each file, none for an empty one."""
    files = spark.read.text(path).inputFiles()
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda f: _first_line(spark, f).removeprefix("\ufeff"), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, headers, strict=True):
        if header.strip():
            groups.setdefault(tuple(name.strip() for name in next(csv.reader([header]))), []).append(file)
    return groups


def _texts_by_name(spark: SparkSession, path: str, wanted: T.StructType) -> DataFrame:
    """The wanted columns as text, whatever their order in each file, with ``_file``, ``_line`` and whether a row has too many fields."""
    groups = _by_header(spark, path)
    missing = [f.name for f in wanted.fields if not any(f.name in header for header in groups)]
    if missing and groups:
        raise ValueError(f"no file has the columns: {', '.join(missing)}")
    tables = []
    for header, files in groups.items():
        # Fields are read by place; of columns that share a name the first one counts.
        places = [f"_{k}" for k in range(len(header))]
        # One place more than the header has shows rows with too many fields; short rows end in nulls.
        kinds = T.StructType([T.StructField(p, T.StringType()) for p in [*places, "_over", "_text"]])
        reader = spark.read.schema(kinds).option("header", True).option("encoding", "UTF-8")
        # A reader that skips columns does not see how many fields a row has, and keeps no text of it.
        reader = reader.option("columnNameOfCorruptRecord", "_text").option("columnPruning", False)
        raw = reader.csv(files).withColumn("_file", F.col("_metadata.file_path"))
        line = F.coalesce("_text", F.to_csv(F.struct(*places, "_over")))
        named = [F.col(places[header.index(f.name)]) if f.name in header else F.lit(None).cast("string") for f in wanted.fields]
        tables.append(
            raw.select(
                *[c.alias(f.name) for c, f in zip(named, wanted.fields)], "_file", line.alias("_line"), F.col("_over").isNotNull().alias("_odd")
            )
        )
    if not tables:
        empty = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
        return spark.createDataFrame([], empty).selectExpr("*", "'' AS _file", "'' AS _line", "false AS _odd")
    return functools.reduce(DataFrame.unionByName, tables)


def _wanted(schema: T.StructType | str | None) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema or FLIGHT_SCHEMA


def scan_flights(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> FlightScan:
    """Flight CSV files read by column name, file by file, and the rows that do not fit.

    Files may differ in the order of their columns, have more of them, or lack some that other files have (null there). A row with a value that
    is neither of its column's type nor one of the missing tokens is left out, and so is one with too many fields; a short row ends in nulls.
    ``rejects`` has an entry for each such value, and one without a column for each such row. Both tables are lazy.
    """
    wanted = _wanted(schema)
    texts = _texts_by_name(spark, path, wanted)
    checked = [f for f in wanted.fields if not isinstance(f.dataType, T.StringType)]
    misfits = [
        F.when(_known(f).isNotNull() & _known(f).try_cast(f.dataType).isNull(), F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("value")))
        for f in checked
    ]
    bad = F.filter(F.array(*misfits), lambda x: x.isNotNull()) if misfits else F.array()
    odd_row = F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value"))
    found = F.when(F.col("_odd"), F.array(odd_row)).otherwise(bad)
    marked = texts.withColumn("_bad", found)
    kept = marked.filter(F.size("_bad") == 0).select(*[_known(f).try_cast(f.dataType).alias(f.name) for f in wanted.fields])
    rejects = marked.withColumn("_b", F.explode("_bad")).select(F.col("_file").alias("file"), F.col("_line").alias("line"), "_b.column", "_b.value")
    return FlightScan(nan_to_null(kept), rejects)


def read_flights(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Read flight CSV files with header rows by column name; a leading byte order mark is accepted.

    The operational schema is the default. Pass another schema for another spelling, or ``"infer"`` to
    let Spark find the types, which costs one more pass over the files; a column with a broken number then stays text. With a
    schema, a value that is neither of its column's type nor one of the missing tokens fails the query, and so does a row
    with too many fields; ``scan_flights`` sets them aside instead.
    """
    if schema == "infer":
        df = spark.read.option("header", True).option("encoding", "UTF-8").option("inferSchema", True).csv(path)
        texts = {
            field.name: F.when(~F.col(field.name).isin(*CSV_MISSING), F.col(field.name))
            for field in df.schema.fields
            if isinstance(field.dataType, T.StringType)
        }
        return nan_to_null(df.withColumns(texts) if texts else df)
    wanted = _wanted(schema)
    raw = _texts_by_name(spark, path, wanted)
    broken = F.raise_error(F.concat(F.lit("row with too many fields: "), F.col("_line")))
    whole = raw.filter(F.when(F.col("_odd"), broken.cast("boolean")).otherwise(True))
    return nan_to_null(whole.select(*[_typed(f).alias(f.name) for f in wanted.fields]))


def _known(field: T.StructField) -> Column:
    """A text column, null for missing tokens; other kinds than text without outer space."""
    if isinstance(field.dataType, T.StringType):
        return F.when(~F.col(field.name).isin(*CSV_MISSING), F.col(field.name))
    text = F.trim(F.col(field.name))
    return F.when((text != "") & ~text.isin(*CSV_MISSING), text)


def _typed(field: T.StructField) -> Column:
    """A text column in its type: missing tokens are null, and what cannot be read fails, named with its column."""
    known = _known(field)
    if isinstance(field.dataType, T.StringType):
        return known
    broken = F.raise_error(F.concat(F.lit(f"column {field.name} cannot hold: "), F.trim(F.col(field.name))))
    return F.when(known.isNotNull(), F.coalesce(known.try_cast(field.dataType), broken.cast(field.dataType)))


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """Write a table as UTF-8 CSV files with a header row and no index column; ``compression``: a codec of Spark's writer, such as gzip."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("compression", compression).csv(path)
