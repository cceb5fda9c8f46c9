"""Tables written to a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def new_folder(folder: str, name: str) -> str:
    """Path of a fresh folder below ``folder``; nothing is created yet."""
    if not folder:
        raise ValueError("name a folder that all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, folder: str) -> DataFrame:
    """Write a table that several branches or passes read, so that its inputs are scanned once, and read it back.

    Meant for route-level tables and for the few columns that passes need. ``folder`` is one that all executors share; the files stay until it is cleared.
    """
    path = new_folder(folder, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
