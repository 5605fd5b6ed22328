"""Delivery of stream batches that may run twice: each row of a batch is in the table once.

A batch's rows go to a folder of its own, which a repeated run overwrites, and then a marker says that they
are all there. Readers take only folders with a marker. A run that ended between the two leaves nothing
behind that is read, and a run that ended after the marker is not repeated. The number of folders is
kept down by merging old batches into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pinwatch.session import write_compact


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _marked(spark: SparkSession, path: str, table: str) -> list[tuple[str, int]]:
    """Kinds and numbers of the table's markers: ``batch-7``, ``upto-5``."""
    target, files = _files(spark, f"{path}/_ledger/{table}")
    if not files.exists(target):
        return []
    names = [status.getPath().getName().rpartition("-") for status in files.listStatus(target)]
    return sorted((kind, int(number)) for kind, _, number in names)


def _mark(spark: SparkSession, path: str, table: str, kind: str, number: int) -> None:
    target, files = _files(spark, f"{path}/_ledger/{table}/{kind}-{number}")
    files.create(target, True).close()


def _folders(spark: SparkSession, path: str, table: str) -> tuple[list[str], int, list[int]]:
    """Folders that count, the last batch that was merged (-1 for none), and the batches after it."""
    marks = _marked(spark, path, table)
    merged = max((n for kind, n in marks if kind == "upto"), default=-1)
    batches = [n for kind, n in marks if kind == "batch" and n > merged]
    folders = [f"{path}/{table}/upto-{merged}"] if merged >= 0 else []
    return folders + [f"{path}/{table}/batch-{n}" for n in batches], merged, batches


def is_delivered(spark: SparkSession, path: str, table: str, batch: int) -> bool:
    _, merged, batches = _folders(spark, path, table)
    return batch <= merged or batch in batches


def deliver(rows: DataFrame, path: str, table: str, batch: int) -> None:
    """Put the rows of a batch into a table, unless they are there already."""
    spark = rows.sparkSession
    if not is_delivered(spark, path, table, batch):
        write_compact(rows, f"{path}/{table}/batch-{batch}", "overwrite")
        _mark(spark, path, table, "batch", batch)


def deliver_batches(path: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the rows that each table takes of a batch, each table with a marker of its own, so
    that a repeated run writes only what is still missing."""

    def write(rows: DataFrame, batch: int) -> None:
        missing = [t for t in tables if not is_delivered(rows.sparkSession, path, t, batch)]
        if not missing:
            return
        if len(missing) == 1:
            deliver(tables[missing[0]](rows), path, missing[0], batch)
            return
        held = rows.persist()  # state is read once for all tables
        try:
            for table in missing:
                deliver(tables[table](held), path, table, batch)
        finally:
            held.unpersist()

    return write


def delivered(spark: SparkSession, path: str, table: str, schema) -> DataFrame:
    """All rows of the batches that were delivered whole."""
    folders, _, _ = _folders(spark, path, table)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge_batches(spark: SparkSession, path: str, table: str, schema, keep: int = 0) -> None:
    """Merge all but the last ``keep`` batches into one folder, and remove the folders merged. A run that ends
    half-way leaves the table as it was, or merged with folders that nobody reads."""
    folders, merged, batches = _folders(spark, path, table)
    old = batches[: len(batches) - keep]
    if not old:
        return
    gone = folders[: len(folders) - keep]
    write_compact(spark.read.schema(schema).parquet(*gone), f"{path}/{table}/upto-{old[-1]}", "overwrite")
    _mark(spark, path, table, "upto", old[-1])
    marks = [f"{path}/_ledger/{table}/batch-{n}" for n in old] + ([f"{path}/_ledger/{table}/upto-{merged}"] if merged >= 0 else [])
    for name in marks + gone:
        target, files = _files(spark, name)
        files.delete(target, True)
