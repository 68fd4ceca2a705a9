"""Session helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.plans.lineage import cut, spend  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Body = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Body, forget: Callable[[], None] = lambda: None) -> Body:
    """A mapInArrow body that gives its memory back when a task ends: Spark keeps idle Python workers, and their freed pages with them."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            give_back()

    return body


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def one_row_each(docs: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each doc_id and text; the columns stay as they are.

    ``told`` has a row for each row of ``docs``: doc_id, sha (SHA-256 of the text, a null one counts as
    empty) and stays. Of rows that repeat both, the one that is least by its other columns stays.
    """
    own, copy_id, copy_sha, row = (free_name(name, docs.columns) for name in ("own_sha", "copy_id", "copy_sha", "row"))
    each = told.groupBy(F.col("doc_id").alias(copy_id), F.col("sha").alias(copy_sha)).agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("copies"))
    marked = cut(each.where("not stays or copies > 1"))
    rows = docs.withColumn(own, F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))

    def same(marks: DataFrame) -> tuple[DataFrame, Column]:
        keys = marks.select(copy_id, copy_sha)
        return keys, F.col("doc_id").eqNullSafe(keys[copy_id]) & (F.col(own) == keys[copy_sha])

    left = rows.join(*same(marked), "left_anti").select(docs.columns)
    again = marked.where("stays")
    if again.isEmpty():
        return left
    one = rows.join(*same(again), "left_semi").groupBy("doc_id", own).agg(F.min(F.struct(*docs.columns)).alias(row))
    return left.unionByName(one.select(f"{row}.*"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or a longer one if a column has it (in any case of letters)."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
