"""Stored op logs: range-clustered Parquet, checkpoints, and the pointer that names the current one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.model import OPS, PUT
from kvlake.operators.read import newest


@dataclass(frozen=True)
class Options:
    """How a log is written. ``file_rows``: rows of a file at most; ``bloom_keys``: distinct keys that a file's bloom filter is sized for, 0 for none."""

    file_rows: int = 4_000_000
    bloom_keys: int = 1_000_000
    block_bytes: int = 128 << 20
    compression: str = "zstd"


def write_sorted(ops: DataFrame, path: str, options: Options = Options(), partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Write ops in ranges of keys, within a file by key and newest first: key bounds then prune files and row groups.

    Ranges come from a sample and split between versions too, so one hot key's history is dealt over several files.
    """
    order = [F.col("key"), F.desc("seq")]
    dealt = ops.repartitionByRange(partitions, *order) if partitions else ops.repartitionByRange(*order)
    writer = dealt.sortWithinPartitions(*order).write.mode(mode).option("compression", options.compression).option("maxRecordsPerFile", options.file_rows).option("parquet.block.size", options.block_bytes)
    if options.bloom_keys:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(options.bloom_keys))
    writer.parquet(path)


def append(ops: DataFrame, path: str, options: Options = Options()) -> None:
    """Add a sorted run to a log."""
    write_sorted(ops, path, options, mode="append")


def open_ops(spark: SparkSession, path: str) -> DataFrame:
    """The ops of a log; its schema is fixed, so none is inferred."""
    return spark.read.schema(OPS).parquet(path)


def checkpoint(ops: DataFrame, seq: int, path: str, options: Options = Options(), partitions: int | None = None) -> None:
    """Write the newest pair of every key at a sequence number, bookkeeping keys too; the target must not exist."""
    live = newest(ops.where(F.col("seq") <= seq)).where(F.col("kind") == PUT)
    write_sorted(live.select("seq", "key", "kind", "value"), path, options, partitions)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's view of a path: any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def set_current(spark: SparkSession, root: str, name: str) -> None:
    """Point ``root/CURRENT`` at a version: written aside, then renamed over in one step, so readers see the old or the new one."""
    fs, at, jvm = _file_system(spark, f"{root}/CURRENT.next")
    out = fs.create(at, True)
    out.write(bytearray(name.encode()))
    out.close()
    hadoop = jvm.org.apache.hadoop.fs
    mode = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(mode, 1)
    over[0] = mode.OVERWRITE
    target = fs.makeQualified(hadoop.Path(f"{root}/CURRENT"))
    hadoop.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(at), target, over)


def current(spark: SparkSession, root: str) -> str | None:
    """The version that CURRENT names, or None."""
    fs, at, _ = _file_system(spark, f"{root}/CURRENT")
    return spark.read.text(f"{root}/CURRENT").first()[0] if fs.exists(at) else None


def install(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Make a checkpoint under ``root`` the current one and open it; doing it again changes nothing."""
    if current(spark, root) != name:
        open_ops(spark, f"{root}/{name}").limit(1).count()
        set_current(spark, root, name)
    return open_current(spark, root)


def open_current(spark: SparkSession, root: str) -> DataFrame:
    name = current(spark, root)
    if name is None:
        raise FileNotFoundError(f"no CURRENT in {root}")
    return open_ops(spark, f"{root}/{name}")
