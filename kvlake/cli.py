"""Command line over a stored log: get, put, del, scan and bench.

Exit codes: 0 done, 1 failed, 2 wrong usage, 3 no such key.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable, Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.model import DELETE, OPS, PUT, RESERVED_PREFIX
from kvlake.operators import read
from kvlake.sources import store

OK, FAILED, USAGE, NOT_FOUND = 0, 1, 2, 3


class _Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise _Usage(f"{self.format_usage()}{message}")


def _parser() -> _Parser:
    parser = _Parser(prog="kvlake", add_help=False)
    parser.add_argument("-data", default="data")
    commands = parser.add_subparsers(dest="command", required=True, parser_class=_Parser)
    get = commands.add_parser("get", add_help=False)
    get.add_argument("-hex", action="store_true")
    get.add_argument("key")
    put = commands.add_parser("put", add_help=False)
    put.add_argument("key")
    put.add_argument("value")
    commands.add_parser("del", add_help=False).add_argument("key")
    scan = commands.add_parser("scan", add_help=False)
    scan.add_argument("-start")
    scan.add_argument("-end")
    scan.add_argument("-limit", type=int, default=0)
    bench = commands.add_parser("bench", add_help=False)
    bench.add_argument("-n", type=int, default=10_000)
    bench.add_argument("-value-size", type=int, default=100)
    bench.add_argument("-read-ratio", type=float, default=0.5)
    return parser


def _ops(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return store.open_ops(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], OPS)


def _write(spark: SparkSession, path: str, kind: int, key: bytes, value: bytes | None) -> None:
    if not key:
        raise ValueError("key must not be empty")
    if key.startswith(RESERVED_PREFIX):
        raise ValueError("key is reserved")
    seq = _ops(spark, path).agg(F.max("seq")).first()[0] or 0
    store.append(spark.createDataFrame([(seq + 1, key, kind, value)], OPS), path)


def _bench(spark: SparkSession, path: str, n: int, value_size: int, read_ratio: float, out: TextIO) -> None:
    from kvlake.functions import workload

    reads = int(n * read_ratio)
    start = time.monotonic()
    seq = _ops(spark, path).agg(F.max("seq")).first()[0] or 0
    store.append(workload.fill(spark, n - reads, value_size, shuffled=True).withColumn("seq", F.col("seq") + seq), path)
    wrote = time.monotonic()
    wanted = workload.fill(spark, reads, 0, shuffled=True, seed=2).select("key")
    found = read.multi_get(_ops(spark, path), wanted).agg(F.count_if("found")).first()[0]
    done = time.monotonic()
    print(f"put {n - reads} ops {(n - reads) / (wrote - start):.0f} ops/s", file=out)
    print(f"get {reads} ops {reads / max(done - wrote, 1e-9):.0f} ops/s, {found} found", file=out)


def main(arguments: Iterable[str], spark: Callable[[], SparkSession], out: TextIO = sys.stdout, err: TextIO = sys.stderr) -> int:
    """``spark`` makes the session once the arguments are known to be right."""
    try:
        a = _parser().parse_args(list(arguments))
    except _Usage as e:
        print(e, file=err)
        return USAGE
    try:
        session = spark()
        if a.command == "get":
            row = read.get(_ops(session, a.data), a.key.encode()).first()
            if row is None:
                print("kvlake: key not found", file=err)
                return NOT_FOUND
            print(bytes(row.value).hex() if a.hex else bytes(row.value).decode("utf-8", "replace"), file=out)
        elif a.command == "put":
            _write(session, a.data, PUT, a.key.encode(), a.value.encode())
        elif a.command == "del":
            _write(session, a.data, DELETE, a.key.encode(), None)
        elif a.command == "scan":
            pairs = read.scan(_ops(session, a.data), a.start.encode() if a.start else None, a.end.encode() if a.end else None, a.limit or None)
            for row in pairs.toLocalIterator():
                print(f"{bytes(row.key).decode('utf-8', 'replace')}\t{bytes(row.value).decode('utf-8', 'replace')}", file=out)
        else:
            _bench(session, a.data, a.n, a.value_size, a.read_ratio, out)
    except Exception as e:  # whatever failed, the caller gets a code and a line
        print(f"kvlake: {e}", file=err)
        return FAILED
    return OK


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], lambda: SparkSession.builder.appName("kvlake").getOrCreate()))
