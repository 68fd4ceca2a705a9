"""Exact dedup by composable polynomial fingerprints.

A chunk's hash is ``sum(byte[i] * BASE**i)`` modulo two primes. The hash of two parts joined is
``first + BASE**len(first) * second``, so chunk hashes of one text, made anywhere and in any order,
add up to the text's fingerprint once each is multiplied by the power of its offset. Texts of
``huge_bytes`` and more are cut into chunk rows that are dealt over the cluster; other texts are
hashed where they lie.

Texts with equal fingerprint and length are then compared chunk by chunk: a streaming ``min`` and
``max`` over the chunks at each position must agree. The comparison combines on the map side, so a
group that holds a third of all rows sends a row or so from each task. Should a group's texts
differ, its members are told apart by SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, one_row_each

CHUNK = 1 << 16
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525)


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    out, x = np.empty(n, dtype=np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base % prime
    return out


def chunk_hash(chunk: np.ndarray, tables: list[np.ndarray], primes: tuple[int, ...]) -> list[int]:
    wide = chunk.astype(np.uint64)
    return [int(np.dot(wide, t[: wide.size])) % p for t, p in zip(tables, primes, strict=True)]


def join_hashes(parts: list[tuple[list[int], int]], primes: tuple[int, ...]) -> list[int]:
    """Combine (hash, offset) parts by length-shifted addition."""
    return [sum(h[k] * pow(BASES[k], at, p) for h, at in parts) % p for k, p in enumerate(primes)]


def _packed(h: list[int]) -> int:
    return h[0] << 31 | h[1]


def _hash_rows(primes: tuple[int, ...], chunk: int, offset: bool):
    """mapInArrow body: the last column is binary; a ``chunk_no`` before it gives its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_power_table(b, p, chunk) for b, p in zip(BASES, primes, strict=True)]
        for batch in batches:
            found: list[list[int]] = []
            at = batch.column(batch.schema.get_field_index("chunk_no")).to_pylist() if offset else None
            for row, value in enumerate(batch.column(batch.num_columns - 1)):
                held = value.as_buffer()
                data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
                first = at[row] * chunk if at else 0
                parts = [(chunk_hash(data[i : i + chunk], tables, primes), first + i) for i in range(0, data.size, chunk)]
                found.append(join_hashes(parts, primes))
            keep = batch.columns[:-1]
            h1, h2 = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*keep, h1, h2], names=[*batch.schema.names[:-1], "h1", "h2"])

    return run


def _chunks(body: Column, chunk: int) -> Column:
    """The chunks of a binary column; one empty chunk for an empty value."""
    last = F.greatest((F.octet_length(body) - 1), F.lit(0)).cast("long")
    at = F.sequence(F.lit(0).cast("long"), (last / chunk).cast("long"))
    return F.transform(at, lambda i: F.substring(body, (i * chunk + 1).cast("int"), F.lit(chunk)))


def fingerprints(docs: DataFrame, chunk: int = CHUNK, huge_bytes: int = 1 << 24, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """doc_id, sha (binary), n_bytes and fp of each row of ``docs``; a null text counts as empty."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("body"))
    kind = base.schema["doc_id"].dataType.simpleString()
    whole = base.where(F.col("n_bytes") < huge_bytes).mapInArrow(_hash_rows(primes, chunk, False), f"doc_id {kind}, sha binary, n_bytes long, h1 long, h2 long")
    cells = base.where(F.col("n_bytes") >= huge_bytes).select("doc_id", "sha", "n_bytes", F.posexplode(_chunks(F.col("body"), chunk)).alias("chunk_no", "body"))
    # Dealt by (text, chunk): the chunks of one text are hashed by many tasks.
    cells = cells.repartition("sha", "chunk_no").mapInArrow(_hash_rows(primes, chunk, True), f"doc_id {kind}, sha binary, n_bytes long, chunk_no int, h1 long, h2 long")
    one = cells.groupBy("sha", "n_bytes", "chunk_no").agg(F.max("h1").alias("h1"), F.max("h2").alias("h2"))
    sums = one.groupBy("sha", "n_bytes").agg((F.sum("h1") % primes[0]).alias("h1"), (F.sum("h2") % primes[1]).alias("h2"))
    owners = cells.where("chunk_no = 0").select("doc_id", "sha", "n_bytes")
    both = whole.unionByName(owners.join(sums, ["sha", "n_bytes"]).select(whole.columns))
    return both.select("doc_id", "sha", "n_bytes", F.expr("shiftleft(h1, 31) | h2").alias("fp"))


def exact_groups(docs: DataFrame, chunk: int = CHUNK, huge_bytes: int = 1 << 24, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """Group equal texts; of each group the row with the largest doc_id stays.

    Returns one row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.
    A null text equals an empty one. Rows that repeat a doc_id with the same text count as
    members and share the verdict. A null doc_id never stays unless all of its group are null,
    when keep_id is null and kept is false. Other columns of ``docs`` are not read.
    """
    rows = cut(fingerprints(docs, chunk, huge_bytes, primes))
    key = ["fp", "n_bytes"]
    # Written, as the groups are below, so that joins with them are free to split a large group's rows over tasks.
    shared = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key))
    members = rows.join(shared, key).select("doc_id", "sha", *key).distinct()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("body"))
    m = members.select(F.col("doc_id").alias("m_id"), F.col("n_bytes").alias("m_bytes"), "sha", "fp")
    held = texts.join(m, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("n_bytes") == F.col("m_bytes"))).where(F.unhex(F.sha2("body", 256)) == F.col("sha"))
    cells = held.select(*key, F.posexplode(_chunks(F.col("body"), chunk)).alias("chunk_no", "cell"))
    same = cells.groupBy(*key, "chunk_no").agg((F.min("cell") == F.max("cell")).alias("same"))
    unlike = same.groupBy(key).agg(F.bool_and("same").alias("same")).where("not same").select(*key, F.lit(True).alias("unlike"))
    told = rows.join(unlike, key, "left").withColumn("part", F.when(F.col("unlike"), F.col("sha")).otherwise(F.lit(b"")))
    told = told.select("doc_id", "sha", *key, "part")
    groups = cut(told.groupBy(*key, "part").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return told.join(groups, [*key, "part"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each text, one with the largest doc_id; the columns stay as they are.

    Rows are told apart by doc_id and text: a doc_id with several texts stays with each that no larger
    id has. Of rows that repeat both, the one that is least by its other columns stays. A row without
    a doc_id stays only if all of its copies have none, and then one of them.
    """
    told = exact_groups(docs).select("doc_id", F.unhex("text_sha256").alias("sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"))
    return one_row_each(docs, told)
