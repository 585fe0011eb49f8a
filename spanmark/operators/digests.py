"""SHA-256 of ordered rows, of a flat string of any size or block by block; no value holds more than one row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def flat(rows: DataFrame, groups: list[str], order: list[str], piece: Column, between: str, weight: Column | None = None) -> DataFrame:
    """groups, n, digest: how many rows, and the SHA-256 of their pieces in order, joined; null pieces are left out. weight: a whole number,
    of which the sum comes too.

    A group is sorted on disk and read row by row, so memory is bounded; its time is not, since one SHA-256 is one
    sequence: a group is a task's."""
    names = [f"group {k}" for k in range(len(groups))]
    held = rows.select(*(F.col(g).alias(n) for g, n in zip(groups, names)), *order, piece.cast("string").alias("piece of the digest"), (F.lit(0) if weight is None else weight).cast("long").alias("weight"))
    dealt = held.repartition(*names).sortWithinPartitions(*names, *order).select(*names, "piece of the digest", "weight")
    schema = held.select(*names).schema.add("n", "long").add("digest", "string").add("weight", "long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, key, n, heavy, begun, sha = None, None, 0, 0, False, hashlib.sha256()

        def row() -> pa.RecordBatch:
            columns = [pa.array([k], t) for k, t in zip(key, kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n], pa.int64()), pa.array([sha.hexdigest()]), pa.array([heavy], pa.int64())], names=[*names, "n", "digest", "weight"])

        for b in batches:
            kinds = [b[c].type for c in names]
            for now, text, w in zip(zip(*(b[c].to_pylist() for c in names)), b["piece of the digest"], b["weight"].to_pylist()):
                if now != key:
                    if key is not None:
                        yield row()
                    key, n, heavy, begun, sha = now, 0, 0, False, hashlib.sha256()
                n, heavy = n + 1, heavy + w
                if text.is_valid:
                    if begun:
                        sha.update(between.encode())
                    sha.update(text.as_buffer())
                    begun = True
        if key is not None:
            yield row()

    out = dealt.mapInArrow(hashed, schema)
    return out.select(*(F.col(n).alias(g) for g, n in zip(groups, names)), "n", "digest", *["weight"] * (weight is not None))


def by_block(rows: DataFrame, group: str, ref: str, order: list[str], piece: Column, between: str, size: int = BLOCK) -> DataFrame:
    """group, n, digest: the SHA-256 of block NUL digest, joined by SOH in order of blocks. A block is the rows whose
    whole-numbered ref has the same quotient by size, and its digest the flat one of these rows."""
    numbered = rows.withColumn("block", F.expr(f"cast(`{ref}` as bigint) div {size}"))
    blocks = flat(numbered, [group, "block"], order, piece, between)
    top = flat(blocks, [group], ["block"], F.concat(F.col("block").cast("string"), F.lit("\x00"), "digest"), "\x01").select(group, "digest")
    told = blocks.groupBy(group).agg(F.sum("n").alias("n"))
    return told.join(top.withColumnRenamed(group, "of"), F.col(group).eqNullSafe(F.col("of"))).select(group, "n", "digest")
