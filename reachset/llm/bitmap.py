"""A bitmap of fixed size over hashed keys, to pass over rows that a later join would drop.

bits / 8 bytes reach the driver and the tasks, whatever the number of keys; a bit shared by chance only lets a row through
to the join, which stays exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 27
#: Bits for lists of members; small, as drivers of long sessions keep what they broadcast for a while.
MEMBER_BITS = 1 << 23
#: Bits for lists of lines, which are several to a member.
LINE_BITS = 1 << 26
CHUNK = 1 << 16  # bits in one row


def _pack(batches):
    for b in batches:
        rows = []
        for places in b.column("places"):
            bits = np.zeros(CHUNK, bool)
            bits[places.values.to_numpy()] = True
            rows.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(rows, pa.binary())], names=["chunk", "bits"])


def bitmap_of(keys: DataFrame, hashed: Column, bits: int = BITS) -> np.ndarray:
    """Bit hashed mod bits is set for each row; hashed is a column of well mixed 64-bit values."""
    bit = hashed.bitwiseAND(F.lit(bits - 1))
    chunks = keys.select(F.shiftright(bit, 16).alias("chunk"), bit.bitwiseAND(F.lit(CHUNK - 1)).cast("int").alias("place")).distinct()
    packed = chunks.groupBy("chunk").agg(F.collect_list("place").alias("places")).mapInArrow(_pack, "chunk long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in packed.toLocalIterator():
        out[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def test_bits(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    bit = hashed & np.uint64(8 * len(bitmap) - 1)
    return ((bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1) == 1


#: Keys that a task remembers when rows with one key are let through once.
REMEMBERED = 1_000_000


def _keep(shared, columns: tuple[str, ...], once: bool):
    def run(batches):
        seen: set = set()
        for b in batches:
            at = np.flatnonzero(test_bits(shared.value, b.column("key__").to_numpy().view(np.uint64)))
            if once and len(at):
                fresh = []
                for i, key in zip(at.tolist(), zip(*[b.column(c).take(pa.array(at)).to_pylist() for c in columns])):
                    if key not in seen:
                        seen.add(key)
                        fresh.append(i)
                if len(seen) > REMEMBERED:
                    seen.clear()
                at = np.array(fresh, np.int64)
            if len(at):
                yield b.take(pa.array(at)).drop_columns("key__")

    return run


def only_members(rows: DataFrame, keys: DataFrame, *columns: str, bits: int = MEMBER_BITS, once: bool = False) -> DataFrame:
    """rows without most of those whose ``columns`` are not among keys' ``columns``; all rows with a key stay.

    once: of rows with equal ``columns``, which then stand for each other, a task lets the first through (and again what it forgot).
    """
    shared = rows.sparkSession.sparkContext.broadcast(bitmap_of(keys, F.xxhash64(*columns), bits))
    return rows.withColumn("key__", F.xxhash64(*columns)).mapInArrow(_keep(shared, columns, once), rows.schema)
