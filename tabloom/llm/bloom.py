"""Bit-array filters built by Spark in shards of one megabyte and broadcast up to a stated bound.

``LogFrequencyBloom`` holds quantised counts: an item whose quantised count is q is entered with the
levels 1..q, and a lookup probes 1, 2, ... until the first miss.  Errors are one-sided (a count can only
come out too high).  The size follows the number of entries up to ``max_shards`` megabytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


from .common import mix, pack, pack_sorted, unpack, unpack_sorted

SHARD_BITS = 1 << 23
DEALT = 1 << 20  # items packed at a time
HASHES = 5
STEP = np.uint64(0x9E3779B97F4A7C15)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def positions(h: np.ndarray, level) -> np.ndarray:
    """(HASHES, n) bit positions inside the shard, all in one 64-byte line of it."""
    g = mix(h + np.asarray(level, np.uint64) * STEP)
    line = (g >> np.uint64(50)) << np.uint64(9)
    return np.stack([line + ((g >> np.uint64(9 * j)) & np.uint64(511)) for j in range(HASHES)])


class LogFrequencyBloom:
    def __init__(self, bits: np.ndarray, shards: int):
        self.bits, self.shards = bits, shards

    def hit(self, h: np.ndarray, level: int) -> np.ndarray:
        pos = positions(h, level) + shard_of(h, self.shards) * np.uint64(SHARD_BITS)
        ok = np.ones(len(h), np.uint8)
        for p in pos:
            ok &= self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)
        return (ok & 1).astype(bool)

    def count_levels(self, h: np.ndarray, most: int = 1 << 14) -> np.ndarray:
        q = np.zeros(len(h), np.int32)
        live, level = np.arange(len(h)), 1
        while len(live) and level <= most:
            live = live[self.hit(h[live], level)]
            q[live] = level
            level += 1
        return q


DEAL = "shard int, m int, h binary, q binary"


def deal(h: np.ndarray, q: np.ndarray, shards: int) -> pa.RecordBatch:
    """Packed items (hash, quantised count) by shard."""
    o = np.argsort(h)  # shards are ranges of the hash
    h, q = h[o], q[o].astype(np.int32)
    at = shard_of(h, shards)
    ends = [*np.flatnonzero(np.r_[True, at[1:] != at[:-1]][:len(h)]).tolist(), len(h)]
    rows = [(int(at[lo]), hi - lo, pack_sorted(h[lo:hi]), pack(q[lo:hi])) for lo, hi in zip(ends[:-1], ends[1:])]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      names=["shard", "m", "h", "q"])


def build(items: DataFrame, shards: int, make_hash) -> LogFrequencyBloom:
    """Filter of ``items`` (key columns..., q int last): ``make_hash`` maps the Arrow columns before q
    to uint64 hashes."""
    names = items.columns

    def run(batches):
        held, some = [], 0
        for b in batches:
            h = make_hash(*[b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names) - 1)])
            held.append((h, b.column(len(names) - 1).to_numpy(zero_copy_only=False)))
            some += len(h)
            if some >= DEALT:
                yield deal(*(np.concatenate(x) for x in zip(*held)), shards)
                held, some = [], 0
        if some:
            yield deal(*(np.concatenate(x) for x in zip(*held)), shards)

    return filled(items.mapInArrow(run, DEAL), shards)


def filled(dealt: DataFrame, shards: int) -> LogFrequencyBloom:
    """Filter of dealt items.  Every shard is one group of bounded size; the shards (``shards`` MB in all, a
    bound the caller has set) come to the driver for the broadcast."""
    def fill(t: pa.Table) -> pa.Table:
        bits = np.zeros(SHARD_BITS, np.uint8)
        for m, h, q in zip(*(t.column(x).to_pylist() for x in ("m", "h", "q"))):
            h, q = unpack_sorted(h, m), unpack(q, m, np.int32)
            for lo in range(0, len(h), 1 << 18):
                hh, qq = h[lo: lo + (1 << 18)], q[lo: lo + (1 << 18)]
                level, live = 1, np.arange(len(hh))
                while len(live):
                    bits[positions(hh[live], level).ravel()] = 1
                    level += 1
                    live = live[qq[live] >= level]
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()),
                         "bits": pa.array([packed], pa.binary())})

    got = dealt.groupBy("shard").applyInArrow(fill, "shard int, bits binary")
    bits = np.zeros(shards * (SHARD_BITS // 8), np.uint8)
    for r in got.toLocalIterator():
        at = r["shard"] * (SHARD_BITS // 8)
        bits[at: at + SHARD_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return LogFrequencyBloom(bits, shards)


def shards_for(events: int, bits_per_event: float, max_shards: int) -> int:
    return int(max(1, min(max_shards, -(-events * bits_per_event // SHARD_BITS))))



