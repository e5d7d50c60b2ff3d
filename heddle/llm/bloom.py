"""A Bloom filter of 64-bit hashes that is made on the executors.

Its size follows the number of hashes up to a bound, so that it can be sent to
all executors. Beyond the bound it lets more through that isn't in it, never less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as X

#: Bits for each hash, and the filter's size as powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 20, 30
#: A hash's first bits tell its range, and with it the part of the filter.
_RANGES = 8
_U = np.uint64


def _probes(h: np.ndarray, power: int) -> Iterator[np.ndarray]:
    """Where a filter of 2^power bits tells of each hash; all places are in the hash's range."""
    with np.errstate(over="ignore"):
        top = (h >> _U(64 - _RANGES)) << _U(power - _RANGES)
        for k in (1, 2, 3):
            yield (top | (X.mix(h * _U(2 * k + 1)) >> _U(64 - power + _RANGES))).astype(np.int64)


@dataclass
class Bloom:
    bits: bytes
    power: int

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        bits, out = np.frombuffer(self.bits, np.uint8), np.ones(len(h), bool)
        for at in _probes(h, self.power):
            out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _parts(power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(0).to_numpy().view(_U)
            for r in np.unique(h >> _U(64 - _RANGES)).tolist():
                part = parts.setdefault(r, np.zeros(1 << (power - _RANGES), bool))
                for at in _probes(h[h >> _U(64 - _RANGES) == r], power):
                    part[at & ((1 << (power - _RANGES)) - 1)] = True
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])

    return X.lean(run)


def of(hashes: DataFrame, column: str, most_bits: int = MOST_BITS) -> Bloom:
    """The filter of a column of 64-bit hashes without nulls, counted first."""
    n = hashes.count()
    power = min(max(min(LEAST_BITS, most_bits), (BITS_EACH * max(n, 1) - 1).bit_length()), most_bits)
    bits = np.zeros(1 << (power - 3), np.uint8)
    each = 1 << (power - 3 - _RANGES)
    parts = hashes.select(F.col(column).alias("h")).repartitionByRange("h")
    for row in parts.mapInArrow(_parts(power), "part int, bits binary").collect():
        bits[row.part * each : (row.part + 1) * each] |= np.frombuffer(row.bits, np.uint8)
    return Bloom(bits.tobytes(), power)
