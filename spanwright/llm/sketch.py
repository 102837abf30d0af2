"""Count-min sketches that grow with the data, merged slice by slice.

A partition's sketch is sparse: of each slice of cells it sends the cells it touched and how often. A slice is
added up by whoever owns it, one partial after the other, so no task holds more than its slices, however
many partitions there are. A key's cells all lie in one slice. What is merged is one byte a cell, a logarithm
of the count, or one bit, whether the count is two or more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEPTH = 2
SLICE = 1 << 16
_ROW = SLICE // DEPTH
#: Largest sketch, in bytes, that is collected and broadcast.
MOST_BYTES = 32 << 20
LEAST_WIDTH = 1 << 16
PARTIALS = "slice int, cells binary, counts binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer of hashes."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def width_for(n_keys: int, most_cells: int | None = MOST_BYTES) -> int:
    """A row's number of cells: a power of two, twice the keys or more as long as there are ``most_cells`` at most."""
    width = LEAST_WIDTH
    while width < 2 * n_keys and (most_cells is None or 2 * width * DEPTH <= most_cells):
        width *= 2
    return width


def cells(keys: np.ndarray, width: int) -> list[np.ndarray]:
    """A key's cell in each row; a slice holds a part of every row."""
    h = mix(keys.view(np.uint64))
    first = (h >> np.uint64(34) & np.uint64(width // _ROW - 1)).astype(np.int64) * SLICE
    return [first + row * _ROW + (h >> np.uint64(row * 16) & np.uint64(_ROW - 1)).astype(np.int64) for row in range(DEPTH)]


def partial(keys: np.ndarray, width: int) -> pa.RecordBatch:
    """The sketch of some keys, as rows of ``PARTIALS``."""
    cell, n = np.unique(np.concatenate(cells(keys, width)), return_counts=True)
    number, first = np.unique(cell // SLICE, return_index=True)
    cuts = first[1:]
    packed = [zlib.compress(np.diff(c, prepend=c[:1] // SLICE * SLICE).astype(np.uint16).tobytes(), 1) for c in np.split(cell, cuts)] if len(cell) else []
    counts = [zlib.compress(np.minimum(c, 0xFFFF).astype(np.uint16).tobytes(), 1) for c in np.split(n, cuts)] if len(cell) else []
    return pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())], ["slice", "cells", "counts"])


def level(count: np.ndarray) -> np.ndarray:
    """A count as one byte."""
    return np.minimum(np.rint(np.log2(1.0 + count) * 10), 255).astype(np.uint8)


#: Level of a count of two.
TWICE = int(level(np.array(2)))


def counts_of(levels: np.ndarray) -> np.ndarray:
    return np.exp2(levels / 10.0) - 1


def _merger(bits: bool):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, cell, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.cumsum(np.frombuffer(zlib.decompress(cell), np.uint16).astype(np.int64))
                if number not in total:
                    total[number] = np.zeros(SLICE, np.uint32)
                total[number][at] += np.frombuffer(zlib.decompress(n), np.uint16)
        for number, n in total.items():
            data = np.packbits(n > 1) if bits else level(n)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["slice", "data"])

    return merge


def merged_slices(partials: DataFrame, bits: bool = False) -> DataFrame:
    """``(slice, data)``: the levels of a slice's cells, or their bits. Slices without any key are left out."""
    return partials.repartition("slice").mapInArrow(_merger(bits), "slice int, data binary")


def merged(partials: DataFrame, width: int, bits: bool = False) -> np.ndarray:
    """Levels, or packed bits, of all cells, from the partial sketches; the driver holds them, so check the size first."""
    size = SLICE // 8 if bits else SLICE
    out = np.zeros(DEPTH * width // SLICE * size, np.uint8)
    for row in merged_slices(partials, bits).toLocalIterator():
        out[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["data"], np.uint8)
    return out


def repeated(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a key may have come twice or more, by packed bits."""
    on = np.ones(len(keys), bool)
    for cell in cells(keys, len(bits) * 8 // DEPTH):
        on &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return on


def estimate(levels: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key: never less than that of its true count."""
    width = len(levels) // DEPTH
    out = None
    for cell in cells(keys, width):
        out = levels[cell] if out is None else np.minimum(out, levels[cell])
    return out
