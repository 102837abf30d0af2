"""One hash over the rows of a group in their order, however many they are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hasher(n_keys: int, prefix: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest, n = None, None, 0

        def done(schema: pa.Schema) -> pa.RecordBatch:
            keys = [pa.array([v], schema.field(k).type) for k, v in enumerate(group)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([digest.hexdigest()]), pa.array([n], pa.int32())], [*schema.names[:n_keys], "hash", "n"])

        schema = None
        for batch in batches:
            schema = batch.schema
            keys = zip(*(c.to_pylist() for c in batch.columns[:n_keys]), strict=True) if n_keys else [()] * len(batch)
            for key, line in zip(keys, batch.column(n_keys).to_pylist(), strict=True):
                if key != group:
                    if group is not None:
                        yield done(schema)
                    group, digest, n = key, hashlib.sha256(prefix), 0
                digest.update(line.encode("utf-8", "surrogatepass"))
                n += 1
        if group is not None:
            yield done(schema)

    return run


def ordered_hash(rows: DataFrame, by: list[str], order: str, line: Column, prefix: str = "") -> DataFrame:
    """``(*by, hash, n)``: SHA-256 over ``prefix`` and then ``line`` of each row of a group, by ``order``, and the number of rows.

    The rows of a group are sorted by Spark, which spills, and go by one after the other; none are gathered.
    An empty table has no groups.
    """
    placed = rows.repartition(*by) if by else rows.repartition(1)
    lines = placed.sortWithinPartitions(*by, order).select(*by, line.alias("line"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    return lines.mapInArrow(_hasher(len(by), prefix.encode()), f"{keys}{', ' if keys else ''}hash string, n int")
