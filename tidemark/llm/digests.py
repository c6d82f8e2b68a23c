"""SHA-256 of many rows in order, a row at a time."""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType


def _hashed(batches, keys: list[str], schema: pa.Schema, separator: bytes):
    """Only the hash of the group in hand is held, however many rows it has."""
    now, state = None, None
    for batch in batches:
        out = []
        for key, piece in zip(zip(*[batch[k].to_pylist() for k in keys], strict=True), batch["piece"].to_pylist(), strict=True):
            if key == now:
                state.update(separator)
                state.update(piece.encode())
                continue
            if state is not None:
                out.append((*now, state.hexdigest()))
            now, state = key, hashlib.sha256(piece.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, state.hexdigest()), strict=True))], schema)


def ordered_sha256(df: DataFrame, keys: list[str], order: list[str], separator: str) -> DataFrame:
    """(keys..., sha256) of the column ``piece`` of each group, joined by the
    separator in the order. A group is read by one task, as the hash is
    sequential, but never held."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([*[df.schema[k] for k in keys], StructField("sha256", StringType())])
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "piece")
    return rows.mapInArrow(partial(_hashed, keys=keys, schema=to_arrow_schema(schema), separator=separator.encode()), schema)
