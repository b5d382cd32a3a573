"""Arrow batches in and out of narrow Python stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A-Z folded to a-z in UTF-8 bytes; all other bytes stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# Bytes of a batch that are worked on at once: what is derived from texts outgrows them.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch):
    """A batch in rows of about SLICE_BYTES together."""
    step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of a batch as UTF-8; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Sequence], schema) -> DataFrame:
    """`fn` turns rows of a batch into the columns of `schema` (DDL or StructType), in order."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            for rows in slices(batch):
                columns = fn(rows)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)],
                    schema=arrow,
                )

    return df.mapInArrow(run, struct)


def kept_fields(df: DataFrame, keep: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(name, df.schema[name].dataType) for name in keep]
