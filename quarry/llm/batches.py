"""Helpers for Arrow-batched work on whole texts: bounded slices, raw UTF-8 buffers, and ids passed through untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about `limit` bytes in the column at most, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, each value followed by one space, and the start of each value. Null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    joined = pc.binary_join_element_wise(column, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8) if joined.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_texts(df: DataFrame, f: Callable[[pa.RecordBatch], dict[str, object]], schema: StructType | str, keep: list[str], text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """f gets bounded slices of df and returns the new columns; the columns in `keep` pass through as they are."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    new = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = StructType([df.schema[k] for k in keep] + list(new.fields))
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                cols = f(part)
                arrays = [part.column(k).cast(arrow.field(k).type) for k in keep]
                for field in new.fields:
                    x = cols[field.name]
                    arrays.append(x.cast(arrow.field(field.name).type) if isinstance(x, pa.Array) else pa.array(x, arrow.field(field.name).type))
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, out)
