"""Running a text function over a DataFrame in Arrow batches of bounded size.

Spark partitions the rows; each task streams its record batches through a function
that is set up once per task. A batch is cut into slices of a bounded number of bytes,
so memory follows the longest single text, not the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20      # text bytes handed to a function at once
SLICE_ROWS = 4096


def slices(batch: pa.RecordBatch, text_index: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``max_bytes`` of text (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + max_bytes, side="right"))
        stop = min(n, max(start + 1, stop), start + SLICE_ROWS)
        yield batch.slice(start, stop - start)
        start = stop


def with_columns(df: DataFrame, text_col: str, setup: Callable[[], Callable[[list[str | None]], Sequence[Any]]],
                 fields: Sequence[T.StructField]) -> DataFrame:
    """``df`` with new columns computed from one text column.

    ``setup()`` runs once per task and returns ``fn(texts) -> columns``, one array or
    list per field. All columns of ``df`` are kept; one whose name (case-insensitively)
    is among the new fields is replaced by it.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    if text_col.lower() in new:
        raise ValueError(f"the text column {text_col!r} can't be an output column")
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *fields])
    at = next(i for i, n in enumerate(names) if n.lower() == text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        fn = setup()
        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for part in slices(batch, at):
                out = fn(part.column(at).to_pylist())
                made = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t)
                        for c, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*names, *(f.name for f in fields)])

    return df.select(*[df[n] for n in names]).mapInArrow(run, schema)


def list_array(values: Any, counts: Sequence[int]) -> pa.ListArray:
    """A list column from the flat values and the number of values in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
