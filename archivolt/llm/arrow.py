"""Small helpers around ``mapInArrow`` shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows and bytes handled at once by a vectorised step; results do not depend on them.
SLICE_ROWS, SLICE_BYTES = 2048, 4 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds at most ``rows`` rows and about ``size`` bytes.

    One row larger than ``size`` comes alone: texts are never cut.
    """
    for batch in batches:
        pending = [(0, batch.num_rows)]
        while pending:
            start, stop = pending.pop()
            if stop <= start:
                continue
            part = batch.slice(start, stop - start)
            if stop - start > 1 and (stop - start > rows or part.nbytes > size):
                middle = (start + stop) // 2
                pending += [(middle, stop), (start, middle)]
                continue
            yield part


def map_slices(
    df: DataFrame,
    schema: str | StructType,
    function: Callable[[pa.RecordBatch], dict[str, Any] | None],
    rows: int = SLICE_ROWS,
    size: int = SLICE_BYTES,
) -> DataFrame:
    """Apply ``function`` to slices of ``df``; it returns column values by output name."""
    made = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows, size):
            columns = function(part)
            if columns is not None:
                yield record_batch(columns, target)

    return df.mapInArrow(run, made)


def record_batch(columns: dict[str, Any], target: pa.Schema) -> pa.RecordBatch:
    """A batch with the fields of ``target`` from lists, numpy arrays or Arrow arrays."""
    arrays = []
    for field in target:
        value = columns[field.name]
        if isinstance(value, pa.ChunkedArray):
            value = value.combine_chunks()
        if not isinstance(value, pa.Array):
            value = pa.array(value, type=field.type)
        arrays.append(value if value.type == field.type else value.cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def int_lists(flat: Any, offsets: Any, kind: pa.DataType) -> pa.ListArray:
    """A list array over ``flat`` cut at ``offsets``."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def bounded_sample(df: DataFrame, columns: list[str], rows: int, wanted: Any = None) -> list:
    """At most ``rows`` different rows of ``columns``, those with the least hash; the same at every partitioning.

    A first cut by hash leaves about one and a half times ``rows``, so that what reaches the driver
    does not grow with the table or its partitions. ``wanted`` filters the sampled rows.
    """
    total = df.count()
    hashed = df.select(*columns, F.xxhash64(*columns).alias("_hash"))
    if total > 2 * rows:
        hashed = hashed.filter(F.col("_hash").bitwiseAND((1 << 31) - 1) < int((1 << 31) * 1.5 * rows / total))
    if wanted is not None:
        hashed = hashed.filter(wanted)
    hashed = hashed.dropDuplicates(["_hash"])  # copies of one row are one row of the sample
    return hashed.orderBy("_hash", *columns).limit(rows).select(*columns).collect()
