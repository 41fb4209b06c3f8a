"""Files sorted by a 64-bit key that are read by key, not scanned.

A table of a store is a folder with one part for each append; a part has one folder for each
bucket of the key, and its files are sorted by key in small row groups. A lookup shuffles
the asked keys to their buckets and reads only the row groups whose range holds one, so
that what it reads follows the asked keys and not the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Bytes of a row group, and matches that a lookup puts into one batch.
GROUP_BYTES, MATCHES = 256 << 10, 4096


def bucket(key: str, buckets: int) -> Column:
    """The bucket of a key."""
    return F.pmod(F.col(key), F.lit(buckets)).cast("int")


def write(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write one part: ``df`` in buckets of the bigint ``key``, sorted; a part written before is replaced."""
    rows = df.withColumn("bucket", bucket(key, buckets)).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", key)
    rows.write.partitionBy("bucket").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).mode("overwrite").parquet(path)


def mounted(parts: list[str]) -> bool:
    """Whether the qualified paths are folders that every task can open."""
    return all(p.startswith("file:") for p in parts)


def lookup(asked: DataFrame, key: str, parts: list[str], schema: StructType, stored: str, buckets: int, among: dict[str, str] | None = None) -> DataFrame:
    """``asked`` with the columns of every stored row whose ``stored`` key equals its ``key``.

    Column names of both sides differ. ``asked`` is shuffled to the buckets; of the parts only
    row groups that may hold a key are read. With ``among``, which names the asked column of
    each stored one, asked rows also match each other, each pair once in either order, and a
    column ``stored`` tells both kinds apart. File systems that are not mounted as folders
    are read with a join instead, with the same result.
    """
    made = StructType([StructField(f.name, f.dataType) for f in (*asked.schema.fields, *schema.fields)])
    if among:
        made = made.add("stored", "boolean")
    target, source = to_arrow_schema(made), to_arrow_schema(StructType(made.fields[: len(asked.columns)]))
    names, fields = asked.columns, schema.names
    own = [among[f] for f in fields] if among else []
    folders, far = [p.partition(":")[2] for p in parts], not mounted(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).cast(source).combine_chunks()
        keys = table.column(key).to_numpy()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]

        def matched(left: np.ndarray, right: np.ndarray, other: pa.Table, columns: list[str], flag: bool) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(left), MATCHES):
                mine, theirs = table.take(pa.array(left[k : k + MATCHES])), other.take(pa.array(right[k : k + MATCHES]))
                arrays = [*(mine.column(c) for c in names), *(theirs.column(c) for c in columns)]
                arrays += [pa.chunked_array([pa.repeat(flag, mine.num_rows)])] if among else []
                yield from pa.Table.from_arrays([a.cast(f.type) for a, f in zip(arrays, target, strict=True)], schema=target).combine_chunks().to_batches()

        if among:
            ends, place, step = np.searchsorted(keys, keys, "right"), np.arange(len(keys)), 1
            while len(place := place[place + step < ends[place]]):
                yield from matched(order[place], order[place + step], table, own, False)
                step += 1
        if not far:
            number = int(keys[0] % buckets)
            for folder in folders:
                for group in _groups(f"{folder}/bucket={number}", keys, stored, fields):
                    theirs = group.column(stored).to_numpy()
                    first, last = np.searchsorted(keys, theirs, "left"), np.searchsorted(keys, theirs, "right")
                    times = last - first
                    if times.any():
                        right = np.repeat(np.arange(len(theirs)), times)
                        left = order[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)]
                        yield from matched(left, right, group, fields, True)

    rows = asked.filter(F.col(key).isNotNull()).repartitionById(buckets, bucket(key, buckets))
    found = rows.mapInArrow(run, made) if among or not far else None
    if not far:
        return found
    known = asked.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(*parts)
    joined = asked.join(known, F.col(key) == F.col(stored)).select(*names, *fields)
    return found.unionByName(joined.withColumn("stored", F.lit(True))) if among else joined


def _groups(folder: str, keys: np.ndarray, stored: str, fields: list[str]) -> Iterator[pa.Table]:
    """The row groups of a bucket of one part that may hold one of the sorted ``keys``."""
    system = pyarrow.fs.LocalFileSystem()
    for info in system.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
        if not info.path.endswith(".parquet"):
            continue
        with pq.ParquetFile(info.path, filesystem=system) as file:
            wanted = []
            for k in range(file.metadata.num_row_groups):
                group = file.metadata.row_group(k)
                bounds = group.column(file.schema_arrow.get_field_index(stored)).statistics
                at = np.searchsorted(keys, bounds.min, "left") if bounds is not None and bounds.has_min_max else 0
                if at < len(keys) and (bounds is None or not bounds.has_min_max or keys[at] <= bounds.max):
                    wanted.append(k)
            for k in wanted:
                yield file.read_row_group(k, columns=fields)
