"""Filling containers of fixed capacity with documents (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.workspace import settle

CAPACITY, MOST_DOCUMENTS = 2048, 256
#: Attention cost a container may have, as a share of that of one document that fills it.
ATTENTION = 0.9375
#: Tokens and rows that one task packs at a time.
GROUP_TOKENS, GROUP_ROWS = 4_000_000, 40_000
#: Weights of tokens, documents and attention cost in the residual norm.
WEIGHTS = (1.0, 0.02, 0.02)


def best_fit(sizes: np.ndarray, capacity: int, documents: int, attention: int) -> np.ndarray:
    """The bin of each size, largest first: of all open bins with room in tokens, documents
    and attention cost (the sum of squared sizes), the one whose weighted residual is least.

    Ties go to the oldest bin; sizes must not be over ``capacity``. A size whose square alone
    is over ``attention`` has a bin of its own, as it may not be cut.
    """
    n = len(sizes)
    bins = np.empty(n, np.int64)
    tokens, count, cost = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    scale = np.array([WEIGHTS[0] / capacity**2, WEIGHTS[1] / documents**2, WEIGHTS[2] / float(attention) ** 2])
    opened, start = 0, 0  # bins before start are closed to every size still to come
    least = np.minimum.accumulate(np.sort(sizes)[::-1]) if n else sizes
    for k, item in enumerate(np.argsort(-sizes, kind="stable").tolist()):
        size = int(sizes[item])
        square = size * size
        t, c, a = tokens[start:opened], count[start:opened], cost[start:opened]
        fits = np.flatnonzero((t >= size) & (c >= 1) & (a >= square))
        if len(fits):
            residual = scale[0] * (t[fits] - size) ** 2 + scale[1] * (c[fits] - 1) ** 2 + scale[2] * (a[fits] - square).astype(float) ** 2
            chosen = start + int(fits[np.argmin(residual)])
        else:
            chosen = opened
            tokens[chosen], count[chosen], cost[chosen] = capacity, documents, attention
            opened += 1
        tokens[chosen] -= size
        count[chosen] -= 1
        cost[chosen] -= square
        bins[item] = chosen
        if k % 512 == 511:
            smallest = int(least[-1])
            while start < opened and (tokens[start] < smallest or count[start] < 1):
                start += 1
    return bins


class _Pack:
    def __init__(self, key: str, capacity: int, documents: int, attention: int):
        self.key, self.limits = key, (capacity, documents, attention)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            groups = batch.column("_group").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(groups)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(groups)], strict=True):
                if a == b:
                    continue
                if groups[a] != group and held:
                    yield self._packed(group, held)
                    held = []
                group = groups[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield self._packed(group, held)

    def _packed(self, group: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        sizes = table.column("n_tokens").to_numpy().astype(np.int64)
        bins = best_fit(sizes, *self.limits)
        names = [self.key, "piece_no", "start_token", "n_tokens"]
        container = pa.array((int(group) << 32) + bins)
        return pa.RecordBatch.from_arrays(
            [container, *(table.column(c).combine_chunks() for c in names)], names=["container_id", *names]
        )


def pack(
    sized: DataFrame,
    key: str,
    capacity: int = CAPACITY,
    documents: int = MOST_DOCUMENTS,
    attention: int | None = None,
) -> DataFrame:
    """(container_id, key, piece_no, start_token, n_tokens) from (key, n_tokens).

    Every row is in one container, whole unless it alone is over ``capacity``: then it is
    cut into full containers and a rest. No container holds more than ``capacity`` tokens or
    ``documents`` pieces, nor more than ``attention`` cost (the sum of squared sizes) unless
    one piece alone has it. Rows of no tokens (and null sizes) are
    placed too; an empty table gives no rows. Rows are packed in groups of bounded size,
    drawn by a hash of the key, so that no task grows with the data; each group leaves at
    most a few containers open.
    """
    kind = sized.schema[key].dataType.simpleString()
    attention = int(ATTENTION * capacity * capacity) if attention is None else attention
    sized = settle(sized.select(key, F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")), "sizes")
    totals = sized.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).first()
    groups = max(1, -(-int(totals["t"] or 0) // GROUP_TOKENS), -(-totals["n"] // GROUP_ROWS))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.lit(capacity))).cast("int")
    rows = (
        sized.select(key, "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
        .withColumn("start_token", F.col("piece_no").cast("bigint") * capacity)
        .withColumn("n_tokens", F.least(F.lit(capacity), F.col("n_tokens") - F.col("start_token")))
        .withColumn("_group", F.pmod(F.xxhash64(key, "piece_no"), F.lit(groups)))
        .repartition(min(groups, 10_000), "_group")
        .sortWithinPartitions("_group", F.desc("n_tokens"), key, "piece_no")
    )
    schema = f"container_id bigint, {key} {kind}, piece_no int, start_token bigint, n_tokens bigint"
    return rows.mapInArrow(_Pack(key, capacity, documents, attention), schema)
