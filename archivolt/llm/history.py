"""Checking new batches against everything accepted so far (problem 6).

The history is an inverted index in a folder of its own, which a later session opens again:
postings of the rare tokens of every accepted text, in buckets by token and sorted, beside
the accepted ids and texts, in buckets by their hashes and sorted. A batch probes the index
with its own tokens, ids and text hashes, keeps pairs whose sketches allow the similarity, verifies their overlap exactly, decides its rows in order, and appends the
accepted ones. What a batch reads follows its own keys (see ``keyed``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from archivolt.llm import keyed
from archivolt.llm.arrow import int_lists, map_slices
from archivolt.llm.neardup import BINS, BUDGET, _once, min_hashes, sketches
from archivolt.llm.neardup import ROWS as BAND_ROWS
from archivolt.llm.shingles import LEAST, THRESHOLD, _Comparable, shingle_hashes, verified
from archivolt.workspace import BROADCAST_BYTES, new_path, remove, settle

#: Most rows and links of a batch that one task decides.
ONE_TASK = 200_000
#: Tokens of a text: conjunctions of five min-hashed shingles, rare by their build. A pair of
#: similarity 0.7 shares one of 48 with probability 0.9999, of 0.75 almost surely.
TOKENS = 48
_INSTANT = re.compile(r"^(\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)([Zz]|[+-]\d{2}:?\d{2})$")


def instant(value: str | None) -> int | None:
    """Microseconds of an ISO date-time with Z or an offset; None for anything else."""
    if not value or not _INSTANT.match(value):
        return None
    try:
        moment = datetime.fromisoformat(value.upper().replace("Z", "+00:00"))
    except ValueError:
        return None
    return round(moment.timestamp() * 1_000_000)


ROWS = "rec_no bigint, id string, batch_no int, t bigint, h bigint, s1 bigint, s2 bigint, bands array<bigint>, text string"
#: Stored tables; every one is sorted by its first column.
POSTINGS: StructType = StructType().add("token", "long").add("g", "long")
TEXTS: StructType = StructType().add("k", "long").add("t1", "long").add("t2", "long").add("old_text", "string")
IDS: StructType = StructType().add("id_hash", "long").add("old_id", "string")
CLASSES: StructType = StructType().add("k", "long")


class _Rows:
    """Rows of a batch with id, instant and class, and once a text of the slice its sketch and tokens."""

    def __init__(self, least: int):
        self.compared = _Comparable("_row", "title", "content", least)

    def __call__(self, part: pa.RecordBatch) -> dict:
        n = part.num_rows
        rows = self.compared(pa.RecordBatch.from_arrays([pa.array(range(n)), part.column("title"), part.column("content")], names=["_row", "title", "content"]))
        classes: list[int | None] = [None] * n
        texts: list[str | None] = [None] * n
        first: dict[int, tuple[int, str]] = {}
        for k, h, text in zip(rows["_row"], rows["h"], rows["text"], strict=True):
            classes[k] = h
            if h not in first:
                first[h] = (k, text)
                texts[k] = text
        chosen = list(first.values())
        s1, s2, lengths = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
        tokens = np.zeros((0, TOKENS), np.int64)
        if chosen:
            values = min_hashes(shingle_hashes([text for _, text in chosen]), len(chosen), -(-TOKENS * BAND_ROWS // BINS))
            high, low, tokens = sketches(values, TOKENS)
            at = [k for k, _ in chosen]
            s1[at], s2[at], lengths[np.array(at) + 1] = high, low, TOKENS
        return {
            **{c: part.column(c) for c in ("rec_no", "id", "batch_no")},
            "t": [instant(x) for x in part.column("saved_at").to_pylist()],
            "h": pa.array(classes, pa.int64()),
            "s1": s1,
            "s2": s2,
            "bands": int_lists(tokens.ravel(), np.cumsum(lengths), pa.int64()),
            "text": pa.array(texts, pa.string()),
        }


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(target).toString().rstrip("/")


class History:
    """Everything accepted so far; ``check`` decides a batch and ``append`` takes its accepted rows in.

    ``path`` names its folder in a file system that all executors share; opened again, by
    this or a later session, it goes on where the last append ended. An append counts once
    its mark is written: one that broke off is written anew. Ids are compared as strings,
    texts by classes of their hashes, similar texts exactly.
    """

    def __init__(self, spark: SparkSession, path: str, least: int = LEAST, threshold: float = THRESHOLD, buckets: int | None = None):
        self.spark, self.path, self.least, self.threshold = spark, qualified(spark, path), least, threshold
        self.marks = f"{self.path}/marks"
        known = [json.loads(r.value) for r in spark.read.text(self.marks).collect()] if self._exists(self.marks) else []
        self.buckets = known[0]["buckets"] if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.appended = len(known)

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def parts(self, table: str) -> list[str]:
        """Folders of all appends of a stored table."""
        return [f"{self.path}/{table}/{n}" for n in range(self.appended)]

    def _lookup(self, asked: DataFrame, key: str, table: str, schema: StructType, among: dict[str, str] | None = None) -> DataFrame:
        return keyed.lookup(asked, key, self.parts(table), schema, schema.names[0], self.buckets, among)

    def prepare(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows, texts) of a batch, ready to be checked; needs nothing of the history.

        ``texts`` has each distinct compared text once, without the text itself, which is
        in the row ``keeper``.
        """
        columns = [F.col("rec_no").cast("bigint"), "id", F.col("batch_no").cast("int"), "saved_at", "title", "content"]
        rows = settle(map_slices(batch.select(*columns), ROWS, _Rows(self.least)), "batch")
        texts = _once(rows.filter("text is not null").select("h", "s1", "s2", "bands", F.col("rec_no").alias("keeper")))
        return rows, settle(texts, "batch-texts")

    def check(self, rows: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(accepted rows, rec_no of the others) of a prepared batch.

        Rows come in order of batch_no, of the instant of saved_at (none last), then of rec_no.
        A row is accepted unless an accepted row of this or an earlier batch has its id (null
        equals nothing) or a text similar to its own.
        """
        probes = texts.select(F.explode("bands").alias("probe"), "h")
        shared = self._lookup(probes, "probe", "postings", POSTINGS, {"token": "probe", "g": "h"})
        ordered = [F.when(F.col("stored"), F.col(c)).otherwise(end("h", "g")).alias(c) for c, end in (("h", F.least), ("g", F.greatest))]
        shared = shared.select(*ordered, "stored").distinct().join(_small(texts.select("h", "s1", "s2"), 24), "h")
        shared = settle(shared, "shared-tokens")
        differ = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
        theirs = _small(texts.select(F.col("h").alias("g"), F.col("s1").alias("t1"), F.col("s2").alias("t2")), 24)
        near = shared.filter("NOT stored").join(theirs, "g").filter(differ <= BUDGET).select("h", "g", F.lit(None).cast("string").alias("old_text"))
        if self.appended:
            old = self._lookup(shared.filter("stored").select("h", "g", "s1", "s2"), "g", "texts", TEXTS)
            near = near.unionByName(old.filter(differ <= BUDGET).select("h", F.lit(None).cast("bigint").alias("g"), "old_text"))
        near = settle(near, "near")
        wanted = _small(near.select(F.explode(F.array("h", "g")).alias("h")).filter("h is not null").distinct(), 8)
        own = settle(rows.filter("text is not null").select("h", "text").join(wanted, "h", "left_semi").dropDuplicates(["h"]), "near-texts")
        pairs = near.join(own.select("h", F.col("text").alias("_text_a")), "h").join(own.select(F.col("h").alias("g"), "text"), "g", "left")
        links = settle(verified(pairs.withColumn("_text_b", F.coalesce("text", "old_text")), ["h", "g"], self.threshold).distinct(), "links")
        order = F.struct(F.col("batch_no").isNull().alias("last"), F.coalesce("batch_no", F.lit(0)).alias("b"), F.col("t").isNull().alias("late"), F.coalesce("t", F.lit(0)).alias("t"), "rec_no")
        open_rows = rows.select("rec_no", "id", "h", order.alias("ord"))
        if self.appended:
            ids = rows.filter("id is not null").select("id").distinct().withColumn("_id_hash", F.xxhash64("id"))
            known_ids = self._lookup(ids, "_id_hash", "ids", IDS).filter("id = old_id").select("id")
            same = self._lookup(texts.select("h"), "h", "texts", CLASSES).select("h")
            closed = links.filter("g is null").select("h").unionByName(same).distinct()
            open_rows = settle(open_rows.join(known_ids.distinct(), "id", "left_anti").join(closed, "h", "left_anti"), "open")
        accepted = _in_order(open_rows, links.filter("g is not null"))
        taken = settle(rows.select("rec_no", "id", "h").join(accepted, "rec_no", "left_semi"), "accepted")
        return taken, rows.select("rec_no").join(taken.select("rec_no"), "rec_no", "left_anti")

    def append(self, taken: DataFrame, rows: DataFrame, texts: DataFrame) -> None:
        """Take the accepted rows of a checked batch into the history."""
        n = self.appended
        kept = settle(texts.join(_small(taken.filter("h is not null").select("h").distinct(), 8), "h", "left_semi"), "kept")
        keyed.write(kept.select(F.explode("bands").alias("token"), F.col("h").alias("g")), f"{self.path}/postings/{n}", "token", self.buckets)
        stored = rows.join(_small(kept.select(F.col("keeper").alias("rec_no")), 8), "rec_no", "left_semi")
        keyed.write(stored.select(F.col("h").alias("k"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("text").alias("old_text")), f"{self.path}/texts/{n}", "k", self.buckets)
        ids = taken.filter("id is not null").select(F.xxhash64("id").alias("id_hash"), F.col("id").alias("old_id")).distinct()
        keyed.write(ids, f"{self.path}/ids/{n}", "id_hash", self.buckets)
        mark = json.dumps({"append": n, "buckets": self.buckets})
        self.spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("append").text(self.marks)
        self.appended += 1


class _Pass:
    """The pass in order over the rows and links of one task."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        linked: dict[int, list[int]] = {}
        for batch in batches:
            for rec_no, own, h, g, *order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rec_no is None:
                    linked.setdefault(h, []).append(g)
                    linked.setdefault(g, []).append(h)
                else:
                    rows.append((*order, rec_no, own, h))
        rows.sort(key=lambda r: r[:5])  # batch, instant, rec_no
        ids: set[str] = set()
        closed: set[int] = set()
        accepted = []
        for *_, rec_no, own, h in rows:
            if own in ids or h in closed:
                continue
            accepted.append(rec_no)
            ids |= {own} - {None}
            if h is not None:
                closed.update((h, *linked.get(h, ())))
        yield pa.RecordBatch.from_arrays([pa.array(accepted, pa.int64())], names=["rec_no"])


def _passed(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(rec_no) of the rows that one task accepts, passing through them in order."""
    none = F.lit(None).cast("bigint")
    order = [F.col(f"ord.{c}").alias(f"_{c}") for c in ("last", "b", "late", "t")]
    all_rows = rows.select("rec_no", "id", "h", none.alias("g"), *order)
    pairs = links.select(none.alias("rec_no"), F.lit(None).cast("string").alias("id"), "h", "g", *[F.lit(None).cast(k).alias(c) for c, k in all_rows.dtypes[4:]])
    return all_rows.unionByName(pairs).coalesce(1).mapInArrow(_Pass(), "rec_no bigint")


def _in_order(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(rec_no) of the rows a pass in order accepts: no accepted row has their id, text or a linked text.

    At most ONE_TASK rows and links are passed through by one task. Of more, rows that nothing
    in the batch bears on are accepted at once; if the others are still too many, they are
    decided in rounds by all tasks until one task can do, with the same result: in each round a row is accepted if it comes first among the open rows of its id, of its
    text and of all linked texts; rows an accepted one excludes are closed.
    """
    n_links = links.count()
    if rows.count() + n_links <= ONE_TASK:
        return _passed(rows, links)
    both = settle(links.unionByName(links.select(F.col("g").alias("h"), F.col("h").alias("g"))).distinct(), "both-ways")
    repeated = lambda c: rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n")).filter("_n > 1").select(c, F.lit(True).alias(f"_{c}"))
    linked = both.select("h").distinct().withColumn("_l", F.lit(True))
    rows = rows.join(repeated("id"), "id", "left").join(repeated("h"), "h", "left").join(linked, "h", "left")
    rows = settle(rows.select("rec_no", "id", "h", "ord", F.coalesce("_id", "_h", "_l", F.lit(False)).alias("_bound")), "bound")
    accepted = rows.filter("NOT _bound").select("rec_no")  # nothing in the batch bears on these
    rows = rows.filter("_bound").drop("_bound")
    while True:
        if rows.count() + n_links <= ONE_TASK:
            return accepted.unionByName(_passed(rows, links))
        ids = rows.filter("id is not null").groupBy("id").agg(F.min("ord").alias("_id"))
        texts = rows.filter("h is not null").groupBy("h").agg(F.min("ord").alias("_h"))
        linked = both.join(texts.select(F.col("h").alias("g"), "_h"), "g").groupBy("h").agg(F.min("_h").alias("_g"))
        ranked = rows.join(ids, "id", "left").join(texts.join(linked, "h", "left"), "h", "left")
        first = (
            (F.col("_id").isNull() | (F.col("ord") == F.col("_id")))
            & (F.col("_h").isNull() | (F.col("ord") == F.col("_h")))
            & (F.col("_g").isNull() | (F.col("ord") < F.col("_g")))
        )
        decided = settle(ranked.select("rec_no", "id", "h", "ord", first.alias("first")), "decided")
        taken = decided.filter("first")
        accepted = accepted.unionByName(taken.select("rec_no"))
        closed = taken.filter("h is not null").select("h")
        closed = closed.unionByName(closed.withColumnRenamed("h", "g").join(both, "g").select("h"))
        rows = (
            decided.filter("not first")
            .select("rec_no", "id", "h", "ord")
            .join(taken.filter("id is not null").select("id"), "id", "left_anti")
            .join(closed, "h", "left_anti")
        )
        if rows.isEmpty():
            return accepted
        rows = settle(rows, "open")


def _small(df: DataFrame, width: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows times ``width`` bytes allow it."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def rejected(articles: DataFrame, path: str | None = None) -> DataFrame:
    """(rec_no) of the rows not accepted, batch_no after batch_no; rows without a batch come last.

    Each batch is checked against the history at ``path``, which goes on from what it holds,
    and its accepted rows are appended. Without a path the history is removed at the end.
    """
    spark = articles.sparkSession
    history, made = History(spark, path or new_path(spark, "history")), []
    batches = sorted((r[0] for r in articles.select("batch_no").distinct().collect()), key=lambda b: (b is None, b))
    parts = [articles.filter(F.col("batch_no").eqNullSafe(F.lit(b))) for b in batches]
    with ThreadPoolExecutor(1) as ahead:  # the next batch is prepared while one is checked
        rows = ahead.submit(history.prepare, parts[0]) if parts else None
        for k in range(len(parts)):
            current = rows.result()
            rows = ahead.submit(history.prepare, parts[k + 1]) if k + 1 < len(parts) else None
            taken, others = history.check(*current)
            made.append(settle(others, "rejected"))
            history.append(taken, *current)
    if not path:
        remove(spark, history.path)
    out = articles.select(F.col("rec_no").cast("bigint").alias("rec_no")).limit(0)
    for others in made:
        out = out.unionByName(others)
    return out
