"""Document identity, search, relations and review: the planned second tier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import nfc, plain_text
from archivolt.functions.urls import canonical, platform_key
from archivolt.workspace import BROADCAST_BYTES, settle

RELATIONS, REVIEW, FUSION = 50, 5, 60


def source_hash(*fields: str) -> Column:
    """SHA-256 of the stable JSON of knowledge fields; nulls are left out of the JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def normalised_hash(title: str, author: str, content: str, url: str, images: str) -> Column:
    """SHA-256 over title, author, body and URL in plain form and the images in order."""
    empty = F.lit("")
    plain = [F.coalesce(nfc(plain_text(F.col(c))), empty) for c in (title, author, content)]
    media = F.array_join(F.coalesce(F.col(images), F.array().cast("array<string>")), "\n", "")
    return F.sha2(F.concat_ws("\u001f", *plain, F.coalesce(canonical(F.col(url)), empty), media), 256)


def identity(id_column: str, url: str, content_hash: Column) -> Column:
    """Key of a document: its source id, else its platform item or canonical URL, else its content."""
    source = F.when(F.length(id_column) > 0, F.concat(F.lit("id:"), F.col(id_column)))
    platform = F.concat(F.lit("item:"), platform_key(F.col(url)))
    by_url = F.concat(F.lit("url:"), canonical(F.col(url)))
    return F.coalesce(source, platform, by_url, F.concat(F.lit("hash:"), content_hash))


def memberships(df: DataFrame, source: str, item: str, collection: str) -> DataFrame:
    """Distinct (source, item, collection); rows without item or collection have none."""
    return df.select(source, item, collection).filter((F.length(item) > 0) & (F.length(collection) > 0)).distinct()


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) of two tables of (key, source_hash, normalised_hash), a row a key in each.

    created, normalised_changed, source_changed (the former first), unchanged, or absent.
    """
    joined = old.alias("o").join(new.alias("n"), key, "full")
    change = (
        F.when(F.col("o.normalised_hash").isNull(), "created")
        .when(F.col("n.normalised_hash").isNull(), "absent")
        .when(F.col("o.normalised_hash") != F.col("n.normalised_hash"), "normalised_changed")
        .when(F.col("o.source_hash") != F.col("n.source_hash"), "source_changed")
        .otherwise("unchanged")
    )
    return joined.select(key, change.alias("change"))


def trigrams(text: Column) -> Column:
    """Distinct sequences of three code points of a text in lower case, white space runs as one space."""
    t = F.lower(plain_text(text))
    return F.when(F.length(t) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda k: F.substr(t, k, F.lit(3))))).otherwise(
        F.array().cast("array<string>")
    )


def search(documents: DataFrame, key: str, text: Column, searches: DataFrame, least: float = 0.0, grams: Callable[[Column], Column] = trigrams) -> DataFrame:
    """(query, key, score): documents that share grams with each query, score their share of the query's.

    With ``least``, only scores from it on: a document with so many of a query's grams holds
    one of its rarest, so that only these, by document frequency, are looked up, and common
    grams meet no document. Every match carries the document's grams and is scored at once.
    """
    wanted = settle(searches.select("query", grams(F.col("query")).alias("_q")).filter(F.size("_q") > 0).distinct(), "searches")
    asked = wanted.select("query", F.size("_q").alias("_n"), F.explode("_q").alias("_t"))
    rows = documents.select(key, grams(text).alias("_g")).filter(F.size("_g") > 0)
    known = _if_small(asked.select("_t").distinct())
    frequent = rows.select(F.explode("_g").alias("_t")).join(known, "_t", "left_semi").groupBy("_t").agg(F.count("*").alias("_df"))
    ranked = asked.join(frequent, "_t").groupBy("query", "_n").agg(F.array_sort(F.collect_list(F.struct("_df", "_t"))).alias("_by"))
    # grams in no document count as the rarest ones, which need not be looked up
    most = F.col("_n") - F.ceil(F.lit(least) * F.col("_n") - 1e-9) + 1 - (F.col("_n") - F.size("_by"))
    prefix = ranked.select("query", F.explode(F.slice("_by", F.lit(1), F.greatest(F.lit(0), F.least(most, F.col("_n"))).cast("int"))).alias("_p"))
    prefix = settle(prefix.select("query", F.col("_p._t").alias("_t")).join(wanted, "query"), "search-prefixes")
    hits = rows.select(key, "_g", F.explode("_g").alias("_t")).join(_if_small(prefix, 1024), "_t")
    score = F.round(F.size(F.array_intersect("_g", "_q")) / F.size("_q"), 6)
    return hits.select("query", key, score.alias("score")).filter(F.col("score") >= least).distinct()


def _if_small(df: DataFrame, width: int = 32) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows times ``width`` bytes allow it."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


# Letters that stand alone as tokens (scripts without spaces), and those that make up words.
TOKEN = "[\u3400-\u9fff\u3040-\u30ff\u0e00-\u0e7f]|[0-9a-z\u00c0-\u024f\u0370-\u03ff\u0400-\u04ff\u0590-\u08ff\u0900-\u097f]+"


def tokens(text: Column) -> Column:
    """Distinct words of a text in lower case; letters of scripts without spaces are tokens of their own."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def ranked_search(documents: DataFrame, key: str, text: str, searches: DataFrame, k: int = 10, least: float = 0.3, around: int = 30, **filters: str) -> DataFrame:
    """(query, key, score, rank, snippet): the ``k`` best documents of each query by share of its tokens, ties by key.

    ``filters`` name columns and the value they must have. The snippet is the text around
    the first occurrence of the query's longest token found, which is put in mark tags; it
    is cut for ranked rows only.
    """
    rows = documents
    for column, value in filters.items():
        rows = rows.filter(F.col(column) == value)
    best = settle(top(search(rows, key, F.col(text), searches, least, tokens), "query", "score", key, k), "ranked")
    found = best.join(rows.select(key, F.lower(text).alias("_low"), F.col(text).alias("_text")), key)
    longest = F.array_sort(F.transform(F.filter(tokens(F.col("query")), lambda t: F.contains("_low", t)), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    found = found.withColumn("_t", F.get(longest, F.lit(0))["t"]).withColumn("_at", F.instr("_low", F.col("_t")))
    start = F.greatest(F.lit(1), F.col("_at") - around)
    piece = lambda a, n: F.substr("_text", a, n)
    after = F.col("_at") + F.length("_t")
    snippet = F.concat(piece(start, F.col("_at") - start), F.lit("<mark>"), piece(F.col("_at"), F.length("_t")), F.lit("</mark>"), piece(after, F.lit(around)))
    return found.select("query", key, "score", "rank", snippet.alias("snippet"))


def top(scores: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """The ``k`` best rows of each group with their rank, ties by key."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def neighbours(vectors: DataFrame, key: str, vector: str, k: int, every: int = 100, block: int = 4096) -> DataFrame:
    """(query, key, score, rank): the ``k`` nearest rows of each row whose key is divisible by ``every``.

    The stated query set meets all rows in blocks of at most ``block`` queries: one matrix
    product for each Arrow batch, and each task keeps the best ``k`` of a query. Vectors of
    zeros, null ones and those of another length are in no result; ties go by key.
    """
    asked = settle(vectors.filter((F.pmod(F.col(key), F.lit(every)) == 0) & F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("v")), "queries")
    n = asked.count()
    blocks = max(1, -(-n // block))
    part = F.pmod(F.xxhash64("query"), F.lit(2 * blocks))
    made = None
    for number in range(2 * blocks if n > block else 1):
        own = [(r["query"], r.v) for r in (asked.filter(part == number) if n > block else asked).collect()]  # about half a block
        if own or made is None:
            found = vectors.select(key, vector).mapInArrow(_Nearest(key, vector, own, k), f"query bigint, {key} bigint, score double")
            made = found if made is None else made.unionByName(found)
    return top(made, "query", "score", key, k)


class _Nearest:
    """The best rows of each query among those of a task."""

    def __init__(self, key: str, vector: str, asked: list[tuple[int, list[float]]], k: int):
        size = max((len(v) for _, v in asked), default=0)
        asked = [(q, v) for q, v in asked if len(v) == size and any(v)]
        self.key, self.vector, self.k, self.size = key, vector, k, size
        self.ids = np.array([q for q, _ in asked], np.int64)
        self.unit = _unit(np.array([v for _, v in asked], float).reshape(len(asked), size))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(self.ids)
        for batch in batches:
            rows = [(i, v) for i, v in zip(batch.column(self.key).to_pylist(), batch.column(self.vector).to_pylist(), strict=True) if v and len(v) == self.size and any(v)]
            if not rows or not len(self.ids):
                continue
            ids = np.array([i for i, _ in rows], np.int64)
            scores = np.round(self.unit @ _unit(np.array([v for _, v in rows], float)).T, 6)
            for q in range(len(self.ids)):
                kept = ids != self.ids[q]
                s, i = np.concatenate((best[q][0], scores[q][kept])), np.concatenate((best[q][1], ids[kept]))
                order = np.lexsort((i, -s))[: self.k]
                best[q] = s[order], i[order]
        counts = [len(s) for s, _ in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, counts)), pa.array(np.concatenate([i for _, i in best]) if best else np.zeros(0, np.int64)), pa.array(np.concatenate([s for s, _ in best]) if best else np.zeros(0))],
            names=["query", self.key, "score"],
        )


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True)) if len(rows) else rows


def fuse(left: DataFrame, right: DataFrame, group: str, key: str, constant: int = FUSION) -> DataFrame:
    """(group, key, score): reciprocal-rank fusion of two rankings (group, key, rank)."""
    joined = left.select(group, key, F.col("rank").alias("_a")).join(right.select(group, key, F.col("rank").alias("_b")), [group, key], "full")
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    return joined.select(group, key, F.round(part("_a") + part("_b"), 9).alias("score"))


def search_metrics(found: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(queries, recall, mrr, p95, unsupported) of ranked (query, key, rank) against expected (query, key).

    Recall counts ranks up to ``k`` and is averaged by query. ``p95`` is the 95th percentile
    of the column ms, one value a query, if ``found`` has it; ``unsupported`` counts queries
    without any result.
    """
    hits = expected.join(found.filter(F.col("rank") <= k).select("query", "key", "rank"), ["query", "key"], "left")
    by_query = hits.groupBy("query").agg(
        (F.count("rank") / F.count("*")).alias("_recall"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("_rr")
    )
    answered = found.groupBy("query").agg(F.max("ms" if "ms" in found.columns else F.lit(None).cast("double")).alias("_ms"))
    by_query = by_query.join(answered.withColumn("_any", F.lit(1)), "query", "left")
    return by_query.agg(
        F.count("*").alias("queries"), F.round(F.avg("_recall"), 6).alias("recall"), F.round(F.avg("_rr"), 6).alias("mrr"),
        F.round(F.percentile("_ms", 0.95), 6).alias("p95"), F.count_if(F.col("_any").isNull()).alias("unsupported"),
    )


def related_by_time(df: DataFrame, key: str, collection: str, seconds: Column, within: int, most: int = RELATIONS) -> DataFrame:
    """(key, other, gap): rows of the same collection saved within ``within`` seconds, the nearest ``most`` of each.

    Ties go by the other's key; a row is never related to itself. Of one second only the
    least ``most`` + 1 keys can be among the nearest of any row, and of the other seconds
    only ``most`` on either side, so that no pair is made beyond these. Seconds are looked
    at by time bucket with the buckets beside it, which spreads a large collection.
    """
    rows = df.select(key, collection, seconds.alias("_s")).filter(F.col(collection).isNotNull() & F.col("_s").isNotNull()).distinct()
    salted = Window.partitionBy(collection, "_s", F.pmod(F.xxhash64(key), F.lit(64))).orderBy(key)
    few = rows.withColumn("_l", F.row_number().over(salted)).filter(F.col("_l") <= most + 1)
    few = few.withColumn("_l", F.row_number().over(Window.partitionBy(collection, "_s").orderBy(key))).filter(F.col("_l") <= most + 1)
    moments = few.groupBy(collection, "_s").agg(F.collect_list(key).alias("_keys")).withColumn("_own", F.floor(F.col("_s") / within))
    spread = moments.withColumn("_b", F.explode(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1)))
    beside = Window.partitionBy(collection, "_b").orderBy("_s").rowsBetween(-most, most)
    spread = spread.withColumn("_near", F.collect_list(F.struct("_s", "_keys")).over(beside)).filter(F.col("_b") == F.col("_own"))
    gap = lambda m: F.abs(m["_s"] - F.col("_s"))
    close = F.filter("_near", lambda m: gap(m) <= within)
    pairs = F.flatten(F.transform(close, lambda m: F.transform(m["_keys"], lambda k: F.struct(F.abs(m["_s"] - F.col("_s")).alias("gap"), k.alias("other")))))
    nearest = spread.select(collection, "_s", F.slice(F.array_sort(pairs), 1, most + 1).alias("_pairs"))
    others = F.slice(F.filter("_pairs", lambda p: p["other"] != F.col(key)), 1, most)
    return rows.join(nearest, [collection, "_s"]).select(key, F.explode(others).alias("p")).select(key, "p.other", "p.gap")


def related(candidates: DataFrame, most: int = RELATIONS) -> DataFrame:
    """(key, other, score, heuristics) of candidates (key, other, score, heuristic), the best ``most`` of each key.

    A pair found by several heuristics comes once with their names in order and its best
    score; rows related to themselves are left out. Ties go by the other's key.
    """
    once = candidates.filter("key <> other").groupBy("key", "other").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("heuristic")).alias("heuristics"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "other"))
    return once.withColumn("_k", rank).filter(F.col("_k") <= most).drop("_k")


def shared_labels(labels: DataFrame, most: int = RELATIONS) -> DataFrame:
    """(key, other, score, heuristic): documents that share a label (key, label), the ``most`` next ones by key on either side.

    The neighbours of a label in the order of keys are related, so that a label that many
    documents hold makes a bounded number of candidates for each; ``score`` is 1.
    """
    rows = labels.filter(F.length("label") > 0).select("key", "label").distinct()
    part = F.floor(F.col("key") / F.lit(65536))
    near = Window.partitionBy("label", "_part").orderBy("key").rowsBetween(-most // 2, most // 2)
    made = rows.withColumn("_part", part).withColumn("_near", F.collect_list("key").over(near))
    return made.select("key", F.explode("_near").alias("other"), F.lit(1.0).alias("score"), F.lit("label").alias("heuristic")).filter("key <> other").distinct()


def daily_review(df: DataFrame, key: str, topic: str, order: list[Column], date: str, seen: Column | None = None, per_topic: int = 2, most: int = REVIEW) -> DataFrame:
    """(key, topic, rank): the first ``most`` rows of the day by ``order``, at most ``per_topic`` of a topic.

    ``order`` are the priorities, the weightiest first; ties go by a hash seeded with the
    date. Rows for which ``seen`` holds (read, ignored, shown of late) are left out; null
    does not exclude.
    """
    tie = F.sha2(F.concat_ws("|", F.lit(date), F.col(key).cast("string")), 256)
    rows = df if seen is None else df.filter(~F.coalesce(seen, F.lit(False)))
    by = [f"_o{k}" for k in range(len(order))] + ["_tie"]
    rows = rows.select(key, topic, *[o.alias(f"_o{k}") for k, o in enumerate(order)], tie.alias("_tie"))
    part = F.pmod(F.xxhash64(key), F.lit(64))
    local = F.row_number().over(Window.partitionBy(topic, part).orderBy(*by))
    rows = rows.withColumn("_l", local).filter(F.col("_l") <= per_topic).drop("_l")
    rank = F.row_number().over(Window.partitionBy(topic).orderBy(*by))
    first = rows.withColumn("_r", rank).filter(F.col("_r") <= per_topic).orderBy(*by).limit(most)
    return first.select(key, topic, F.row_number().over(Window.orderBy(*by)).alias("rank"))


def leases(events: DataFrame, job: str, at: str, kind: str, now: Column, minutes: int = 15, attempts: int = 3) -> DataFrame:
    """(job, claims, state) of jobs from their event log of claim, heartbeat, done and failed events.

    done; dead after ``attempts`` claims without success; leased while the last claim or
    heartbeat is younger than ``minutes``; else ready.
    """
    seen = F.max(F.when(F.col(kind).isin("claim", "heartbeat"), F.col(at)))
    grouped = events.groupBy(job).agg(
        F.count_if(F.col(kind) == "claim").alias("claims"), F.max((F.col(kind) == "done").cast("int")).alias("_done"),
        seen.alias("_seen"), F.max(F.when(F.col(kind) == "failed", F.col(at))).alias("_failed"),
    )
    held = (F.col("_seen") + F.expr(f"interval {minutes} minutes") > now) & (F.col("_failed").isNull() | (F.col("_failed") < F.col("_seen")))
    state = F.when(F.col("_done") == 1, "done").when(held, "leased").when(F.col("claims") >= attempts, "dead").otherwise("ready")
    return grouped.select(job, "claims", state.alias("state"))


def valid_relations(relations: DataFrame, documents: DataFrame, key: str, text: str, kinds: tuple[str, ...]) -> DataFrame:
    """Relations (a, b, kind, evidence) of a known kind whose evidence stands in one of both texts."""
    a = documents.select(F.col(key).alias("a"), F.col(text).alias("_a"))
    b = documents.select(F.col(key).alias("b"), F.col(text).alias("_b"))
    rows = relations.filter(F.col("kind").isin(*kinds) & (F.col("a") != F.col("b"))).join(a, "a").join(b, "b")
    return rows.filter(F.contains("_a", F.col("evidence")) | F.contains("_b", F.col("evidence"))).drop("_a", "_b")


def logical_hash(df: DataFrame, *columns: str) -> DataFrame:
    """(rows, hash) that does not depend on order: the sum of 60 bits of each row's hash, as decimal digits.

    A sum is combined before the shuffle, unlike a sorted list of all hashes, and a decimal
    of 38 digits holds it for 10^19 rows.
    """
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in columns])
    number = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(28,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").cast("string").alias("hash"))


def index_report(change: DataFrame, failed: int = 0, skipped: int = 0, kinds: int = 1) -> DataFrame:
    """(discovered, processed, created, updated, unchanged, absent, skipped, failed, jobs_queued) of a run from its changes.

    ``skipped`` and ``failed`` items are discovered but not processed; each created or
    updated document queues ``kinds`` derivations.
    """
    kind = F.col("change")
    made = change.agg(
        F.count_if(kind != "absent").alias("processed"),
        F.count_if(kind == "created").alias("created"),
        F.count_if(kind.isin("normalised_changed", "source_changed")).alias("updated"),
        F.count_if(kind == "unchanged").alias("unchanged"),
        F.count_if(kind == "absent").alias("absent"),
    )
    skips = [F.lit(n).cast("bigint").alias(c) for c, n in (("skipped", skipped), ("failed", failed))]
    queued = ((F.col("created") + F.col("updated")) * kinds).cast("bigint").alias("jobs_queued")
    return made.select((F.col("processed") + skipped + failed).cast("bigint").alias("discovered"), *made.columns, *skips, queued)


def merged(rows: DataFrame, key: str, value: str, at: str, policy: str) -> DataFrame:
    """(key, value, versions, replaced) of records of one identity, by policy.

    survivor keeps the oldest value, newest_reviewed the newest; reject is an error as soon
    as a key has two different values. Ties of ``at`` go by the value. ``replaced`` lists
    the other values in order, for the audit; nulls are no values.
    """
    if policy not in ("reject", "survivor", "newest_reviewed"):
        raise ValueError(f"unknown policy: {policy}")
    order = F.struct(at, value)
    grouped = rows.filter(F.col(value).isNotNull()).groupBy(key).agg(
        F.min_by(value, order).alias("_old"), F.max_by(value, order).alias("_new"), F.array_sort(F.collect_set(value)).alias("_all"), F.count("*").alias("versions")
    )
    conflict = F.raise_error(F.concat(F.lit("conflicting values of "), F.col(key).cast("string"))).cast("string")
    chosen = {
        "survivor": F.col("_old"),
        "newest_reviewed": F.col("_new"),
        "reject": F.when(F.size("_all") > 1, conflict).otherwise(F.col("_old")),
    }[policy]
    made = grouped.select(key, chosen.alias(value), "versions", "_all")
    return made.select(key, value, "versions", F.array_remove("_all", F.col(value)).alias("replaced"))


# The fields of a derived record and its kinds of content.
DERIVED = (
    "summary", "key_points", "topics", "tags", "content_type", "evergreen_score", "reading_priority", "priority_reason", "source_citations",
)
CONTENT_TYPES = ("tutorial", "opinion", "reference", "news", "story", "other")


def derivation_failures(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reason): what makes a derived record unusable.

    ``rows`` has summary, key_points, topics and tags (structs of name and confidence),
    content_type, evergreen_score, reading_priority and citations (structs of claim and
    excerpt), beside the source text; of them, columns that are absent are not checked.
    """
    plain = plain_text(F.coalesce(text, F.lit("")))
    checks = [
        (F.coalesce(F.length(F.trim("summary")), F.lit(0)) == 0, "summary"),
        (F.size("key_points") > 10, "key_points"),
        (F.size("topics") > 5, "topics"),
        (F.size("tags") > 8, "tags"),
        (~F.coalesce(F.col("evergreen_score").between(0, 5), F.lit(False)), "evergreen_score"),
        (F.exists("topics", lambda t: ~t.confidence.between(0, 1)) | F.exists("tags", lambda t: ~t.confidence.between(0, 1)), "confidence"),
        (F.exists("citations", lambda c: ~F.contains(plain, plain_text(c.excerpt))), "excerpt"),
    ]
    if "content_type" in rows.columns:
        checks.append((~F.coalesce(F.col("content_type").isin(*CONTENT_TYPES), F.lit(False)), "content_type"))
    if "reading_priority" in rows.columns:
        checks.append((~F.coalesce(F.col("reading_priority").between(0, 5), F.lit(False)), "reading_priority"))
    if "payload" in rows.columns:  # the record as JSON text, for its keys
        unknown = F.array_except(F.json_object_keys("payload"), F.array(*map(F.lit, DERIVED)))
        checks += [(F.json_object_keys("payload").isNull(), "json"), (F.size(unknown) > 0, "unknown_key")]
    found = F.filter(F.array(*[F.when(broken, F.lit(name)) for broken, name in checks]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(found).alias("reason"))


def reuse(wanted: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """(key, decision): reuse, stale or derive, by source hash, kind, prompt and policy.

    All four equal is reuse; if only the normalised hash differs the record is stale.
    """
    same = [key, "source_hash", "kind", "prompt", "policy"]
    known = derived.groupBy(*same).agg(F.collect_set("normalised_hash").alias("_known"))
    decision = F.when(F.col("_known").isNull(), "derive").when(F.array_contains("_known", F.col("normalised_hash")), "reuse").otherwise("stale")
    return wanted.join(known, same, "left").select(key, decision.alias("decision"))


def reading_state(marks: DataFrame, key: str, at: str) -> DataFrame:
    """(key, state, origin): the newest human mark of a document, else its newest other mark."""
    rank = F.struct((F.col("origin") == "human").cast("int").alias("human"), F.col(at))
    return marks.groupBy(key).agg(F.max_by(F.struct("state", "origin"), rank).alias("_m")).select(key, "_m.state", "_m.origin")


def adopt(lexical: DataFrame, hybrid: DataFrame, gain: float = 0.10, loss: float = 0.02) -> DataFrame:
    """(gain, adopt): whether hybrid recall on semantic queries gains enough and lexical recall loses little.

    Both hold (kind, recall) of kinds semantic and lexical.
    """
    both = lexical.select("kind", F.col("recall").alias("_l")).join(hybrid.select("kind", F.col("recall").alias("_h")), "kind")
    delta = F.col("_h") - F.col("_l")
    made = both.agg(F.max(F.when(F.col("kind") == "semantic", delta)).alias("gain"), F.min(F.when(F.col("kind") == "lexical", delta)).alias("_loss"))
    return made.select("gain", ((F.col("gain") >= gain) & (F.coalesce("_loss", F.lit(0.0)) >= -loss)).alias("adopt"))


def broken_links(links: DataFrame, pages: DataFrame, creatable: DataFrame) -> DataFrame:
    """(source, target, state) of links whose page is missing: creatable if a note may be made for it, else broken."""
    missing = links.join(pages.select(F.col("page").alias("target")), "target", "left_anti")
    known = creatable.select(F.col("page").alias("target")).distinct().withColumn("_c", F.lit(True))
    return missing.join(known, "target", "left").select("source", "target", F.when(F.col("_c"), "creatable").otherwise("broken").alias("state"))


def link_check(links: DataFrame, pages: DataFrame, creatable: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, state): broken and creatable link targets, and pages that differ from the manifest.

    ``pages`` and ``manifest`` have (page, hash): changed where the hashes differ, missing
    where only the manifest has the page, stale where only the folder has it.
    """
    states = broken_links(links, pages, creatable).select(F.col("target").alias("name"), "state").distinct()
    both = pages.select("page", F.col("hash").alias("_p")).join(manifest.select("page", F.col("hash").alias("_m")), "page", "full")
    state = F.when(F.col("_m").isNull(), "stale").when(F.col("_p").isNull(), "missing").when(F.col("_p") != F.col("_m"), "changed")
    return states.unionByName(both.select(F.col("page").alias("name"), state.alias("state")).filter("state IS NOT NULL"))


def index_pages(labels: DataFrame, most: int = 20) -> DataFrame:
    """(kind, label, n, first) of (kind, label, key): the pages of sources, topics and tags with their first keys in order.

    A page lists at most ``most`` keys and their whole number; keys are ranked by parts of a
    label first, so that no task sorts a whole label.
    """
    rows = labels.filter(F.length("label") > 0).select("kind", "label", "key").distinct()
    part = Window.partitionBy("kind", "label", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy("key")
    few = rows.withColumn("_l", F.row_number().over(part)).filter(F.col("_l") <= most)
    listed = few.groupBy("kind", "label").agg(F.slice(F.array_sort(F.collect_list("key")), 1, most).alias("first"))
    return rows.groupBy("kind", "label").agg(F.count("*").alias("n")).join(listed, ["kind", "label"])


def stale_embeddings(documents: DataFrame, embedded: DataFrame, key: str) -> DataFrame:
    """(key, model) of the embeddings to compute: those of documents (key, normalised_hash, model) that none has with that hash."""
    same = [key, "normalised_hash", "model"]
    return documents.select(*same).distinct().join(embedded.select(*same).distinct(), same, "left_anti").select(key, "model")
