"""Building the archive: dedup across runs, audits, reconciliation, downloads and the image index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.urls import is_gif_before_query, is_gif_path
from archivolt.workspace import settle

# HTTP statuses that skip an image; every other one from 400 on stops the job.
SKIPPED_STATUSES = (404, 410)


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each ``key`` by ``order``; rows with a null key are left out.

    Done by a partial aggregate over the order and the row, so that a key that holds a
    large share of the rows is combined before the shuffle.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    row = F.struct(*order, *rest)
    least = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_r"))
    return least.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def new_rows(incoming: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key of ``incoming`` that ``existing`` does not hold."""
    return first_wins(incoming, key, order).join(existing.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def export_counts(df: DataFrame, key: str, run: str, order: list[str]) -> DataFrame:
    """(run, exported, skipped): per run the ids first seen in it, and the rows that repeat an id.

    Runs come in ascending order; rows without an id are exported each.
    """
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(run, *order)).alias("_first"))
    exported = first.groupBy(F.col(f"_first.{run}").alias(run)).agg(F.count("*").alias("_ids"))
    rows = df.groupBy(run).agg(F.count("*").alias("_rows"), F.count_if(F.col(key).isNull()).alias("_free"))
    exported_now = F.coalesce("_ids", F.lit(0)) + F.col("_free")
    return rows.join(exported, run, "left").select(run, exported_now.alias("exported"), (F.col("_rows") - exported_now).alias("skipped"))


def resume(df: DataFrame, job: str, order: list[str], offset: int, limit: int | None = None) -> DataFrame:
    """Rows of each job from ``offset`` on, at most ``limit`` (0 and None: all), with their place.

    ``order`` must tell the rows of a job apart. Jobs are cut into ranges of their order, so
    that a large one is sorted by many tasks; a row's place is its place among all rows less
    the rows of jobs that come before.
    """
    rows = placed(df, [job, *order])
    first = rows.groupBy(F.col(job).alias("_job")).agg(F.min("place").alias("_first"))
    rows = rows.join(first, F.col(job).eqNullSafe(F.col("_job")))
    rows = rows.withColumn("place", F.col("place") - F.col("_first")).drop("_first", "_job").filter(F.col("place") >= offset)
    return rows.filter(F.col("place") < offset + limit) if limit else rows


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with each row's place (from 0) in ``order``, which must tell rows apart; no task holds all rows.

    Rows are sorted by ranges; the sizes of the ranges before a row's own give its place.
    """
    rows = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    made = rows.withColumn("_local", local).join(F.broadcast(before.select("_range", "_before")), "_range")
    return made.withColumn("place", (F.col("_before") + F.col("_local")).cast("bigint")).drop("_range", "_local", "_before")


def type_counts(items: DataFrame, collection: str, kind: Column, missing: str = "unknown") -> DataFrame:
    """(collection, type, n): items by type; null and empty types count as ``missing``."""
    named = F.when(kind.isNull() | (kind == ""), F.lit(missing)).otherwise(kind)
    return items.groupBy(collection, named.alias("type")).agg(F.count("*").alias("n"))


def audit(items: DataFrame, collection: str, page: str, kind: Column, totals: DataFrame | None = None) -> DataFrame:
    """(collection, reported_total, scanned_total, type_counts, page_count, warnings).

    ``totals`` holds (collection, page, total); the first total that is not null is the
    reported one. A scan that had to ask for an empty last page counts it in ``totals``.
    """
    by_type = type_counts(items, collection, kind)
    types = by_type.groupBy(collection).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("type_counts"), F.sum("n").alias("scanned_total")
    )
    pages = items.select(collection, page)
    if totals is not None:
        pages = pages.unionByName(totals.select(collection, page))
    made = types.join(pages.groupBy(collection).agg(F.countDistinct(page).alias("page_count")), collection)
    if totals is None:
        made = made.withColumn("reported_total", F.lit(None).cast("bigint"))
    else:
        reported = totals.filter("total is not null").groupBy(collection).agg(F.min_by("total", page).alias("reported_total"))
        made = made.join(reported, collection, "left")
    return made.select(collection, "reported_total", "scanned_total", "type_counts", "page_count", _warnings().alias("warnings"))


def audit_pages(pages: DataFrame, collection: str) -> DataFrame:
    """As ``audit`` for pages (page_no, total, items as JSON texts): an empty last page counts, its total too.

    Collections whose only page is empty have a scanned total of 0 and no types.
    """
    kind = F.try_variant_get(F.try_parse_json("item"), "$.content.type", "string")
    items = pages.select(collection, "page_no", F.explode("items").alias("item"))
    types = type_counts(items, collection, kind).groupBy(collection).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("type_counts"), F.sum("n").alias("_scanned")
    )
    known = F.struct(F.col("page_no"), F.col("total"))
    made = pages.groupBy(collection).agg(
        F.countDistinct("page_no").alias("page_count"), F.min(F.when(F.col("total").isNotNull(), known)).getField("total").alias("reported_total")
    )
    made = made.join(types, collection, "left")
    made = made.withColumn("scanned_total", F.coalesce("_scanned", F.lit(0)).cast("bigint"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    made = made.withColumn("type_counts", F.coalesce("type_counts", none))
    return made.select(collection, "reported_total", "scanned_total", "type_counts", "page_count", _warnings().alias("warnings"))


def _warnings() -> Column:
    differs = F.col("reported_total").isNotNull() & (F.col("reported_total") != F.col("scanned_total"))
    return F.when(differs, F.array(F.lit("reported_total_mismatch"))).otherwise(F.array().cast("array<string>"))


def reconcile(audits: DataFrame, exported: DataFrame, collection: str) -> DataFrame:
    """(audit columns, exported_total, status): one row for each audit row, repeated ones included."""
    counts = exported.groupBy(collection).agg(F.count("*").alias("exported_total"))
    joined = audits.join(counts, collection, "left").withColumn("exported_total", F.coalesce("exported_total", F.lit(0)))
    status = F.when(F.col("scanned_total").eqNullSafe(F.col("exported_total")), "ok").otherwise("mismatch")
    return joined.withColumn("status", status)


def pending(collections: DataFrame, audits: DataFrame, collection: str) -> DataFrame:
    """Distinct collections that no audit row names; null and empty ids are left out."""
    known = audits.select(collection).filter(F.length(collection) > 0)
    return collections.select(collection).filter(F.length(collection) > 0).distinct().join(known, collection, "left_anti")


def incomplete(audits: DataFrame, exported: DataFrame, collection: str, line: str | Column) -> DataFrame:
    """(collection, total, exported_total): collections whose last audited total is not what was exported.

    The last row by ``line`` wins; a null total is never complete.
    """
    last = audits.filter(F.length(collection) > 0).groupBy(collection).agg(F.max_by("scanned_total", line).alias("total"))
    counts = exported.groupBy(collection).agg(F.count("*").alias("exported_total"))
    joined = last.join(counts, collection, "left").withColumn("exported_total", F.coalesce("exported_total", F.lit(0)))
    return joined.filter(~F.col("total").eqNullSafe(F.col("exported_total")))


def download_candidates(items: DataFrame, buckets: list[str], order: list[str], gifs: bool = False) -> DataFrame:
    """First item of each non-empty image URL in ``buckets``, GIFs left out unless asked for."""
    kept = items.filter((F.length("image_url") > 0) & F.col("bucket").isin(*buckets))
    if not gifs:
        kept = kept.filter(~is_gif_path(F.col("image_url")))
    return first_wins(kept, "image_url", order)


def download_log(fetched: DataFrame, job: str, order: list[str], limit: int = 0) -> DataFrame:
    """(job, downloaded, skipped, next_place, stopped_reason) of each job from its fetch log.

    ``fetched`` holds place, status (null with an ``error``: timeout or network_error) of
    each image in order. 404 and 410 are skipped and passed; an error or another status from
    400 on stops the job at its place; ``limit`` counts downloads only (0: no limit).
    Aggregates alone decide, so that a job's log is combined before it is shuffled.
    """
    status = F.col("status")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(
        (status >= 400) & ~status.isin(*SKIPPED_STATUSES), F.concat(F.lit("http_"), status.cast("string"))
    )
    rows = fetched.select(job, "place", status.alias("status"), reason.alias("reason"))
    stops = rows.groupBy(job).agg(
        F.min(F.when(F.col("reason").isNotNull(), F.struct("place", "reason"))).alias("_stop"), F.max("place").alias("_last")
    )
    rows = rows.join(stops, job)
    reached = rows.filter(F.col("_stop").isNull() | (F.col("place") < F.col("_stop.place")))
    success = F.when(F.col("status") < 400, 1).otherwise(0)
    if limit:
        so_far = F.sum(success).over(Window.partitionBy(job).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        reached = reached.withColumn("_so_far", F.coalesce(so_far, F.lit(0))).filter(F.col("_so_far") < limit)
    counted = reached.groupBy(job).agg(
        F.sum(success).cast("bigint").alias("downloaded"), F.sum(1 - success).cast("bigint").alias("skipped"), F.max("place").alias("_passed")
    )
    stopped = F.col("_stop").isNotNull()
    if limit:
        stopped = stopped & (F.coalesce("downloaded", F.lit(0)) < limit)
    return stops.join(counted, job, "left").select(
        job,
        F.coalesce("downloaded", F.lit(0)).alias("downloaded"),
        F.coalesce("skipped", F.lit(0)).alias("skipped"),
        F.when(stopped, F.col("_stop.place")).otherwise(F.coalesce(F.col("_passed") + 1, F.lit(0))).cast("bigint").alias("next_place"),
        F.when(stopped, F.col("_stop.reason")).alias("stopped_reason"),
    )


def index_articles(manifest: DataFrame, order: list[str]) -> DataFrame:
    """(article_id, article_title, article_url, n_images, images): saved images by article, titles of the first row.

    Rows without an article id form no group. Images come in the order of the manifest.
    """
    rows = manifest.filter(F.length("article_id") > 0)
    image = F.struct(*order, *[c for c in ("path", "image_url", "bucket", "reasons") if c not in order])
    head = F.struct("article_title", "article_url")
    grouped = rows.groupBy("article_id").agg(
        F.min_by(head, F.struct(*order)).alias("_head"), F.count("*").alias("n_images"), F.array_sort(F.collect_list(image)).alias("images")
    )
    return grouped.select("article_id", "_head.article_title", "_head.article_url", "n_images", "images")


def missing_candidates(items: DataFrame, manifest: DataFrame, order: list[str]) -> DataFrame:
    """Knowledge images, GIFs left out, first of each URL, that the manifest does not hold."""
    eligible = items.filter((F.length("image_url") > 0) & (F.col("bucket") == "keep_knowledge") & ~is_gif_before_query(F.col("image_url")))
    saved = manifest.select("image_url").filter("image_url is not null")
    return first_wins(eligible, "image_url", order).join(saved, "image_url", "left_anti")
