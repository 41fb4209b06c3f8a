"""The jobs behind the command line: export, audit, triage, download and index, with their files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions.urls import collection_id, member_token
from archivolt.operators import archive, download, records, triage, validation
from archivolt.sources import files, jsonl, paged
from archivolt.workspace import settle

#: How rows of raw files are ordered: by file, line and place in the line.
ORDER = ["file", "line_no", "position"]


def pages(spark: SparkSession, addresses: Sequence[str], offset: int = 0, limit: int = 0, delay: float = 2.0, attempts: int = 3, cookie: str = "") -> DataFrame:
    """Pages of listings, written once so that nothing is asked for twice."""
    spark.dataSource.register(paged.PagedSource)
    options = {"offset": offset, "limit": limit, "delay": delay, "attempts": attempts, "cookie": cookie}
    return settle(spark.read.format("paged").options(**{k: str(v) for k, v in options.items()}).load(",".join(addresses)), "pages")


def export(made: DataFrame, output: str, state: str, read: int | None = None) -> tuple[int, int]:
    """(exported, skipped): append the new ones of ``made`` (place, record fields, error) to JSON lines.

    The first item that gives no record, or whose record breaks the schema, is an error, and
    then nothing is written. Ids that the output holds already are skipped, as are repeated
    ones; only then does the state move on by the items ``read``, and its count is at least
    the ids of the output. A job that breaks off between both writes skips what it wrote.
    """
    spark = made.sparkSession
    before = files.load_state(spark, state)
    made = settle(made, "records")
    failed = made.filter("error IS NOT NULL").orderBy("place").head(1)
    if failed:
        raise ValueError(f"item {failed[0].place} without {failed[0].error}")
    known = settle(jsonl.known_ids(spark, output), "known-ids")
    fresh = settle(archive.new_rows(made.drop("error"), known, "id", ["place"]), "new-records")
    total, new, held = made.count(), fresh.count(), known.count()
    jsonl.append(fresh.orderBy("place").select(*records.FIELDS), output)
    files.save_state(spark, state, before["offset"] + (total if read is None else read), max(before["exported"], held) + new)
    return new, total - new


def export_listing(spark: SparkSession, address: str, output: str, state: str, details: DataFrame | None = None, member: bool = False, limit: int = 5, **how) -> tuple[int, int]:
    """Export a collection's items, or a member's articles, from where the state left off."""
    offset = files.load_state(spark, state)["offset"]
    items = paged.items(pages(spark, [address], offset, limit, **how), offset, limit)
    normalise = records.member_records if member else records.collection_records
    return export(normalise(items, ["place"], details), output, state)


def export_fixture(spark: SparkSession, path: str, output: str, state: str) -> tuple[int, int]:
    """Export the items of a landed document from where the state left off."""
    rows = jsonl.fixture(spark, path, files.load_state(spark, state)["offset"])
    return export(records.fixture_records(rows, ["place"]).withColumn("error", F.lit(None).cast("string")), output, state)


def listing_name(address: str) -> str:
    """Name of a listing: the collection's number or the member's token in the address, else its last part."""
    spark = SparkSession.getActiveSession()
    url = F.lit(address)
    row = spark.range(1).select(F.coalesce(collection_id(url), member_token(url)).alias("n")).first()
    return row.n or address.rstrip("/").rpartition("/")[2]


def audit(spark: SparkSession, addresses: Sequence[str], report: str, **how) -> DataFrame:
    """Audit the listings that the report doesn't name yet, append them to it and return them."""
    known = {r.collection_id for r in jsonl.known_ids(spark, report, "collection_id").collect()}
    named = {a: listing_name(a) for a in addresses}
    todo = [a for a in named if named[a] not in known]
    if not todo:
        return spark.createDataFrame([], "collection_id string, reported_total bigint, scanned_total bigint, type_counts map<string,bigint>, page_count bigint, warnings array<string>")
    names = spark.createDataFrame([(a, named[a]) for a in todo], "address string, collection_id string")
    found = archive.audit_pages(pages(spark, todo, **how), "address")
    made = settle(found.join(F.broadcast(names), "address").select("collection_id", *[c for c in found.columns if c != "address"]), "audit")
    made.select(F.to_json(F.struct(*sorted(made.columns)), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("append").text(report)
    return made


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """Records of raw files with file, line_no and the collection named by the file; a malformed line is an error."""
    rows = jsonl.records(spark, folder, validation.ARTICLE, located=True, raw=True)
    return rows.withColumn("collection_id", jsonl.collection_of_file(F.col("file"), "-"))


def verify(spark: SparkSession, report: str, folder: str) -> DataFrame:
    """Every audit line against the non-blank lines of its collection's raw file."""
    lines = jsonl.raw_files(jsonl.lines(spark, folder)).select(jsonl.exported_collection(F.col("file")).alias("collection_id"))
    audits = spark.read.schema("collection_id string, reported_total bigint, scanned_total bigint, warnings array<string>").json(report)
    return archive.reconcile(audits, lines, "collection_id")


def triage_report(spark: SparkSession, folder: str, output: str) -> dict:
    """Write the triage report as one document (summary, buckets, items) and return its summary."""
    rows = raw(spark, folder)
    items = triage.triage(rows, "file", "line_no", "collection_id", "id", "title", "url")
    items = settle(items.withColumnsRenamed({"id": "article_id", "title": "article_title", "url": "article_url"}), "triage")
    n_files = jsonl.raw_files(jsonl.listed(spark, folder)).count()
    summary = triage.summary(items).first().asDict() | {"raw_files": n_files}
    buckets = {r.bucket: {"images": r.images, "articles": r.articles, "examples": []} for r in triage.bucket_report(items).collect()}
    for r in triage.examples(items, ORDER).orderBy("bucket", "rank").collect():  # eight of each bucket
        buckets[r.bucket]["examples"].append({"title": r.article_title, "article_url": r.article_url, "image_url": r.image_url, "reasons": r.reasons})
    ordered = {b: buckets[b] for b in triage.BUCKETS}
    listed = items.orderBy(*ORDER).select("collection_id", "article_id", "article_title", "article_url", "image_url", "bucket", "reasons")
    files.write_document(spark, output, {"summary": summary, "buckets": ordered, "items": listed})
    return {"summary": summary, "buckets": ordered}


def report_items(spark: SparkSession, report: str) -> DataFrame:
    """Items of a triage report with their place in it; a missing report has none."""
    kind = "collection_id string, article_id string, article_title string, article_url string, image_url string, bucket string, reasons array<string>"
    if not files.exists(spark, report):
        return spark.createDataFrame([], kind + ", place bigint")
    document = spark.read.schema(f"items array<struct<{kind.replace(' string', ': string').replace(' array', ': array')}>>").option("multiLine", True).json(report)
    return document.select(F.posexplode("items").alias("place", "i")).select("i.*", F.col("place").cast("bigint").alias("place"))


def download_images(items: DataFrame, job: str, folder: str, state: str, manifest: str | None = None, fetch=download.get_image, limit: int = 20, delay: float = 2.0) -> dict:
    """Fetch ``items`` (order columns, image_url, ...) of one job from where its state left off.

    Returns downloaded, skipped (those before the offset included) and stopped_reason. Saved
    images are appended to the manifest before the state moves on.
    """
    spark = items.sparkSession
    before = files.load_state(spark, state)
    rows = settle(items.withColumn("job", F.lit(job)), "images")
    seen = min(rows.count(), before["offset"])
    rest = rows.filter(F.col("place") >= before["offset"])
    log = settle(download.fetched(rest, folder, fetch, limit, delay), "fetch-log")
    done = archive.download_log(log, "job", ["place"]).first()
    if manifest:
        saved = rest.join(log.filter("path IS NOT NULL").select("place", "path"), "place").orderBy("place")
        names = ["article_id", "article_title", "article_url", "bucket", "collection_id", "image_url", "path", "reasons"]
        saved.select(F.to_json(F.struct(*names)).alias("value")).coalesce(1).write.mode("append").text(manifest)
    if done:
        files.save_state(spark, state, max(done.next_place, before["offset"]), before["exported"] + done.downloaded)
    return {
        "downloaded": done.downloaded if done else 0,
        "skipped": seen + (done.skipped if done else 0),
        "stopped_reason": done.stopped_reason if done else None,
    }


def raw_images(spark: SparkSession, path: str) -> DataFrame:
    """Image addresses of a raw file in order, each with its place; repeated ones stay."""
    rows = raw(spark, path).select("file", "line_no", F.posexplode("images").alias("position", "image_url")).filter(F.length("image_url") > 0)
    return archive.placed(rows, ORDER)


def candidates(spark: SparkSession, report: str, buckets: Sequence[str] = (), gifs: bool = False) -> DataFrame:
    """Images of a report to fetch: keep_knowledge and the added buckets, each address once, in the report's order."""
    found = archive.download_candidates(report_items(spark, report), ["keep_knowledge", *buckets], ["place"], gifs)
    return archive.placed(found.withColumnRenamed("place", "_at"), ["_at"])


def image_index(spark: SparkSession, manifest: str, report: str, output: str) -> dict:
    """Write the image index as one document (summary, articles, missing_candidates) and return its summary."""
    kind = "collection_id string, article_id string, article_title string, article_url string, image_url string, bucket string, reasons array<string>, path string"
    saved = jsonl.records(spark, manifest, spark.createDataFrame([], kind).schema, located=True)
    articles = settle(archive.index_articles(saved, ["file", "line_no"]), "index").orderBy("article_id")
    images = F.transform("images", lambda x: F.struct(x.path.alias("path"), x.image_url.alias("image_url"), x.bucket.alias("bucket"), x.reasons.alias("reasons")))
    articles = articles.select("article_id", "article_title", "article_url", images.alias("images"))
    missing = settle(archive.missing_candidates(report_items(spark, report), saved, ["place"]), "missing").orderBy("place")
    missing = missing.select("article_id", "article_title", "article_url", "image_url", "bucket", "reasons")
    summary = {"articles": articles.count(), "images": saved.count(), "missing_candidates": missing.count()}
    files.write_document(spark, output, {"summary": summary, "articles": articles, "missing_candidates": missing})
    return summary


def incomplete_addresses(spark: SparkSession, addresses: Sequence[str], report: str, folder: str) -> list[str]:
    """Addresses whose last audited total is not known or not what their raw file holds."""
    audits = jsonl.lines(spark, report).withColumn("v", F.try_parse_json("value"))
    audits = audits.select("file", "line_no", F.try_variant_get("v", "$.collection_id", "string").alias("collection_id"), F.try_variant_get("v", "$.scanned_total", "bigint").alias("scanned_total"))
    lines = jsonl.raw_files(jsonl.lines(spark, folder)).select(jsonl.exported_collection(F.col("file")).alias("collection_id"))
    known = {r.collection_id for r in audits.select("collection_id").distinct().collect()}
    open_ones = {r.collection_id for r in archive.incomplete(audits, lines, "collection_id", F.struct("file", "line_no")).collect()}
    return [a for a in addresses if (n := listing_name(a)) not in known or n in open_ones]
