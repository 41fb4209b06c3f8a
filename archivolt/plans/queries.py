"""Queries of the archive's operators, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions.text import nfc, plain_text
from archivolt.functions.urls import canonical, file_name, is_gif_before_query, is_gif_path, path_suffix, platform_key
from archivolt.operators import archive, documents, triage, validation
from archivolt.workspace import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with SQL of the same result if there is any."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


_DATE_TIME = (
    "(regexp_matches({0}, '^[0-9]{{4}}-(0[1-9]|1[0-2])-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$')"
    " AND try_strptime(substr({0}, 1, 10), '%Y-%m-%d') IS NOT NULL AND NOT starts_with({0}, '0000'))"
)
_FAILURES = "".join(
    f" UNION ALL SELECT rec_no, {n} AS k, '{f}' AS field, 'missing' AS reason FROM articles WHERE {f} IS NULL" for n, f in enumerate(validation.REQUIRED)
)[len(" UNION ALL ") :] + f"""
 UNION ALL SELECT rec_no, 20, 'schema_version', 'const' FROM articles WHERE schema_version <> '1.0'
 UNION ALL SELECT rec_no, 21, 'id', 'pattern' FROM articles WHERE NOT regexp_matches(id, '^[a-z]+_[a-zA-Z0-9._-]+$')
 UNION ALL SELECT rec_no, 22, 'source', 'enum' FROM articles WHERE source NOT IN ({", ".join(f"'{s}'" for s in validation.SOURCES)})
 UNION ALL SELECT rec_no, 23, 'url', 'uri' FROM articles WHERE NOT (starts_with(url, 'http://') OR starts_with(url, 'https://'))
 UNION ALL SELECT rec_no, 24, 'created_at', 'date-time' FROM articles WHERE created_at IS NOT NULL AND NOT {_DATE_TIME.format("created_at")}
 UNION ALL SELECT rec_no, 25, 'saved_at', 'date-time' FROM articles WHERE saved_at IS NOT NULL AND NOT {_DATE_TIME.format("saved_at")}
 UNION ALL SELECT rec_no, 26, 'images', 'items' FROM articles WHERE len(list_filter(images, lambda x: x IS NULL)) > 0"""


@query(f"SELECT rec_no, field, reason FROM ({_FAILURES})")
def validation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failure of every article."""
    return validation.all_failures(table(spark, sf_dir, "articles"), "rec_no")


@query(f"SELECT rec_no, arg_min(field, k) AS field, arg_min(reason, k) AS reason FROM ({_FAILURES}) GROUP BY rec_no")
def validation_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure each invalid article is rejected with."""
    return validation.first_failures(table(spark, sf_dir, "articles"), "rec_no")


@query(f"SELECT field, reason, count(*) AS n FROM (SELECT rec_no, arg_min(field, k) AS field, arg_min(reason, k) AS reason FROM ({_FAILURES}) GROUP BY rec_no) GROUP BY ALL")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected articles by field and reason."""
    return validation_first_failure(spark, sf_dir).groupBy("field", "reason").agg(F.count("*").alias("n"))


@query("SELECT id, min(rec_no) AS rec_no, arg_min(title, rec_no) AS title FROM (SELECT id, rec_no, coalesce(title, '') AS title FROM articles) WHERE id IS NOT NULL GROUP BY id")
def first_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First saved row of each article id."""
    rows = table(spark, sf_dir, "articles").select("id", "rec_no", F.coalesce("title", F.lit("")).alias("title"))
    return archive.first_wins(rows, "id", ["rec_no"])


@query(
    "SELECT id, min(rec_no) AS rec_no FROM articles WHERE batch_no > 6 AND id IS NOT NULL AND id NOT IN (SELECT id FROM articles WHERE batch_no <= 6 AND id IS NOT NULL) GROUP BY id"
)
def new_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the later batches whose id the earlier ones do not hold."""
    rows = table(spark, sf_dir, "articles").select("id", "rec_no", "batch_no")
    return archive.new_rows(rows.filter("batch_no > 6").select("id", "rec_no"), rows.filter("batch_no <= 6"), "id", ["rec_no"])


@query(
    """WITH f AS (SELECT id, min(batch_no) AS batch_no FROM articles WHERE id IS NOT NULL GROUP BY id), e AS (SELECT batch_no, count(*) AS n FROM f GROUP BY batch_no)
    SELECT a.batch_no, any_value(coalesce(e.n, 0)) + count(*) FILTER (WHERE a.id IS NULL) AS exported,
    count(*) - any_value(coalesce(e.n, 0)) - count(*) FILTER (WHERE a.id IS NULL) AS skipped
    FROM articles a LEFT JOIN e ON a.batch_no = e.batch_no GROUP BY a.batch_no"""
)
def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported and skipped articles of each batch."""
    return archive.export_counts(table(spark, sf_dir, "articles").select("id", "batch_no", "rec_no"), "id", "batch_no", ["rec_no"])


@query(
    "SELECT batch_no, rec_no, place FROM (SELECT batch_no, rec_no, row_number() OVER (PARTITION BY batch_no ORDER BY rec_no) - 1 AS place FROM articles) WHERE place >= 5 AND place < 25"
)
def resumed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of twenty rows of each batch after an offset of five."""
    return archive.resume(table(spark, sf_dir, "articles").select("batch_no", "rec_no"), "batch_no", ["rec_no"], 5, 20)


@query("SELECT collection_id, CASE WHEN content.type IS NULL OR content.type = '' THEN 'unknown' ELSE content.type END AS type, count(*) AS n FROM collection_items GROUP BY ALL")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows by collection and type."""
    return archive.type_counts(table(spark, sf_dir, "collection_items"), "collection_id", F.col("content.type"))


@query("SELECT collection_id, CASE WHEN content.type IS NULL OR content.type = '' THEN 'answer' ELSE content.type END AS type, count(*) AS n FROM collection_items GROUP BY ALL")
def fixture_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows by type with the default of landed fixtures."""
    return archive.type_counts(table(spark, sf_dir, "collection_items"), "collection_id", F.col("content.type"), "answer")


_PAGES = """(SELECT collection_id, page_no, CASE WHEN page_no = 1 THEN t.total END AS total, kinds FROM (
    SELECT collection_id, page_no, list(coalesce(content.type, '')) AS kinds FROM collection_items GROUP BY ALL
    UNION ALL SELECT collection_id, max(page_no) + 1, [] FROM collection_items GROUP BY collection_id HAVING count(*) % 20 = 0)
    LEFT JOIN (SELECT collection_id, arg_min(reported_total, audit_no) AS total FROM audit_report WHERE reported_total IS NOT NULL GROUP BY collection_id) t USING (collection_id))"""


@query(
    f"""SELECT collection_id, arg_min(total, page_no) FILTER (WHERE total IS NOT NULL) AS reported_total, CAST(sum(len(kinds)) AS BIGINT) AS scanned_total, count(*) AS page_count,
    CASE WHEN arg_min(total, page_no) FILTER (WHERE total IS NOT NULL) <> sum(len(kinds)) THEN 'reported_total_mismatch' ELSE '' END AS warnings
    FROM {_PAGES} GROUP BY collection_id"""
)
def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of each listing from its pages; full listings end with an empty page, first pages report the total."""
    rows = table(spark, sf_dir, "collection_items")
    report = table(spark, sf_dir, "audit_report").filter("reported_total IS NOT NULL").groupBy("collection_id").agg(F.min_by("reported_total", "audit_no").alias("t"))
    item = F.to_json(F.struct("content"))
    pages = rows.groupBy("collection_id", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("i")))), lambda x: x["i"]).alias("items"))
    full = rows.groupBy("collection_id").agg(F.max("page_no").alias("m"), F.count("*").alias("n")).filter("n % 20 = 0")
    pages = pages.unionByName(full.select("collection_id", (F.col("m") + 1).alias("page_no"), F.array().cast("array<string>").alias("items")))
    pages = pages.join(report, "collection_id", "left").withColumn("total", F.when(F.col("page_no") == 1, F.col("t")))
    made = archive.audit_pages(pages, "collection_id")
    return made.select("collection_id", "reported_total", "scanned_total", "page_count", F.array_join("warnings", ",").alias("warnings"))


_EXPORTED = "SELECT coalesce(source_collection_id, source) AS collection_id, count(*) AS n FROM articles GROUP BY ALL"
_RECONCILED = f"""SELECT a.audit_no, a.collection_id, a.scanned_total, coalesce(e.n, 0) AS exported_total,
    CASE WHEN a.scanned_total IS NOT DISTINCT FROM coalesce(e.n, 0) THEN 'ok' ELSE 'mismatch' END AS status
    FROM audit_report a LEFT JOIN ({_EXPORTED}) e ON a.collection_id = e.collection_id"""


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").select(F.coalesce("source_collection_id", "source").alias("collection_id"))


@query(_RECONCILED)
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every audit row against the number of exported articles."""
    audits = table(spark, sf_dir, "audit_report").select("audit_no", "collection_id", "scanned_total")
    return archive.reconcile(audits, _exported(spark, sf_dir), "collection_id").select("audit_no", "collection_id", "scanned_total", "exported_total", "status")


@query(f"SELECT bool_or(status <> 'ok') AS any_mismatch, count(*) AS audits FROM ({_RECONCILED})")
def any_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any audit row differs from what was exported."""
    return reconciled(spark, sf_dir).agg(F.bool_or(F.col("status") != "ok").alias("any_mismatch"), F.count("*").alias("audits"))


@query(f"SELECT collection_id, greatest(max(coalesce(scanned_total, 0)), any_value(coalesce(e.n, 0))) AS exported FROM audit_report LEFT JOIN ({_EXPORTED}) e USING (collection_id) WHERE collection_id IS NOT NULL GROUP BY collection_id")
def export_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each collection's export is: the greater of what its state and what its output say; audits stand for states."""
    audits = table(spark, sf_dir, "audit_report").filter("collection_id IS NOT NULL").groupBy("collection_id").agg(F.max(F.coalesce("scanned_total", F.lit(0))).alias("known"))
    counts = _exported(spark, sf_dir).groupBy("collection_id").agg(F.count("*").alias("n"))
    return audits.join(counts, "collection_id", "left").select("collection_id", F.greatest("known", F.coalesce("n", F.lit(0))).alias("exported"))


@query(f"SELECT DISTINCT collection_id FROM ({_EXPORTED}) WHERE collection_id <> '' AND collection_id NOT IN (SELECT collection_id FROM audit_report WHERE collection_id IS NOT NULL)")
def pending_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections that were never audited."""
    return archive.pending(_exported(spark, sf_dir), table(spark, sf_dir, "audit_report"), "collection_id")


@query(
    f"""WITH l AS (SELECT collection_id, arg_max(scanned_total, audit_no) AS total FROM audit_report WHERE collection_id <> '' GROUP BY collection_id)
    SELECT l.collection_id, l.total, coalesce(e.n, 0) AS exported_total FROM l LEFT JOIN ({_EXPORTED}) e ON l.collection_id = e.collection_id
    WHERE l.total IS DISTINCT FROM coalesce(e.n, 0)"""
)
def incomplete_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections whose export is not complete by their last audit."""
    return archive.incomplete(table(spark, sf_dir, "audit_report"), _exported(spark, sf_dir), "collection_id", "audit_no")


def _any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w.lower()}')" for w in words) + ")"


_GIF = r"lower(regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(image_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '', 's'), ';[^/]*$', ''), '/+$', ''), '[^/.][^/]*(\.[^./]+)$', 1))"
_CONTEXT = "coalesce(title, '') || chr(10) || substr(coalesce(content, ''), 1, 5000) || chr(10) || coalesce(source_collection_title, '')"
_BUCKET = "CASE " + " ".join(
    f"WHEN {_any('t', w)}{f' AND len(imgs) <= {n}' if n else ''} THEN '{b}|{r}'" for w, b, r, n in triage.RULES
) + " ELSE 'review_unknown|unknown_context' END"
_TITLE = "CASE " + " ".join(f"WHEN {_any("coalesce(title, '')", w)} THEN '{b}|{r}'" for w, b, r in triage.TITLE_RULES) + " END"
_TRIAGE = f"""SELECT rec_no, pos, image_url, bucket, reasons || CASE WHEN {_GIF} = '.gif' THEN ',gif_url' ELSE '' END AS reasons FROM (
    SELECT rec_no, unnest(range(len(imgs))) AS pos, unnest(imgs) AS image_url, split_part(coalesce(tb, cb), '|', 1) AS bucket,
    CASE WHEN tb IS NULL THEN split_part(cb, '|', 2) WHEN split_part(tb, '|', 1) = split_part(cb, '|', 1) THEN split_part(cb, '|', 2) || ',' || split_part(tb, '|', 2) ELSE split_part(tb, '|', 2) END AS reasons
    FROM (SELECT rec_no, imgs, {_BUCKET} AS cb, {_TITLE} AS tb FROM (
    SELECT rec_no, title, list_filter(images, lambda x: x IS NOT NULL AND x <> '') AS imgs, {_CONTEXT} AS t FROM articles) WHERE len(imgs) > 0))"""


@query(_TRIAGE.replace("SELECT rec_no, pos,", "SELECT rec_no, CAST(pos AS INTEGER) AS position,"))
def triaged_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket and reasons of every article image."""
    made = triage.triage(table(spark, sf_dir, "articles"), "rec_no")
    return made.select("rec_no", "position", "image_url", "bucket", F.array_join("reasons", ",").alias("reasons"))


@query(f"SELECT bucket, count(*) AS images, count(DISTINCT rec_no) AS articles FROM ({_TRIAGE}) GROUP BY bucket")
def triage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and articles by bucket."""
    return triage.triage(table(spark, sf_dir, "articles"), "rec_no").groupBy("bucket").agg(F.count("*").alias("images"), F.countDistinct("rec_no").alias("articles"))


@query(
    f"""SELECT b.bucket, count(t.bucket) AS images, count(DISTINCT t.article_id) AS articles FROM (SELECT unnest([{", ".join(f"'{b}'" for b in triage.BUCKETS)}]) AS bucket) b
    LEFT JOIN triage_items t ON b.bucket = t.bucket GROUP BY b.bucket"""
)
def bucket_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and articles of every bucket of the report, empty buckets included."""
    return triage.bucket_report(table(spark, sf_dir, "triage_items"))


_ITEM_ORDER = ["collection_id", "article_id", "article_url", "image_url", "article_title"]
_ITEMS = "(SELECT coalesce(collection_id, '') AS collection_id, coalesce(article_id, '') AS article_id, coalesce(article_title, '') AS article_title, coalesce(article_url, '') AS article_url, coalesce(image_url, '') AS image_url, bucket FROM triage_items)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.lit("")
    texts = ("collection_id", "article_id", "article_title", "article_url", "image_url")
    return table(spark, sf_dir, "triage_items").select(*[F.coalesce(c, empty).alias(c) for c in texts], "bucket")


@query(
    f"""SELECT bucket, CAST(rank AS INTEGER) AS rank, article_title, article_url, image_url FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {", ".join(_ITEM_ORDER)}) AS rank
    FROM {_ITEMS} WHERE bucket IN ({", ".join(f"'{b}'" for b in triage.BUCKETS)})) WHERE rank <= 8"""
)
def bucket_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight images of each bucket."""
    rows = _items(spark, sf_dir).filter(F.col("bucket").isin(*triage.BUCKETS))
    return triage.examples(rows, _ITEM_ORDER).select("bucket", "rank", "article_title", "article_url", "image_url")


@query("SELECT count(DISTINCT article_id) AS articles_with_images, count(*) AS images_total FROM triage_items")
def triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and images of the report."""
    return triage.summary(table(spark, sf_dir, "triage_items"))


@query(
    f"""SELECT image_url, arg_min(article_id, o) AS article_id, arg_min(bucket, o) AS bucket FROM (SELECT *, [collection_id, article_id, article_title, bucket] AS o FROM {_ITEMS}
    WHERE image_url <> '' AND bucket IN ('keep_knowledge', 'review_possible_knowledge') AND {_GIF} <> '.gif') GROUP BY image_url"""
)
def download_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images to fetch: two buckets, no GIFs, each URL once."""
    order = ["collection_id", "article_id", "article_title", "bucket"]
    rows = _items(spark, sf_dir).select("image_url", *order)
    return archive.download_candidates(rows, ["keep_knowledge", "review_possible_knowledge"], order).select("image_url", "article_id", "bucket")


_STATUS = "CASE WHEN length(image_url) % 7 = 0 THEN 404 WHEN length(image_url) % 11 = 0 THEN 410 WHEN length(image_url) % 13 = 0 THEN 429 ELSE 200 END"


@query(
    f"""WITH f AS (SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY image_url) - 1 AS place, {_STATUS} AS status FROM (SELECT DISTINCT collection_id, image_url FROM {_ITEMS} WHERE image_url <> '')),
    s AS (SELECT collection_id, min(place) FILTER (WHERE status = 429) AS stop, max(place) AS last FROM f GROUP BY collection_id)
    SELECT s.collection_id, count(*) FILTER (WHERE status = 200 AND (stop IS NULL OR place < stop)) AS downloaded,
    count(*) FILTER (WHERE status <> 200 AND (stop IS NULL OR place < stop)) AS skipped,
    any_value(coalesce(stop, last + 1)) AS next_place, any_value(CASE WHEN stop IS NOT NULL THEN 'http_429' END) AS stopped_reason
    FROM s JOIN f ON s.collection_id = f.collection_id GROUP BY s.collection_id"""
)
def download_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a fetch log for each collection; the statuses are made up from the addresses."""
    rows = _items(spark, sf_dir).filter("image_url <> ''").select("collection_id", "image_url").distinct()
    length = F.length("image_url")
    status = F.when(length % 7 == 0, 404).when(length % 11 == 0, 410).when(length % 13 == 0, 429).otherwise(200)
    fetched = archive.resume(rows, "collection_id", ["image_url"], 0).select("collection_id", "place", status.alias("status"), F.lit(None).cast("string").alias("error"))
    return archive.download_log(fetched, "collection_id", ["place"])


@query(
    f"""SELECT image_url, substr(sha256(image_url), 1, 16) || CASE WHEN s IN ('.jpg', '.jpeg', '.png', '.webp', '.gif') THEN s ELSE '.jpg' END AS file_name
    FROM (SELECT image_url, {_GIF} AS s FROM (SELECT DISTINCT image_url FROM triage_items WHERE image_url IS NOT NULL))"""
)
def image_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed name of every image."""
    rows = table(spark, sf_dir, "triage_items").select("image_url").filter("image_url is not null").distinct()
    return rows.select("image_url", file_name(F.col("image_url"), F.lit("image/jpeg")).alias("file_name"))


@query(f"SELECT image_url, {_GIF} AS suffix, {_GIF} = '.gif' AS gif_path, lower(split_part(image_url, '?', 1)) LIKE '%.gif' AS gif_before_query FROM (SELECT DISTINCT image_url FROM triage_items WHERE image_url IS NOT NULL)")
def gif_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both definitions of a GIF address."""
    rows, url = table(spark, sf_dir, "triage_items").select("image_url").filter("image_url is not null").distinct(), F.col("image_url")
    return rows.select(url, path_suffix(url).alias("suffix"), is_gif_path(url).alias("gif_path"), is_gif_before_query(url).alias("gif_before_query"))


_MANIFEST = "(SELECT article_id, coalesce(article_title, '') AS article_title, coalesce(article_url, '') AS article_url, coalesce(path, '') AS path, coalesce(image_url, '') AS image_url FROM image_manifest)"


@query(
    f"""SELECT article_id, arg_min(article_title, o) AS article_title, arg_min(article_url, o) AS article_url, count(*) AS n_images, string_agg(path, ',' ORDER BY path, image_url) AS paths
    FROM (SELECT *, [path, image_url, article_title, article_url] AS o FROM {_MANIFEST} WHERE article_id <> '') GROUP BY article_id"""
)
def image_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved images by article."""
    empty = F.lit("")
    rows = table(spark, sf_dir, "image_manifest").select(
        "article_id", *[F.coalesce(c, empty).alias(c) for c in ("article_title", "article_url", "path", "image_url")], "bucket", "reasons"
    )
    made = archive.index_articles(rows, ["path", "image_url", "article_title", "article_url"])
    return made.select("article_id", "article_title", "article_url", "n_images", F.array_join(F.transform("images", lambda x: x.path), ",").alias("paths"))


_MISSING = f"""SELECT image_url, arg_min(article_id, o) AS article_id FROM (SELECT *, [collection_id, article_id, article_title] AS o FROM {_ITEMS}
    WHERE image_url <> '' AND bucket = 'keep_knowledge' AND NOT lower(split_part(image_url, '?', 1)) LIKE '%.gif')
    WHERE image_url NOT IN (SELECT image_url FROM image_manifest WHERE image_url IS NOT NULL) GROUP BY image_url"""


@query(_MISSING)
def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge images that the manifest does not hold."""
    order = ["collection_id", "article_id", "article_title"]
    rows = _items(spark, sf_dir).select("image_url", "bucket", *order)
    return archive.missing_candidates(rows, table(spark, sf_dir, "image_manifest"), order).select("image_url", "article_id")


@query(
    f"""SELECT (SELECT count(DISTINCT article_id) FROM image_manifest WHERE article_id <> '') AS articles, (SELECT count(*) FROM image_manifest) AS images,
    (SELECT count(*) FROM ({_MISSING})) AS missing_candidates"""
)
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, images and missing candidates of the index, in one row."""
    counts = table(spark, sf_dir, "image_manifest").agg(
        F.countDistinct(F.when(F.length("article_id") > 0, F.col("article_id"))).alias("articles"), F.count("*").alias("images")
    )
    missing = missing_images(spark, sf_dir).agg(F.count("*").alias("missing_candidates"))
    one = F.lit(1).alias("_one")
    return counts.select(one, "*").join(missing.select(one, "*"), "_one").drop("_one")


@query(
    r"""SELECT rec_no, CASE WHEN s <> '' THEN s || '://' || h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical,
    CASE WHEN regexp_matches(url, '/answers?/[0-9]+') THEN 'answer:' || regexp_extract(url, '/answers?/([0-9]+)', 1)
    WHEN regexp_matches(url, '(/p/|/articles/)[0-9]+') THEN 'article:' || regexp_extract(url, '(/p/|/articles/)([0-9]+)', 2)
    WHEN regexp_matches(url, '/zvideos?/[0-9]+') THEN 'zvideo:' || regexp_extract(url, '/zvideos?/([0-9]+)', 1)
    WHEN regexp_matches(url, '/pins?/[0-9]+') THEN 'pin:' || regexp_extract(url, '/pins?/([0-9]+)', 1) END AS item
    FROM (SELECT rec_no, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), CASE WHEN lower(url) LIKE 'http://%' THEN ':80$' ELSE ':443$' END, '') AS h,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN
    ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'spm', 'fbclid', 'gclid'))), '&') AS q FROM articles) WHERE url IS NOT NULL"""
)
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical address and platform item of every article."""
    url = F.col("url")
    return table(spark, sf_dir, "articles").filter("url is not null").select("rec_no", canonical(url).alias("canonical"), platform_key(url).alias("item"))


@query("SELECT DISTINCT source, id, source_collection_id AS collection_id FROM articles WHERE id <> '' AND source_collection_id <> ''")
def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which article is in which collection."""
    rows = table(spark, sf_dir, "articles").select("source", "id", F.col("source_collection_id").alias("collection_id"))
    return documents.memberships(rows, "source", "id", "collection_id")


@query(
    r"""SELECT doc_id, sha256(nfc_normalize(trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) || chr(31) || coalesce(lang, '')) AS hash FROM documents"""
)
def plain_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of every document's plain, composed text and language."""
    empty = F.lit("")
    text = F.concat(nfc(plain_text(F.coalesce("text", empty))), F.lit("\u001f"), F.coalesce("lang", empty))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("hash"))


@query(
    """WITH r AS (SELECT id, batch_no, rec_no, sha256(coalesce(content, '')) AS n, sha256(coalesce(content, '') || chr(31) || coalesce(title, '')) AS s FROM articles WHERE id IS NOT NULL),
    o AS (SELECT id, arg_max(n, rec_no) AS n, arg_max(s, rec_no) AS s FROM r WHERE batch_no <= 6 GROUP BY id), w AS (SELECT id, arg_max(n, rec_no) AS n, arg_max(s, rec_no) AS s FROM r WHERE batch_no > 6 GROUP BY id)
    SELECT coalesce(o.id, w.id) AS id, CASE WHEN o.n IS NULL THEN 'created' WHEN w.n IS NULL THEN 'absent' WHEN o.n <> w.n THEN 'normalised_changed' WHEN o.s <> w.s THEN 'source_changed' ELSE 'unchanged' END AS change
    FROM o FULL JOIN w ON o.id = w.id"""
)
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the later batches change in the earlier ones."""
    empty, unit = F.lit(""), F.lit("\u001f")
    content = F.coalesce("content", empty)
    rows = table(spark, sf_dir, "articles").filter("id is not null").select(
        "id", "batch_no", "rec_no", F.sha2(content, 256).alias("n"), F.sha2(F.concat(content, unit, F.coalesce("title", empty)), 256).alias("s")
    )
    last = lambda part: part.groupBy("id").agg(F.max_by("n", "rec_no").alias("normalised_hash"), F.max_by("s", "rec_no").alias("source_hash"))
    return documents.changes(last(rows.filter("batch_no <= 6")), last(rows.filter("batch_no > 6")), "id")


_PLAIN_TITLE = r"lower(trim(regexp_replace(regexp_replace(title, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '))"
_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda k: substr({0}, k, 3)))"


@query(
    f"""WITH t AS (SELECT rec_no, {_PLAIN_TITLE} AS x FROM articles WHERE title IS NOT NULL), s AS (SELECT DISTINCT lower(title) AS query FROM articles WHERE rec_no % 100 = 0 AND title IS NOT NULL),
    p AS (SELECT query, {_PLAIN_TITLE.replace("title", "query")} AS x FROM s), q AS (SELECT query, len(g) AS n, unnest(g) AS t FROM (SELECT query, {_GRAMS.format("x")} AS g FROM p WHERE length(x) >= 3)),
    d AS (SELECT rec_no, unnest({_GRAMS.format("x")}) AS t FROM t WHERE length(x) >= 3)
    SELECT query, rec_no, round(count(*) / n, 6) AS score FROM d JOIN q ON d.t = q.t GROUP BY query, rec_no, n HAVING round(count(*) / n, 6) >= 0.6"""
)
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that share most trigrams with the title of every hundredth article."""
    rows = table(spark, sf_dir, "articles").filter("title is not null").select("rec_no", "title")
    asked = rows.filter(F.col("rec_no") % 100 == 0).select(F.lower("title").alias("query")).distinct()
    return documents.search(rows, "rec_no", F.col("title"), asked, 0.6)


@query(
    """WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 100 = 0)
    SELECT query, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT query, vec_id, round(list_dot_product(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS score
    FROM q JOIN embeddings ON vec_id <> query)) WHERE rank <= 10"""
)
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return documents.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


@query(
    """WITH r AS (SELECT doc_id, collection_id, epoch(captured_at)::BIGINT AS s FROM documents WHERE collection_id IS NOT NULL AND captured_at IS NOT NULL),
    p AS (SELECT a.doc_id, b.doc_id AS other, abs(a.s - b.s) AS gap FROM r a JOIN r b ON a.collection_id = b.collection_id AND a.doc_id <> b.doc_id AND abs(a.s - b.s) <= 86400)
    SELECT doc_id, other, gap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gap, other) AS k FROM p) WHERE k <= 50"""
)
def related_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a collection captured within a day of each other."""
    return documents.related_by_time(table(spark, sf_dir, "documents"), "doc_id", "collection_id", F.col("captured_at").cast("timestamp").cast("bigint"), 86400)


@query(
    """SELECT doc_id, source, CAST(row_number() OVER (ORDER BY manual DESC, evergreen DESC, captured_at, tie) AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY manual DESC, evergreen DESC, captured_at, tie) AS r FROM (
    SELECT doc_id, source, coalesce(batch_no, 0) % 3 AS manual, least(n_chars // 1000, 5) AS evergreen, captured_at, sha256('2026-07-12|' || doc_id) AS tie
    FROM documents WHERE n_chars > 0 AND captured_at IS NOT NULL AND NOT coalesce(lang = 'und', false))) WHERE r <= 2 ORDER BY manual DESC, evergreen DESC, captured_at, tie LIMIT 5"""
)
def daily_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of the day by two priorities and age, at most two of a source; those of unknown language count as seen."""
    rows = table(spark, sf_dir, "documents").filter("n_chars > 0 AND captured_at IS NOT NULL")
    rows = rows.withColumn("manual", -(F.coalesce("batch_no", F.lit(0)) % 3)).withColumn("evergreen", -F.least(F.floor(F.col("n_chars") / 1000), F.lit(5)))
    order = [F.col("manual"), F.col("evergreen"), F.col("captured_at")]
    return documents.daily_review(rows, "doc_id", "source", order, "2026-07-12", F.col("lang") == "und")


@query("SELECT coalesce(source, '') AS source, count(*) AS n, count(DISTINCT collection_id) AS collections, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1")
def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source."""
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count("*").alias("n"), F.countDistinct("collection_id").alias("collections"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


@query(
    """SELECT user_id AS job, count(*) FILTER (WHERE k = 'claim') AS claims, CASE WHEN bool_or(k = 'done') THEN 'done'
    WHEN max(CASE WHEN k IN ('claim', 'heartbeat') THEN ts END) + INTERVAL 15 MINUTE > TIMESTAMP '2024-01-10 00:00:00' AND (max(CASE WHEN k = 'failed' THEN ts END) IS NULL OR max(CASE WHEN k = 'failed' THEN ts END) < max(CASE WHEN k IN ('claim', 'heartbeat') THEN ts END)) THEN 'leased'
    WHEN count(*) FILTER (WHERE k = 'claim') >= 3 THEN 'dead' ELSE 'ready' END AS state
    FROM (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN event_id % 50 = 0 THEN 'done' WHEN event_id % 3 = 0 THEN 'claim' WHEN event_id % 3 = 1 THEN 'heartbeat' ELSE 'failed' END AS k FROM events) GROUP BY user_id"""
)
def job_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of jobs from a log; the kinds are made up from the event numbers."""
    n = F.col("event_id")
    kind = F.when(n % 50 == 0, "done").when(n % 3 == 0, "claim").when(n % 3 == 1, "heartbeat").otherwise("failed")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"))
    return documents.leases(events, "job", "at", "kind", F.lit("2024-01-10 00:00:00").cast("timestamp"))


@query(
    """SELECT count(*) AS rows, CAST(sum(('0x' || substr(sha256(coalesce(id, chr(1)) || chr(31) || coalesce(title, chr(1)) || chr(31) || coalesce(content, chr(1)) || chr(31) || coalesce(saved_at, chr(1))), 1, 15))::HUGEINT) AS VARCHAR) AS hash FROM articles"""
)
def archive_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the archive that does not depend on order."""
    return documents.logical_hash(table(spark, sf_dir, "articles"), "id", "title", "content", "saved_at")
