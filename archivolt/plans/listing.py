"""Queries that make article records of listings, pins, videos and landed documents, with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions.text import parsed_html
from archivolt.functions.urls import collection_id, detail_url, is_http, member_page_url, member_token, page_url, platform_key
from archivolt.operators import records
from archivolt.plans.queries import query
from archivolt.workspace import table

SAVED = "2026-06-30T12:00:00Z"
#: White space as Python's \\s and str.strip() know it, for RE2.
_SPACE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _text(value: str) -> str:
    return f"trim(regexp_replace(coalesce({value}, ''), '{_SPACE}', ' ', 'g'), ' ')"


def _images(value: str) -> str:
    return f"list_filter(coalesce({value}, []), lambda x, i: (starts_with(x, 'http://') OR starts_with(x, 'https://')) AND list_position({value}, x) = i)"


def _iso(seconds: str) -> str:
    return f"strftime(make_timestamp(CAST({seconds} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def article_html(content: Column, images: Column) -> Column:
    """A body as listings give it: the escaped content in a paragraph, and the images after it."""
    shown = F.transform(F.filter(F.coalesce(images, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.concat(F.lit('<img src="'), _escaped(x), F.lit('">')))
    return F.concat(F.lit("<p>"), _escaped(F.coalesce(content, F.lit(""))), F.lit("</p><!-- images -->"), F.array_join(shown, ""))


@query(
    f"""SELECT rec_no, {_text("content")} AS plain, array_to_string({_images("imgs")}, ' ') AS images
    FROM (SELECT *, list_filter(coalesce(images, []), lambda x: x IS NOT NULL AND x <> '') AS imgs FROM articles)"""
)
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and images of every article, back from a body in HTML."""
    rows = table(spark, sf_dir, "articles").select("rec_no", parsed_html(article_html(F.col("content"), F.col("images"))).alias("p"))
    return rows.select("rec_no", F.col("p.text").alias("plain"), F.array_join("p.images", " ").alias("images"))


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, detail) of answers and articles: the first saved row of each id, as the site gives it."""
    rows = table(spark, sf_dir, "articles").filter(F.col("id").rlike("^zhihu_(answer|article)_[0-9]+$"))
    row = F.struct("rec_no", "title", "url", "author", "content", "images")
    rows = rows.groupBy("id").agg(F.min_by(row, "rec_no").alias("r")).select("id", "r.*")
    name = F.struct(F.col("title").alias("title"))
    detail = F.struct(
        F.split_part("id", F.lit("_"), F.lit(3)).cast("bigint").alias("id"), "url", "title", name.alias("question"),
        article_html(F.col("content"), F.col("images")).alias("content"), F.struct(F.col("author").alias("name")).alias("author"),
        (F.col("rec_no") + 1_700_000_000).alias("created_time"), (F.col("rec_no") + 1_700_000_000).cast("string").alias("created"),
    )
    parts = F.split("id", "_")
    return rows.select(parts[1].alias("kind"), parts[2].alias("id"), F.to_json(detail).alias("detail"))


_DETAILS = """(SELECT split_part(id, '_', 2) AS kind, split_part(id, '_', 3) AS n, 1700000000 + min(rec_no) AS created, arg_min(struct_pack(title := title, url := url, author := author, content := content,
    imgs := list_filter(coalesce(images, []), lambda x: x IS NOT NULL AND x <> '')), rec_no) AS d FROM articles WHERE regexp_matches(id, '^zhihu_(answer|article)_[0-9]+$') GROUP BY id)"""
_COLLECTION = f"""SELECT item_no, error, CASE WHEN error IS NULL THEN 'zhihu_' || kind || '_' || num END AS id, CASE WHEN error IS NULL THEN title END AS title, CASE WHEN error IS NULL THEN url END AS url,
    CASE WHEN error IS NULL THEN author END AS author, CASE WHEN error IS NULL THEN content END AS content, CASE WHEN error IS NULL THEN {_iso("made")} END AS created_at,
    CASE WHEN error IS NULL THEN array_to_string(images, ' ') END AS images FROM (
    SELECT *, CASE WHEN kind IS NULL OR kind NOT IN ('answer', 'article', 'pin', 'zvideo') OR num IS NULL THEN 'type' WHEN needed AND d IS NULL THEN 'detail' WHEN kind <> 'pin' AND coalesce(title, '') = '' THEN 'title'
    WHEN coalesce(url, '') = '' THEN 'url' WHEN coalesce(author, '') = '' THEN 'author.name' WHEN made IS NULL THEN 'created' END AS error FROM (
    SELECT item_no, c.content.type AS kind, c.content.id AS num, d, c.content.type IN ('answer', 'article') AS needed,
    CASE WHEN d IS NOT NULL THEN d.title WHEN c.content.type = 'pin' THEN 'Zhihu pin ' || c.content.id ELSE c.content.title END AS title, CASE WHEN d IS NOT NULL THEN d.url ELSE c.content.url END AS url,
    CASE WHEN d IS NOT NULL THEN d.author ELSE c.content.author.name END AS author, CASE WHEN d IS NOT NULL THEN {_text("d.content")} WHEN c.content.type = 'pin' THEN '' ELSE c.content.title END AS content,
    CASE WHEN d IS NOT NULL THEN p.created ELSE c.created END AS made, CASE WHEN d IS NOT NULL THEN {_images("d.imgs")}
    WHEN c.content.type = 'zvideo' AND regexp_matches(c.content.thumbnail, '^https?://') THEN [c.content.thumbnail] ELSE [] END AS images
    FROM collection_items c LEFT JOIN {_DETAILS} p ON p.kind = c.content.type AND p.n = CAST(c.content.id AS VARCHAR)))"""


@query(_COLLECTION)
def collection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing items as records; answers and articles take their landed details, and what gives no record is named."""
    c = F.col("content")
    payload = F.struct(*[c[f].alias(f) for f in ("type", "id", "url", "title", "question", "author", "thumbnail")], "created")
    items = table(spark, sf_dir, "collection_items").select("item_no", F.to_json(F.struct(payload.alias("content"))).alias("item"))
    made = records.collection_records(items, ["item_no"], _details(spark, sf_dir), F.lit(SAVED))
    return made.select("item_no", "error", "id", "title", "url", "author", "content", "created_at", F.array_join("images", " ").alias("images"))


@query(f"SELECT coalesce(error, 'ok') AS error, count(*) AS n FROM ({_COLLECTION}) GROUP BY ALL")
def collection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing items by what they lack."""
    return collection_records(spark, sf_dir).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT rec_no, error, CASE WHEN error IS NULL THEN 'zhihu_article_' || rec_no END AS id, CASE WHEN error IS NULL THEN CASE WHEN bare THEN title ELSE {_text("content")} END END AS content,
    CASE WHEN error IS NULL THEN {_iso("1700000000 + rec_no")} END AS created_at FROM (SELECT *, coalesce(content, '') = '' AS bare, CASE WHEN rec_no % 7 = 0 THEN 'type' WHEN coalesce(content, '') = '' AND rec_no % 5 = 0 THEN 'detail'
    WHEN coalesce(title, '') = '' THEN 'title' WHEN coalesce(url, '') = '' THEN 'url' WHEN coalesce(author, '') = '' THEN 'author.name' END AS error FROM articles)"""
)
def member_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member's listing made of the articles: every seventh is of another type; those without body need a detail, which every fifth lacks."""
    n = F.col("rec_no")
    common = [F.when(n % 7 == 0, "answer").otherwise("article").alias("type"), n.alias("id"), "title", "url", F.struct(F.col("author").alias("name")).alias("author"), (n + 1_700_000_000).alias("created")]
    html = F.concat(F.lit("<p>"), _escaped(F.col("content")), F.lit("</p>"))
    rows = table(spark, sf_dir, "articles").withColumn("html", F.when(F.length("content") > 0, html))
    items = rows.select("rec_no", F.to_json(F.struct(*common, F.col("html").alias("content"))).alias("item"))
    details = rows.filter("html IS NULL AND rec_no % 5 <> 0").select(F.lit("article").alias("kind"), n.cast("string").alias("id"), F.to_json(F.struct(*common)).alias("detail"))
    made = records.member_records(items, ["rec_no"], details, F.lit(SAVED))
    return made.select("rec_no", "error", "id", "content", "created_at")


@query(
    f"""SELECT rec_no, 'zhihu_pin_' || rec_no AS id, CASE WHEN substr(plain, 1, 80) = '' THEN 'Zhihu pin ' || rec_no ELSE substr(plain, 1, 80) END AS title, plain AS content, array_to_string(list_filter(urls, lambda x: x IS NOT NULL), ' ') AS images FROM (
    SELECT rec_no, {_text("coalesce(nullif(regexp_replace(coalesce(title, ''), '^" + _SPACE + "$', ''), '') || ' ', '') || coalesce(content, '')")} AS plain,
    list_transform(imgs, lambda x, i: CASE WHEN NOT regexp_matches(x, '^https?://') THEN NULL WHEN len(list_filter(imgs[1:i], lambda y: y = x)) = 1 THEN x WHEN len(list_filter(imgs[1:i], lambda y: y = x)) = 2 THEN x || '#2' END) AS urls
    FROM (SELECT rec_no, title, content, url, author, list_filter(coalesce(images, []), lambda x: x IS NOT NULL AND x <> '') AS imgs FROM articles)
    WHERE coalesce(url, '') <> '' AND coalesce(author, '') <> '')"""
)
def pin_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins made of the articles: title and content are text blocks, images are blocks of their own with a second address."""
    rows = table(spark, sf_dir, "articles").withColumn("imgs", F.filter(F.coalesce("images", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
    kind = "type string, own_text string, content string, original_url string, url string"
    block = lambda **f: F.struct(*[f.get(c.split()[0], F.lit(None).cast("string")).alias(c.split()[0]) for c in kind.split(", ")])
    texts = F.array(block(type=F.lit("text"), own_text=_escaped(F.coalesce("title", F.lit("")))), block(type=F.lit("text"), own_text=F.lit(""), content=_escaped(F.coalesce("content", F.lit("")))))
    second = lambda x: F.when(is_http(x), F.concat(x, F.lit("#2")))
    blocks = F.concat(texts, F.transform("imgs", lambda x: block(type=F.lit("image"), original_url=x, url=second(x))))
    payload = F.struct(F.lit("pin").alias("type"), F.col("rec_no").alias("id"), "url", F.struct(F.col("author").alias("name")).alias("author"), F.lit(1705291200).alias("created"), blocks.alias("content"))
    made = records.collection_records(rows.select("rec_no", F.to_json(F.struct(payload.alias("content"))).alias("item")), ["rec_no"], None, F.lit(SAVED))
    return made.filter("error IS NULL").select("rec_no", "id", "title", "content", F.array_join("images", " ").alias("images"))


@query(
    f"""SELECT rec_no, error, CASE WHEN error IS NULL THEN title END AS title, CASE WHEN error IS NULL THEN {_iso("made")} END AS created_at, CASE WHEN error IS NULL THEN array_to_string({_images("imgs")}, ' ') END AS images FROM (
    SELECT *, CASE WHEN coalesce(title, '') = '' THEN 'title' WHEN coalesce(url, '') = '' THEN 'url' WHEN coalesce(author, '') = '' THEN 'author.name' WHEN made IS NULL THEN 'created' END AS error FROM (
    SELECT rec_no, title, url, author, list_filter([images[1], images[2], images[3], images[4]], lambda x: x IS NOT NULL) AS imgs,
    CASE rec_no % 4 WHEN 0 THEN 1700000000 + rec_no WHEN 1 THEN 1600000000 + rec_no WHEN 2 THEN 1700000000 + rec_no END AS made FROM articles))"""
)
def video_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos made of the articles: four keys hold images, created_at goes before created even where it is no number."""
    n, images = F.col("rec_no"), lambda k: F.get("images", F.lit(k))
    moment = F.when(n % 4 == 0, (n + 1_700_000_000).cast("string")).when(n % 4 == 2, F.concat((n + 1_700_000_000).cast("string"), F.lit(".75"))).when(n % 4 == 3, "soon")
    payload = F.struct(
        F.lit("zvideo").alias("type"), n.alias("id"), "url", "title", F.struct(F.col("author").alias("name")).alias("author"), moment.alias("created_at"),
        (n + 1_600_000_000).alias("created"), images(0).alias("thumbnail"), images(1).alias("image_url"), images(2).alias("cover_url"), F.struct(images(3).alias("url")).alias("thumbnail_info"),
    )
    items = table(spark, sf_dir, "articles").select("rec_no", F.to_json(F.struct(payload.alias("content"))).alias("item"))
    made = records.collection_records(items, ["rec_no"], None, F.lit(SAVED))
    return made.select("rec_no", "error", "title", "created_at", F.array_join("images", " ").alias("images"))


@query(
    """SELECT rec_no, '1.0' AS schema_version, 'zhihu_' || coalesce(id, 'x') AS id, 'zhihu' AS source, title, content, created_at, '2026-06-30T12:00:00Z' AS saved_at,
    len(coalesce(images, [])) AS n_images FROM articles WHERE rec_no > 5"""
)
def fixture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a landed document from offset five on as records."""
    rows = table(spark, sf_dir, "articles").withColumn("place", F.col("rec_no") - 1).filter("place >= 5").withColumn("id", F.coalesce("id", F.lit("x")))
    made = records.fixture_records(rows, ["rec_no"], F.lit(SAVED))
    return made.select("rec_no", "schema_version", "id", "source", "title", "content", "created_at", "saved_at", F.size("images").cast("bigint").alias("n_images"))


@query(
    r"""SELECT rec_no, regexp_extract(u, '/collection/([0-9]+)', 1) AS collection, 'https://a.example/collections/' || regexp_extract(u, '/collection/([0-9]+)', 1) || '/items?offset=' || 20 * (rec_no % 5) || '&limit=20' AS page,
    'https://a.example/members/' || regexp_extract(u, '/people/([^/?#]+)', 1) || '/articles?offset=' || 20 * (rec_no % 5) || '&limit=20&sort_by=created' AS member_page,
    CASE WHEN regexp_matches(url, '/answers?/[0-9]+') THEN 'https://a.example/answers/' || regexp_extract(url, '/answers?/([0-9]+)', 1) || '?include=content%2Ccreated_time%2Cquestion%2Cauthor'
    WHEN regexp_matches(url, '(/p/|/articles/)[0-9]+') THEN 'https://b.example/articles/' || regexp_extract(url, '(/p/|/articles/)([0-9]+)', 2) END AS detail
    FROM (SELECT *, 'https://a.example/people/' || source || '_' || rec_no || '?x=1/collection/' || source_collection_id AS u FROM articles WHERE regexp_matches(source_collection_id, '^[0-9]+$'))"""
)
def listing_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that a client asks for, from those a user gives."""
    rows = table(spark, sf_dir, "articles").filter(F.col("source_collection_id").rlike("^[0-9]+$"))
    rows = rows.withColumn("u", F.concat(F.lit("https://a.example/people/"), "source", F.lit("_"), F.col("rec_no"), F.lit("?x=1/collection/"), "source_collection_id"))
    offset, key = (F.col("rec_no") % 5) * 20, platform_key(F.col("url"))
    kind, number = F.split_part(key, F.lit(":"), F.lit(1)), F.split_part(key, F.lit(":"), F.lit(2))
    detail = F.when(kind.isin("answer", "article"), detail_url("https://a.example", kind, number, "https://b.example"))
    u, base = F.col("u"), "https://a.example"
    return rows.select(
        "rec_no", collection_id(u).alias("collection"), page_url(base, collection_id(u), offset).alias("page"), member_page_url(base, member_token(u), offset).alias("member_page"), detail.alias("detail")
    )
