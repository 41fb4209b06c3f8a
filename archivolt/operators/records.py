"""Article records from the JSON items of listings, and what is wrong with items that give none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.text import parsed_html, unix_to_iso
from archivolt.functions.urls import is_http

# The record's version and source, the item types, and the keys that hold images.
VERSION, SOURCE = "1.0", "zhihu"
TYPES = ("answer", "article", "pin", "zvideo")
BLOCK_IMAGES = ("original_url", "url", "watermark_url")
VIDEO_IMAGES = ("thumbnail", "image_url", "cover_url", "thumbnail_info.url")
TITLE_LENGTH = 80

FIELDS = ("schema_version", "id", "source", "title", "url", "author", "content", "created_at", "saved_at", "images")
_NO_TEXTS = "array<string>"


def now_iso() -> Column:
    """The time of the query as UTC date-time with Z at second precision."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _part(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _kind(value: Column, path: str) -> Column:
    """JSON type of a part: STRING, BIGINT, OBJECT<..>, ARRAY<..>; null if it is absent or null."""
    made = F.schema_of_variant(_part(value, path, "variant"))
    return F.nullif(made, F.lit("VOID"))


def _is(value: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.startswith(_kind(value, path), F.lit(kind)), F.lit(False))


def html_of(value: Column) -> Column:
    """The HTML of a body; anything but a non-empty string is none and gives an empty text."""
    return F.when(_is(value, "content", "STRING"), _part(value, "content")).otherwise("")


def block_html(value: Column) -> Column:
    """Texts of a pin's text blocks, own_text before content, joined with line breaks of HTML."""
    blocks = F.filter(F.coalesce(_part(value, "content", "array<variant>"), F.array().cast("array<variant>")), lambda b: _part(b, "type") == "text")
    text = lambda b: F.coalesce(F.nullif(_part(b, "own_text"), F.lit("")), _part(b, "content"), F.lit(""))
    return F.array_join(F.transform(blocks, text), "<br>")


def block_images(value: Column) -> Column:
    """Of each image block of a pin the first http(s) address that no block before gave."""
    blocks = F.filter(F.coalesce(_part(value, "content", "array<variant>"), F.array().cast("array<variant>")), lambda b: _part(b, "type") == "image")
    named = F.transform(blocks, lambda b: F.array(*[_part(b, k) for k in BLOCK_IMAGES]))

    def taken(found: Column, keys: Column) -> Column:
        fresh = F.filter(keys, lambda u: u.isNotNull() & is_http(u) & ~F.array_contains(found, u))
        return F.concat(found, F.slice(fresh, 1, 1))

    return F.aggregate(named, F.array().cast(_NO_TEXTS), taken)


def video_images(value: Column) -> Column:
    """http(s) addresses of a video's thumbnail keys in their order, each once."""
    return F.array_distinct(F.filter(F.array(*[_part(value, k) for k in VIDEO_IMAGES]), lambda u: u.isNotNull() & is_http(u)))


def _record(kind: Column, body: Column, saved_at: Column, html: Column, more_images: Column) -> tuple[Column, Column]:
    """(record, error) of one item from its type and body, the parsed HTML and images found outside of it."""
    missing = lambda path: F.coalesce(_part(body, path), F.lit("")) == ""
    answer, pin, video = kind == "answer", kind == "pin", kind == "zvideo"
    named = F.when(answer, _part(body, "question.title")).otherwise(_part(body, "title"))
    plain = html["text"]
    title = F.when(pin, F.coalesce(F.nullif(F.substring(plain, 1, TITLE_LENGTH), F.lit("")), F.concat(F.lit("Zhihu pin "), _part(body, "id")))).otherwise(named)
    content = F.when(pin, plain).when(video | (html["source"] == ""), named).otherwise(plain)
    has_key = F.array_contains(F.json_object_keys(F.to_json(body)), "created_at")
    moment = F.when(answer, _part(body, "created_time")).when(video & has_key, _part(body, "created_at")).otherwise(_part(body, "created"))
    # int() of the source takes whole numbers as numbers or text, and cuts fractions of numbers off
    seconds = F.when(F.trim(moment).rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), F.expr("bigint(0)") + F.trim(F.substring_index(moment, ".", 1)).try_cast("bigint"))
    images = F.when(pin | video, more_images).otherwise(F.coalesce(html["images"], F.array().cast(_NO_TEXTS)))
    rules = [
        (missing("id"), "id"),
        (answer & ~_is(body, "question", "OBJECT"), "question"),
        (~pin & (F.coalesce(named, F.lit("")) == ""), "title"),
        (missing("url"), "url"),
        (~_is(body, "author", "OBJECT"), "author"),
        (missing("author.name"), "author.name"),
        (seconds.isNull(), "created"),
    ]
    error = F.coalesce(*[F.when(broken, F.lit(name)) for broken, name in rules])
    values = {
        "schema_version": F.lit(VERSION),
        "id": F.concat(F.lit(f"{SOURCE}_"), kind, F.lit("_"), _part(body, "id")),
        "source": F.lit(SOURCE),
        "title": title,
        "url": _part(body, "url"),
        "author": _part(body, "author.name"),
        "content": content,
        "created_at": unix_to_iso(seconds),
        "saved_at": saved_at,
        "images": images,
    }
    return F.struct(*[values[f].alias(f) for f in FIELDS]), error


def _finished(rows: DataFrame, keys: list[str], saved_at: Column, strict: bool) -> DataFrame:
    """(keys, record fields, error) of rows with _kind, _body and _error, the HTML parsed in one pass."""
    pin = F.col("_kind") == "pin"
    html = F.when(pin, block_html(F.col("_body"))).when(F.col("_kind") == "zvideo", "").otherwise(html_of(F.col("_body")))
    images = F.when(pin, block_images(F.col("_body"))).otherwise(video_images(F.col("_body")))
    rows = rows.select(*keys, "_kind", "_body", "_error", F.coalesce(html, F.lit("")).alias("_html"), images.alias("_images"))
    rows = rows.withColumn("_parsed", parsed_html("_html"))
    parsed = F.struct(F.col("_html").alias("source"), F.col("_parsed.text").alias("text"), F.col("_parsed.images").alias("images"))
    record, wrong = _record(F.col("_kind"), F.col("_body"), saved_at, parsed, F.col("_images"))
    rows = rows.select(*keys, F.coalesce("_error", wrong).alias("error"), record.alias("_r"))
    if strict:
        stop = F.raise_error(F.concat(F.lit("item without "), F.col("error"))).cast("string")
        rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), stop))
    return rows.select(*keys, *[F.when(F.col("error").isNull(), F.col(f"_r.{f}")).alias(f) for f in FIELDS], "error")


def _with_details(rows: DataFrame, keys: list[str], details: DataFrame | None) -> DataFrame:
    """Replace the body of the rows that need one by the detail of their type and id; only those rows are joined."""
    need = rows.filter("_need AND _error IS NULL").drop("_body", "_error")
    rest = rows.filter("NOT (_need AND _error IS NULL)").select(*keys, "_kind", "_body", "_error")
    if details is None:
        joined = need.withColumn("_body", F.lit(None).cast("variant"))
    else:
        known = details.select(F.col("kind").alias("_kind"), F.col("id").cast("string").alias("_id"), F.try_parse_json("detail").alias("_body"))
        joined = need.join(known, ["_kind", "_id"], "left")
    missing = F.when(F.col("_body").isNull(), F.lit("detail"))
    return rest.unionByName(joined.select(*keys, "_kind", "_body", missing.alias("_error")))


def collection_records(items: DataFrame, keys: list[str], details: DataFrame | None = None, saved_at: Column | None = None, strict: bool = False) -> DataFrame:
    """(keys, record fields, error) of listing items, one row for each.

    ``items`` has the JSON text ``item`` with the payload under content, ``details`` has
    (kind, id, detail as JSON text), one row for each kind and id. Answers take their detail,
    articles only if the payload has no body, pins and videos never. ``error`` names what
    the item lacks, with null fields; ``strict`` makes the first one an error of the query.
    """
    item = F.try_parse_json("item")
    rows = items.select(*keys, _part(item, "content", "variant").alias("_body"))
    body = F.col("_body")
    kind, number = _part(body, "type"), _part(body, "id")
    unknown = ~F.coalesce(kind.isin(*TYPES), F.lit(False)) | number.isNull()
    no_payload = ~F.coalesce(F.startswith(F.schema_of_variant(body), F.lit("OBJECT")), F.lit(False))
    error = F.when(no_payload, "content").when(unknown, "type")
    bare = F.coalesce(_part(body, "content"), F.to_json(_part(body, "content", "variant")), F.lit("")) == ""
    need = (kind == "answer") | ((kind == "article") & bare)
    rows = rows.select(*keys, kind.alias("_kind"), number.alias("_id"), "_body", error.alias("_error"), F.coalesce(need, F.lit(False)).alias("_need"))
    return _finished(_with_details(rows, keys, details), keys, now_iso() if saved_at is None else saved_at, strict)


def member_records(items: DataFrame, keys: list[str], details: DataFrame | None = None, saved_at: Column | None = None, strict: bool = False) -> DataFrame:
    """As ``collection_records`` for the items of a member's listing, which are articles without an envelope."""
    body = F.try_parse_json("item")
    rows = items.select(*keys, body.alias("_body"))
    body = F.col("_body")
    kind, number = _part(body, "type"), _part(body, "id")
    error = F.when(~F.coalesce(kind == "article", F.lit(False)), "type").when(number.isNull(), "id")
    need = F.coalesce(_part(body, "content"), F.lit("")) == ""
    rows = rows.select(*keys, kind.alias("_kind"), number.alias("_id"), "_body", error.alias("_error"), need.alias("_need"))
    return _finished(_with_details(rows, keys, details), keys, now_iso() if saved_at is None else saved_at, strict)


def fixture_records(items: DataFrame, keys: list[str], saved_at: Column | None = None) -> DataFrame:
    """(keys, record fields) of the plain items of a landed document: the id gets its source, absent images are none."""
    images = F.coalesce("images", F.array().cast(_NO_TEXTS))
    values = {"schema_version": F.lit(VERSION), "id": F.concat(F.lit(f"{SOURCE}_"), F.col("id").cast("string")), "source": F.lit(SOURCE), "saved_at": now_iso() if saved_at is None else saved_at, "images": images}
    return items.select(*keys, *[values.get(f, F.col(f)).alias(f) for f in FIELDS])
