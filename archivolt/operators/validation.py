"""The closed article schema and why a record breaks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from archivolt.functions.text import is_date_time
from archivolt.functions.urls import is_http

# The record's fields, versions, sources and the form of its id.
REQUIRED = ("schema_version", "id", "source", "title", "url", "author", "content", "created_at", "saved_at")
OPTIONAL = ("source_collection_id", "source_collection_title", "images", "raw_html")
VERSION = "1.0"
SOURCES = ("zhihu", "github", "arxiv", "pdf", "web", "youtube", "bilibili", "rss", "note")
ID_PATTERN = r"^[a-z]+_[a-zA-Z0-9._-]+$"

ARTICLE = StructType(
    [StructField(f, StringType()) for f in REQUIRED]
    + [StructField(f, ArrayType(StringType()) if f == "images" else StringType()) for f in OPTIONAL]
)


def failures(known: list[str]) -> Column:
    """All failures of a typed row as structs of field and reason, in the order they are checked.

    ``known`` are the row's columns. Null counts as a missing field. Missing fields come
    first in schema order, then values field by field.
    """
    found = [_failure(F.col(f).isNull() if f in known else F.lit(True), f, "missing") for f in REQUIRED]
    found += [
        _failure(F.col("schema_version") != VERSION, "schema_version", "const"),
        _failure(~F.col("id").rlike(ID_PATTERN), "id", "pattern"),
        _failure(~F.col("source").isin(*SOURCES), "source", "enum"),
        _failure(~is_http(F.col("url")), "url", "uri"),
        _failure(~is_date_time(F.col("created_at")), "created_at", "date-time"),
        _failure(~is_date_time(F.col("saved_at")), "saved_at", "date-time"),
    ]
    if "images" in known:
        found.append(_failure(F.exists("images", lambda x: x.isNull()), "images", "items"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _failure(broken: Column, field: str, reason: str) -> Column:
    return F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason")))


def all_failures(df: DataFrame, key: str) -> DataFrame:
    """(key, field, reason): every failure of every row; valid rows have none."""
    return df.select(key, F.explode(failures(df.columns)).alias("f")).select(key, "f.field", "f.reason")


def first_failures(df: DataFrame, key: str) -> DataFrame:
    """(key, field, reason): the failure a record is rejected with."""
    return df.select(key, F.get(failures(df.columns), F.lit(0)).alias("f")).filter("f is not null").select(key, "f.field", "f.reason")


def valid(df: DataFrame) -> DataFrame:
    """The rows without a failure."""
    return df.filter(F.size(failures(df.columns)) == 0)


def raw_failures(df: DataFrame, value: str = "value") -> DataFrame:
    """(value, field, reason): first failure of JSON lines, with types and unknown fields checked too.

    Missing fields come first in schema order, then unknown ones by name, then values in the
    order of the record's own fields. A line that is no JSON object fails as a whole, with a
    null field.
    """
    record = F.try_parse_json(value)
    keys = F.json_object_keys(value)
    kind = lambda f: F.schema_of_variant(F.try_variant_get(record, f"$.{f}", "variant"))
    text = lambda f: F.try_variant_get(record, f"$.{f}", "string")
    absent = F.array_except(F.array(*map(F.lit, REQUIRED)), keys)
    extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, REQUIRED + OPTIONAL))))
    checks = [
        _failure(F.size(absent) > 0, "", "missing"),
        _failure(F.size(extra) > 0, "", "extra"),
    ]
    for field in REQUIRED + OPTIONAL:
        if field == "images":
            checks.append(_failure(F.array_contains(keys, field) & ~kind(field).startswith("ARRAY"), field, "array"))
            checks.append(_failure(kind(field).startswith("ARRAY") & ~kind(field).isin("ARRAY<STRING>", "ARRAY<VOID>"), field, "items"))
            continue
        checks.append(_failure(F.array_contains(keys, field) & (F.coalesce(kind(field), F.lit("")) != "STRING"), field, "string"))
        if field == "schema_version":
            checks.append(_failure(text(field) != VERSION, field, "const"))
        elif field == "id":
            checks.append(_failure(~text(field).rlike(ID_PATTERN), field, "pattern"))
        elif field == "source":
            checks.append(_failure(~text(field).isin(*SOURCES), field, "enum"))
        elif field == "url":
            checks.append(_failure(~is_http(text(field)), field, "uri"))
        elif field in ("created_at", "saved_at"):
            checks.append(_failure(~is_date_time(text(field)), field, "date-time"))
    place = lambda x: F.when(x["field"] == "", F.lit(0)).otherwise(F.array_position(keys, x["field"]))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    first = F.array_min(F.transform(found, lambda x, k: F.struct(place(x).alias("at"), k.alias("k"), x["field"].alias("field"), x["reason"].alias("reason"))))
    named = F.when(keys.isNull(), F.lit(None)).when(first.reason == "missing", F.get(absent, F.lit(0))).when(first.reason == "extra", F.get(extra, F.lit(0))).otherwise(first.field)
    broken = df.select(value, keys.alias("_k"), named.alias("field"), first.reason.alias("reason"))
    return broken.select(value, "field", F.when(F.col("_k").isNull(), F.lit("json")).otherwise(F.col("reason")).alias("reason")).filter(
        "reason is not null"
    )
