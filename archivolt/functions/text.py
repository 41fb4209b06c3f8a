"""Text, time and HTML functions."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Longest part of a content that the keyword rules look at, in code points.
CONTEXT_LENGTH = 5000


def contains_any(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a text holds one of the keywords as a substring, whatever the case; null counts as empty."""
    lowered, made = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for keyword in keywords:
        made = made | F.contains(lowered, F.lit(keyword.lower()))
    return made


def context(title: Column, content: Column, collection_title: Column) -> Column:
    """Title, start of the content and collection title on three lines; nulls count as empty."""
    empty = F.lit("")
    return F.concat_ws(
        "\n", F.coalesce(title, empty), F.substring(F.coalesce(content, empty), 1, CONTEXT_LENGTH), F.coalesce(collection_title, empty)
    )


def unix_to_iso(seconds: Column) -> Column:
    """UTC date-time with Z at second precision; null for null. The session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


DATE_TIME = r"^\d{4}-(0[1-9]|1[0-2])-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def is_date_time(value: Column) -> Column:
    """Whether a string is an ISO date-time without fraction, with Z or an offset, of an existing day; null for null."""
    day = F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd"))
    return F.when(value.isNotNull(), value.rlike(DATE_TIME) & day.isNotNull() & ~value.startswith("0000"))


def plain_text(text: Column) -> Column:
    """Tags removed, white space runs as one space, none at the ends: a readable form without UDF."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Canonically composed text; null stays null."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.images: list[str] = []

    def handle_data(self, data: str) -> None:
        if stripped := data.strip():
            self.parts.append(stripped)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "img":
            known = dict(attrs)
            source = next((known[a] for a in ("src", "data-original", "data-actualsrc") if known.get(a)), "")
            if source.startswith(("http://", "https://")):
                self.images.append(source)


def parse_html(value: str) -> tuple[str, list[str]]:
    """(text, image addresses) of a piece of HTML.

    The parser is not told that the input ends: text after an unfinished entity at the end
    is left out. Bodies of script and style count as text, comments don't.
    """
    parser = _Text()
    parser.feed(value)
    return re.sub(r"\s+", " ", " ".join(parser.parts)).strip(), list(dict.fromkeys(parser.images))


@F.pandas_udf(StructType().add("text", "string").add("images", ArrayType(StringType())))
def parsed_html(values: pd.Series) -> pd.DataFrame:
    """Text and image addresses of HTML in one pass; null has null parts."""
    parsed = [(None, None) if v is None else parse_html(v) for v in values]
    return pd.DataFrame({"text": [text for text, _ in parsed], "images": [images for _, images in parsed]})


@F.pandas_udf(StringType())
def html_to_text(values: pd.Series) -> pd.Series:
    """Exact text of HTML; null stays null."""
    return values.map(lambda v: None if v is None else parse_html(v)[0])


@F.pandas_udf(ArrayType(StringType()))
def html_images(values: pd.Series) -> pd.Series:
    """http(s) addresses of img elements in order, each once; null stays null."""
    return values.map(lambda v: None if v is None else parse_html(v)[1])
