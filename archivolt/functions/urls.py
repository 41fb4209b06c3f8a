"""URL functions as column expressions."""

from __future__ import annotations

import hashlib
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes kept in file names, and suffixes by media type.
KEPT_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".gif")
SUFFIX_BY_TYPE = {"image/png": ".png", "image/webp": ".webp", "image/gif": ".gif"}
# Query keys that only track.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "fbclid", "gclid")


def path_suffix(url: Column) -> Column:
    """Lower-case suffix of the URL's path with its dot, empty without one.

    A name that is only a suffix (``/.gif``) and a trailing dot have none; a slash at the
    end is ignored; query, fragment and parameters of the last segment are left out.
    """
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    path = F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), r"/+$", "")
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def is_gif_path(url: Column) -> Column:
    """Whether the path's suffix is .gif; null for null."""
    return path_suffix(url) == ".gif"


def is_gif_before_query(url: Column) -> Column:
    """Whether what stands before the first question mark ends in .gif, whatever its case."""
    return F.lower(F.substring_index(url, "?", 1)).endswith(".gif")


def is_http(url: Column) -> Column:
    """Whether the URL starts with http:// or https://, in lower case."""
    return url.startswith("http://") | url.startswith("https://")


def file_name(url: Column, content_type: Column) -> Column:
    """Content-addressed name: 16 hex digits of SHA-256 and the suffix of path, else of media type, else .jpg."""
    suffix = path_suffix(url)
    by_type = F.lit(".jpg")
    for kind, extension in SUFFIX_BY_TYPE.items():
        by_type = F.when(content_type == kind, F.lit(extension)).otherwise(by_type)
    return F.concat(F.substring(F.sha2(url, 256), 1, 16), F.when(suffix.isin(*KEPT_SUFFIXES), suffix).otherwise(by_type))


def image_name(url: str, content_type: str) -> str:
    """As ``file_name`` for one address in Python, where a body is saved."""
    suffix = PurePosixPath(urlparse(url).path).suffix.lower()
    suffix = suffix if suffix in KEPT_SUFFIXES else SUFFIX_BY_TYPE.get(content_type, ".jpg")
    return hashlib.sha256(url.encode("utf-8")).hexdigest()[:16] + suffix


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment, tracking keys or final slash; query sorted."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    pairs = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(pairs, lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING_KEYS)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, path, query))


def collection_id(url: Column) -> Column:
    """Digits after /collection/, null without them."""
    found = F.regexp_extract(url, r"/collection/(\d+)", 1)
    return F.when(found != "", found)


def member_token(url: Column) -> Column:
    """Token after /people/, null without one."""
    found = F.regexp_extract(url, r"/people/([^/?#]+)", 1)
    return F.when(found != "", found)


def platform_key(url: Column) -> Column:
    """kind:number of an item from its page or API address, null for any other address."""
    made = F.lit(None).cast("string")
    for kind, pattern in (
        ("pin", r"/pins?/(\d+)"),
        ("zvideo", r"/zvideos?/(\d+)"),
        ("article", r"(?:/p/|/articles/)(\d+)"),
        ("answer", r"/answers?/(\d+)"),
    ):
        found = F.regexp_extract(url, pattern, 1)
        made = F.when(found != "", F.concat(F.lit(kind + ":"), found)).otherwise(made)
    return made


def detail_url(base: str, kind: Column, number: Column, articles: str | None = None) -> Column:
    """Address of the detail of an answer, or of an article at ``articles``."""
    answer = F.concat(F.lit(f"{base}/answers/"), number, F.lit("?include="), F.url_encode(F.lit("content,created_time,question,author")))
    return F.when(kind == "answer", answer).otherwise(F.concat(F.lit(f"{articles or base}/articles/"), number))


def page_url(base: str, collection: Column, offset: Column, limit: int = 20) -> Column:
    """Address of a page of a collection's items."""
    return F.format_string(f"{base}/collections/%s/items?offset=%d&limit={limit}", collection, offset)


def member_page_url(base: str, token: Column, offset: Column, limit: int = 20) -> Column:
    """Address of a page of a member's articles."""
    return F.format_string(f"{base}/members/%s/articles?offset=%d&limit={limit}&sort_by=created", token, offset)
