"""A Python data source for paged listings over HTTP or a landed folder of pages.

The source gives whole pages, also the empty one that ends a listing, so that audits can
count them and read the reported total; ``items`` flattens pages and applies the limit.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PAGE, TIMEOUT = 20, 45.0
# Statuses after which a request is not made again.
FINAL_STATUSES = (401, 403, 429)

Fetch = Callable[[int], dict[str, Any]]


class FetchError(RuntimeError):
    """A page could not be had; ``final`` errors are not tried again."""

    def __init__(self, message: str, final: bool = False):
        super().__init__(message)
        self.final = final


class Page(NamedTuple):
    """One page of a listing."""

    number: int
    place: int
    total: int | None
    items: list[Any]
    last: bool

    @classmethod
    def of(cls, number: int, place: int, payload: dict[str, Any]) -> Page:
        """The page of a payload; data that is no list is an error."""
        items, paging = payload.get("data", []), payload.get("paging")
        if not isinstance(items, list):
            raise FetchError("data is not a list", True)
        paging = paging if isinstance(paging, dict) else {}
        total = paging.get("totals")
        return cls(number, place, None if total is None else int(total), items, not items or paging.get("is_end") is True)


def listing(fetch: Fetch, offset: int = 0, enough: int | None = None, pause: Callable[[int], None] = lambda n: None) -> Iterator[Page]:
    """Pages from ``offset`` to the last or empty one, or until they hold ``enough`` items; ``pause`` gets the items just read."""
    page = Page.of(0, offset, fetch(offset))
    yield page
    while not page.last and (enough is None or page.place + len(page.items) - offset < enough):
        pause(len(page.items))
        place = page.place + len(page.items)
        page = Page.of(page.number + 1, place, fetch(place))
        yield page


def get_json(url: str, headers: dict[str, str], timeout: float = TIMEOUT) -> dict[str, Any]:
    """The JSON object at an address."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as response:
            kind, body = response.headers.get("Content-Type", ""), response.read()
    except urllib.error.HTTPError as error:
        raise FetchError(f"HTTP {error.code}", error.code in FINAL_STATUSES) from error
    except (OSError, urllib.error.URLError) as error:
        raise FetchError(f"request failed: {error}") from error
    made = json.loads(body.decode("utf-8", "replace")) if "json" in kind.lower() else None
    if not isinstance(made, dict):
        raise FetchError("response is not a JSON object", True)
    return made


def patient(fetch: Fetch, attempts: int, delay: float) -> Fetch:
    """``fetch`` that is tried up to ``attempts`` times (once at least) unless an error is final."""

    def tried(place: int) -> dict[str, Any]:
        for left in reversed(range(max(1, attempts))):
            try:
                return fetch(place)
            except FetchError as error:
                if error.final or not left:
                    raise
                time.sleep(max(0.0, delay))
        raise AssertionError

    return tried


def landed(folder: str) -> Fetch:
    """Pages of a folder, each in <place>.json; where none is, the listing ends."""

    def fetch(place: int) -> dict[str, Any]:
        file = Path(folder, f"{place}.json")
        return json.loads(file.read_text("utf-8")) if file.exists() else {}

    return fetch


class _Part(InputPartition):
    def __init__(self, address: str):
        self.address = address


class PagedReader(DataSourceReader):
    """One partition an address, so that each listing is read in order and by one task."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Part(a) for a in self.options["path"].split(",") if a.strip()]

    def read(self, partition: _Part) -> Iterator[tuple]:
        o, address = self.options, partition.address
        headers = {"Accept": "application/json"} | ({"Cookie": o["cookie"]} if o.get("cookie") else {})
        delay, fetch = float(o.get("delay", 2.0)), landed(address)
        if live := "://" in address:
            sign = "&" if "?" in address else "?"
            fetch = patient(lambda place: get_json(f"{address}{sign}offset={place}&limit={PAGE}", headers), int(o.get("attempts", 3)), delay)
        pause = (lambda n: time.sleep(delay * n)) if live else (lambda n: None)
        for page in listing(fetch, int(o.get("offset", 0)), int(o.get("limit", 0)) or None, pause):
            yield address, page.number, page.place, page.total, [json.dumps(x, ensure_ascii=False) for x in page.items]


class PagedSource(DataSource):
    """``spark.read.format("paged").load("address,address")``; options offset, limit, cookie, delay, attempts."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "address string, page_no bigint, page_place bigint, total bigint, items array<string>"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options))


def items(pages: DataFrame, offset: int = 0, limit: int = 0) -> DataFrame:
    """(address, page_no, place, item) of pages, at most ``limit`` of an address (0: all)."""
    rows = pages.select("address", "page_no", "page_place", F.posexplode("items").alias("_at", "item"))
    rows = rows.select("address", "page_no", (F.col("page_place") + F.col("_at")).alias("place"), "item")
    return rows.filter(F.col("place") < offset + limit) if limit else rows
