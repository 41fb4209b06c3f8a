"""Fetching images of jobs in order, with resume, a limit and stop rules."""

from __future__ import annotations

import http.client
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.functions.urls import image_name
from archivolt.operators.archive import SKIPPED_STATUSES

TIMEOUT = 30.0
#: (status, body, media type) of an address.
FetchImage = Callable[[str], tuple[int, bytes, str]]
LOG = "job string, place bigint, image_url string, status int, error string, path string"


def get_image(url: str) -> tuple[int, bytes, str]:
    """Status, body and media type of an address; errors of the network are raised."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "image/*"}), timeout=TIMEOUT) as answer:
            return answer.status, answer.read(), answer.headers.get_content_type()
    except urllib.error.HTTPError as error:
        return error.code, b"", ""


def outcome(fetch: FetchImage, url: str) -> tuple[int | None, str | None, bytes, str]:
    """(status, error, body, media type): a timeout or a network error has no status."""
    try:
        status, body, kind = fetch(url)
        return status, None, body, kind
    except TimeoutError:
        return None, "timeout", b"", ""
    except (http.client.IncompleteRead, urllib.error.URLError, OSError):
        return None, "network_error", b"", ""


def stops(status: int | None) -> bool:
    """Whether a job ends at an image with this status."""
    return status is None or status >= 400 and status not in SKIPPED_STATUSES


def fetched(items: DataFrame, folder: str, fetch: FetchImage = get_image, limit: int = 0, delay: float = 0.0) -> DataFrame:
    """The fetch log (job, place, image_url, status, error, path) of ``items`` (job, place, image_url).

    The images of a job are asked for in the order of their places by one task, different
    jobs by different ones; ``limit`` counts those saved (0: all). A job ends with the image
    that stops it. Bodies go to ``folder``, which all executors mount, under names of their
    address, so that a task that runs again writes the same files.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, saved, ended = None, 0, False
        for part in parts:
            out: list[tuple] = []
            for row in part.itertuples(index=False):
                if row.job != job:
                    job, saved, ended = row.job, 0, False
                if ended or limit and saved >= limit:
                    continue
                status, error, body, kind = outcome(fetch, row.image_url)
                path, ended = None, stops(status)
                if status is not None and status < 400:
                    os.makedirs(folder, exist_ok=True)
                    path = os.path.join(folder, image_name(row.image_url, kind))
                    with open(path, "wb") as file:
                        file.write(body)
                    saved += 1
                    time.sleep(delay)
                out.append((row.job, row.place, row.image_url, status, error, path))
            frame = pd.DataFrame(out, columns=["job", "place", "image_url", "status", "error", "path"])
            yield frame.astype({"status": "Int32"})

    rows = items.select(F.col("job").cast("string").alias("job"), F.col("place").cast("bigint").alias("place"), "image_url")
    return rows.repartition("job").sortWithinPartitions("job", "place").mapInPandas(run, LOG)
