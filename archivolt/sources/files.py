"""Small files of a job through the cluster's file system: documents, states, logs, images."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def now() -> str:
    """UTC date-time with Z at second precision."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _target(spark: SparkSession, path: str) -> tuple[Any, Any]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at a path or glob."""
    system, target = _target(spark, path)
    return bool(system.globStatus(target))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, None if it is missing."""
    rows = spark.read.text(path, wholetext=True).collect() if exists(spark, path) else []
    return rows[0].value if rows else None


def write_text(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """Write parts one after another to a file that replaces the one before."""
    system, target = _target(spark, path)
    out = system.create(target, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode("utf-8")))
    finally:
        out.close()


def append_text(spark: SparkSession, path: str, line: str) -> None:
    """Add a line to a small file."""
    write_text(spark, path, [read_text(spark, path) or "", line.rstrip("\n") + "\n"])


def log(spark: SparkSession, path: str, message: str) -> None:
    """Add a message with its time to a log."""
    append_text(spark, path, f"{now()} {message}")


def load_state(spark: SparkSession, path: str) -> dict[str, int]:
    """offset and exported of a job; zero for a job that has no state yet."""
    text = read_text(spark, path)
    known = json.loads(text) if text else {}
    return {k: int(known[k]) if text else 0 for k in ("offset", "exported")}


def save_state(spark: SparkSession, path: str, offset: int, exported: int) -> None:
    """Replace the state of a job."""
    state = {"offset": offset, "exported": exported, "updated_at": now()}
    write_text(spark, path, [json.dumps(state, ensure_ascii=False, sort_keys=True, indent=2)])


def state_path(folder: str, raw: str) -> str:
    """Where the state of an image job on a raw file is: named by the digits after the last dash, else by the whole stem."""
    stem = PurePosixPath(raw).stem
    number = re.search(r"-(\d+)", stem)
    return f"{folder.rstrip('/')}/images-{number.group(1) if number else stem}.state.json"


def json_list(rows: DataFrame) -> Iterator[str]:
    """The rows as members of a JSON list, fetched partition by partition."""
    first = True
    for row in rows.toLocalIterator(prefetchPartitions=True):
        yield ("\n    " if first else ",\n    ") + json.dumps(row.asDict(recursive=True), ensure_ascii=False)
        first = False


def write_document(spark: SparkSession, path: str, parts: dict[str, Any]) -> None:
    """Write an object whose values are plain, or tables that become lists; the driver holds one partition at a time."""

    def pieces() -> Iterator[str]:
        yield "{"
        for k, (name, value) in enumerate(parts.items()):
            yield ("," if k else "") + f"\n  {json.dumps(name)}: "
            if isinstance(value, DataFrame):
                yield "["
                yield from json_list(value)
                yield "\n  ]"
            else:
                yield json.dumps(value, ensure_ascii=False, indent=2).replace("\n", "\n  ")
        yield "\n}\n"

    write_text(spark, path, pieces())
