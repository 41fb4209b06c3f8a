"""Command line over the archive's jobs.

Exit codes: 0 done, 1 stopped or not matching, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import validation
from archivolt.plans import jobs
from archivolt.sources import config, files, jsonl, paged

#: Options by name, with what argparse is told of them.
OPTIONS: dict[str, dict] = {
    "address": {"required": True, "help": "address or landed folder of the listing's pages"},
    "list": {"type": Path, "required": True, "help": "file of addresses"},
    "fixture": {"help": "landed document to read instead of a listing"},
    "details": {"help": "table (kind, id, detail) of landed details, as JSON lines"},
    "output": {"required": True},
    "state": {"required": True, "help": "file, or folder for several jobs, of the places to go on from"},
    "settings": {"type": Path, "help": "settings file with the cookie"},
    "audit": {"help": "audit report; collections complete by it are left out"},
    "report": {"required": True},
    "raw": {"required": True, "help": "raw file, or folder of raw files"},
    "folder": {"required": True, "help": "folder of the images"},
    "manifest": {"required": True},
    "log": {"help": "log of a batch"},
    "bucket": {"action": "append", "default": [], "help": "added to keep_knowledge"},
    "include-gifs": {"action": "store_true"},
    "limit": {"type": int, "default": 5},
    "images": {"type": int, "default": 20, "help": "images to save at most, 0 for all"},
    "delay": {"type": float, "default": 2.0},
    "pause": {"type": float, "default": 0.0, "help": "seconds between two listings of a batch"},
    "attempts": {"type": int, "default": 3},
}
_HTTP = ("settings", "delay", "attempts")
COMMANDS: dict[str, tuple[str, ...]] = {
    "export": ("address", "fixture", "details", "output", "state", "limit", *_HTTP),
    "export-author": ("address", "details", "output", "state", "limit", *_HTTP),
    "export-batch": ("list", "details", "output", "state", "limit", "audit", "log", "pause", *_HTTP),
    "audit": ("list", "report", *_HTTP),
    "verify": ("report", "raw"),
    "images": ("raw", "folder", "state", "images", "delay"),
    "triage": ("raw", "report"),
    "triage-download": ("report", "manifest", "folder", "state", "bucket", "include-gifs", "images", "delay"),
    "index": ("manifest", "report", "output"),
    "validate": ("raw",),
}


def parser() -> argparse.ArgumentParser:
    """The commands and their options."""
    made = argparse.ArgumentParser(prog="archivolt")
    verbs = made.add_subparsers(dest="verb", required=True)
    for name, options in COMMANDS.items():
        command = verbs.add_parser(name)
        for option in options:
            told = OPTIONS[option] | ({"required": False} if option == "address" and "fixture" in options else {})
            command.add_argument(f"--{option}", **told)
    return made


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command."""
    try:
        o = parser().parse_args(argv)
    except SystemExit as error:
        return int(error.code or 0)
    spark = spark or SparkSession.builder.appName("archivolt").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return RUN[o.verb](spark, o)
    except (ValueError, paged.FetchError) as error:
        print(error, file=sys.stderr)
    except Exception as error:  # an error that a task of the source raised
        if "FetchError" not in str(error):
            raise
        print(str(error).splitlines()[0], file=sys.stderr)
    return 1


def _how(o: argparse.Namespace) -> dict:
    cookie = config.load(o.settings).cookie if o.settings else ""
    return {"delay": o.delay, "attempts": o.attempts, "cookie": cookie}


def _details(spark: SparkSession, o: argparse.Namespace) -> DataFrame | None:
    return spark.read.schema("kind string, id string, detail string").json(o.details) if o.details else None


def _export(spark: SparkSession, o: argparse.Namespace) -> int:
    if getattr(o, "fixture", None):
        done = jobs.export_fixture(spark, o.fixture, o.output, o.state)
    elif o.address:
        done = jobs.export_listing(spark, o.address, o.output, o.state, _details(spark, o), o.verb == "export-author", o.limit, **_how(o))
    else:
        raise ValueError("an address or a fixture is required")
    print(f"exported={done[0]} skipped={done[1]}")
    return 0


def _export_batch(spark: SparkSession, o: argparse.Namespace) -> int:
    addresses = config.addresses(o.list)
    if o.audit:
        addresses = jobs.incomplete_addresses(spark, addresses, o.audit, o.output)
    for k, address in enumerate(addresses):
        time.sleep(o.pause if k else 0.0)
        name = jobs.listing_name(address)
        try:
            done = jobs.export_listing(spark, address, f"{o.output}/set-{name}.jsonl", f"{o.state}/{name}.json", _details(spark, o), False, o.limit, **_how(o))
        except Exception as error:
            if o.log:
                files.log(spark, o.log, f"{name} stopped: {str(error).splitlines()[0]}")
            raise
        said = f"{name}: exported={done[0]} skipped={done[1]}"
        print(said)
        if o.log:
            files.log(spark, o.log, said)
    return 0


def _audit(spark: SparkSession, o: argparse.Namespace) -> int:
    for r in jobs.audit(spark, config.addresses(o.list), o.report, **_how(o)).orderBy("collection_id").toLocalIterator():
        types = " ".join(f"{k}={n}" for k, n in sorted(r.type_counts.items()))
        print(f"{r.collection_id}: reported={r.reported_total} scanned={r.scanned_total} pages={r.page_count} {types} warnings={','.join(r.warnings) or '-'}")
    return 0


def _verify(spark: SparkSession, o: argparse.Namespace) -> int:
    made = jobs.verify(spark, o.report, o.raw)
    for r in made.toLocalIterator():
        print(f"{r.collection_id}: scanned={r.scanned_total} exported={r.exported_total} {r.status}")
    return 1 if made.filter("status <> 'ok'").head(1) else 0


def _downloaded(done: dict) -> int:
    print(f"downloaded={done['downloaded']} skipped={done['skipped']} stopped={done['stopped_reason'] or '-'}")
    return 1 if done["stopped_reason"] else 0


def _images(spark: SparkSession, o: argparse.Namespace) -> int:
    config.check_delay(o.delay)
    state = o.state if o.state.endswith(".json") else files.state_path(o.state, o.raw)
    return _downloaded(jobs.download_images(jobs.raw_images(spark, o.raw), "raw", o.folder, state, None, limit=o.images, delay=o.delay))


def _triage_download(spark: SparkSession, o: argparse.Namespace) -> int:
    config.check_delay(o.delay)
    found = jobs.candidates(spark, o.report, o.bucket, o.include_gifs)
    return _downloaded(jobs.download_images(found, "triage", o.folder, o.state, o.manifest, limit=o.images, delay=o.delay))


def _triage(spark: SparkSession, o: argparse.Namespace) -> int:
    made = jobs.triage_report(spark, o.raw, o.report)
    print(" ".join(f"{k}={v}" for k, v in made["summary"].items()))
    for bucket, r in made["buckets"].items():
        print(f"{bucket}: images={r['images']} articles={r['articles']}")
    return 0


def _index(spark: SparkSession, o: argparse.Namespace) -> int:
    print(" ".join(f"{k}={v}" for k, v in jobs.image_index(spark, o.manifest, o.report, o.output).items()))
    return 0


def _validate(spark: SparkSession, o: argparse.Namespace) -> int:
    broken = validation.raw_failures(jsonl.lines(spark, o.raw)).groupBy("field", "reason").agg(F.count("*").alias("n")).collect()
    for r in broken:
        print(f"{r.field}\t{r.reason}\t{r.n}")
    return 1 if broken else 0


RUN = {
    "export": _export, "export-author": _export, "export-batch": _export_batch, "audit": _audit, "verify": _verify, "images": _images,
    "triage": _triage, "triage-download": _triage_download, "index": _index, "validate": _validate,
}


if __name__ == "__main__":
    sys.exit(main())
