"""JSON lines: strict and tolerant reading, counting, and sorted-key appending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from archivolt.operators.validation import ARTICLE, first_failures
from archivolt.sources.files import exists

#: Where a line stands in its file.
LINE_NO = "struct<path: string, block: bigint, row: bigint>"
#: Line breaks as str.splitlines() knows them.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def records(spark: SparkSession, path: str, schema: StructType = ARTICLE, strict: bool = True, located: bool = False, raw: bool = False) -> DataFrame:
    """Records of JSON lines; a missing path gives an empty table with the schema.

    Strict reading fails on a malformed line; otherwise such lines are left out. ``located``
    adds file and line_no, which orders the lines of a file; with ``raw`` only raw files are
    parsed.
    """
    if not exists(spark, path):
        empty = spark.createDataFrame([], schema)
        return empty.select(F.lit(None).cast("string").alias("file"), F.lit(None).cast(LINE_NO).alias("line_no"), "*") if located else empty
    if not located:
        return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    rows = raw_files(lines(spark, path)) if raw else lines(spark, path)
    value = F.when(_is_raw(F.col("file")), F.col("value")) if raw else F.col("value")  # whatever order the filters come in
    rows = rows.select("file", "line_no", "value", F.from_json(value, schema, {"mode": "FAILFAST"} if strict else {}).alias("_r"))
    rows = rows if strict else rows.filter(F.try_parse_json("value").isNotNull())
    return rows.select("file", "line_no", "_r.*")


def line_error(value: Column) -> Column:
    """Why a line holds no record: not JSON, or not an object; null if it does."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    return F.when(F.try_parse_json(value).isNull(), "not JSON").when(~kind.startswith("OBJECT"), "not an object")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value, error) of the lines that are no JSON object."""
    rows = lines(spark, path)
    error = line_error(F.col("value"))
    return rows.withColumn("error", error).filter("error IS NOT NULL")


def fixture(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """(place, item fields) of a landed document's items from ``offset`` on."""
    fields = "id string, title string, url string, author string, content string, created_at string, images array<string>"
    kind = ", ".join(x.replace(" ", ": ", 1) for x in fields.split(", "))
    rows = spark.read.schema(f"items array<struct<{kind}>>").option("multiLine", True).json(path)
    return rows.select(F.posexplode("items").alias("place", "i")).select(F.col("place").cast("bigint").alias("place"), "i.*").filter(F.col("place") >= offset)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file) of the files at a path, empty ones included."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(_file(F.col("path")).alias("file")).distinct()


def _file(path: Column) -> Column:
    """Name of the JSON lines file a path is, or is a part of; else the path's last name."""
    found = F.regexp_extract(path, r"([^/]*\.jsonl)(?:/[^/]*)?$", 1)
    return F.when(found != "", F.url_decode(found)).otherwise(F.element_at(F.split(path, "/"), -1))


def lines(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """(file, line_no, value) of the non-blank lines of files, or of folders of them that Spark wrote.

    ``line_no`` (path, block, row) orders the lines of a file. ``exact`` splits at every
    Unicode line break, which takes each file as a whole; else files are split and read in
    parallel.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], f"file string, line_no {LINE_NO}, value string")
    place = lambda block, row: F.struct(F.col("_path").alias("path"), block.alias("block"), row.cast("bigint").alias("row"))
    reader = spark.read.option("recursiveFileLookup", True)
    if exact:
        whole = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
        rows = whole.select("_path", F.posexplode(F.split("value", LINE_BREAKS)).alias("_row", "value"))
        rows = rows.select("_path", place(F.lit(0).cast("bigint"), F.col("_row")).alias("line_no"), "value")
    else:
        rows = reader.text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), "value")
        rows = rows.select("_path", place(F.col("_block"), F.col("_row")).alias("line_no"), "value")
    return rows.select(_file(F.col("_path")).alias("file"), "line_no", "value").filter(F.col("value").rlike(r"(?U)\S"))


def known_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Distinct non-empty ids of JSON lines, malformed lines skipped."""
    ids = lines(spark, path).select(F.try_variant_get(F.try_parse_json("value"), f"$.{key}", "string").alias(key))
    return ids.filter(F.length(key) > 0).distinct()


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, n) of non-blank lines; files without any have no row."""
    return lines(spark, path).groupBy("file").agg(F.count("*").alias("n"))


def collection_of_file(file: Column, prefix: str) -> Column:
    """Digits after the prefix in a file's name, else the name without its suffix."""
    found = F.regexp_extract(file, prefix + r"(\d+)", 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(file, r"\.[^.]*$", ""))


def exported_collection(file: Column) -> Column:
    """What follows the first dash in the name of an exported file, else the name without its suffix."""
    found = F.regexp_extract(file, r"^[^-]*-(.+)\.jsonl$", 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(file, r"\.[^.]*$", ""))


def _is_raw(file: Column) -> Column:
    return file.endswith(".jsonl") & ~F.contains(file, F.lit(".sample"))


def raw_files(rows: DataFrame) -> DataFrame:
    """Rows of raw files only: JSON lines whose names hold no .sample."""
    return rows.filter(_is_raw(F.col("file")))


def append(df: DataFrame, path: str, check: bool = True) -> None:
    """Append rows as JSON lines with sorted keys, nulls left out; invalid articles are an error.

    Nothing is written if a row is invalid. Non-ASCII characters stay as they are.
    """
    failed = first_failures(df, "id").head(1) if check else []
    if failed:
        raise ValueError(f"a row breaks the article schema: {failed[0].field} ({failed[0].reason}) of {failed[0].id}")
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("append").text(path)
