"""Resumable ingest of article files into an archive table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archivolt.operators.archive import first_wins
from archivolt.operators.validation import ARTICLE, first_failures, valid


def ingest(spark: SparkSession, source: str, target: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """Take all new JSON files of ``source`` into ``target``, then end.

    Each micro-batch keeps valid articles, the first of each id by file and place in it, that
    the target does not hold; the others' first failures go to ``rejects``. Known ids are read from the target
    itself, so that a batch that is run again after a failure adds nothing twice and no
    state grows with the history. The checkpoint folder remembers which files were read.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_row", F.monotonically_increasing_id()).persist()
        failed = first_failures(batch, "id").withColumn("batch", F.lit(number))
        failed.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        rows = first_wins(valid(batch), "id", ["_file", "_block", "_row"]).select(*ARTICLE.names)
        try:
            known = spark.read.schema(ARTICLE).parquet(target).select("id")
            rows = rows.join(known, "id", "left_anti")
        except Exception as error:  # the target does not exist yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        rows.select(*ARTICLE.names).write.mode("append").parquet(target)
        batch.unpersist()

    where = F.col("_metadata")
    stream = spark.readStream.schema(ARTICLE).json(source)
    stream = stream.select("*", where["file_path"].alias("_file"), where["file_block_start"].alias("_block"))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
