"""Files as they arrive: the scan and the per-file steps are stateless, so a stream of files is
read with the same code. Document-wide results are made per micro-batch in ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.api import to_markdown
from pagemill.options import MarkdownOptions
from pagemill.sources.pdf import scan

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as a stream; a file that is rewritten under its name comes once a day."""
    files = spark.readStream.format("binaryFile").schema(BINARY).load(path)
    return files.withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["path"])


def scan_stream(spark: SparkSession, path: str) -> DataFrame:
    """Pages of arriving files, one row a page."""
    return scan(read_stream(spark, path))


def convert_stream(spark: SparkSession, source: str, target: str, checkpoint: str, options: MarkdownOptions | None = None) -> StreamingQuery:
    """Convert what is there and what arrives until stopped; Markdown goes to Parquet, one folder
    a batch, written over when a batch is repeated."""

    def put(batch: DataFrame, number: int) -> None:
        to_markdown(batch.select("path", "content"), options).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return read_stream(spark, source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
