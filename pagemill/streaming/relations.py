"""Relations as streams: any stateless operator runs on files as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagemill.session import shared_dir


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet relation (a file or a folder of files) as a stream, its schema taken from what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path + "*")


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is available now and give its output as a batch frame."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
