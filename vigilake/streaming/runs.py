"""Running a stream to its end, and where its files go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="vigilake-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything a stream gives for what is there now. Append mode writes Parquet; complete mode keeps the last whole result."""
    spark = stream.sparkSession
    out, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def watch(spark: SparkSession, path: str, schema, form: str = "json", files: int | None = None) -> DataFrame:
    """A stream of the files that appear below path; its cursor is the query's checkpoint."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.format(form).load(path)
