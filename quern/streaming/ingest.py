"""Streaming ingest that leaves each content once: a file stream, and tables that are their own state."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ingest import content_hash, first_by
from quern.runtime import checkpoint_dir


def ingest_available(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Read what a folder or file of documents (doc_id, text) holds as a stream and append new contents only.

    Every micro-batch is reduced to one row per hash, anti-joined with what is stored and appended;
    a batch that is delivered again finds its hashes stored.  The order in which batches come can
    choose which id stands for a content, so the least id of each is taken when reading.
    """
    root = folder or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out, state = f"{root}/documents", f"{root}/state"
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    single = path.endswith(".parquet") and not os.path.isdir(path.removeprefix("file://"))
    if single:  # a file stream reads folders: the file's folder, restricted to its name
        parent, _, name = path.rpartition("/")
        stream = source.option("pathGlobFilter", name).parquet(parent)
    else:
        stream = source.parquet(path)
    spark.createDataFrame([], "doc_id long, text string, sha256 string").write.mode("ignore").parquet(out)

    def append(batch: DataFrame, _: int) -> None:
        hashed = first_by(batch.filter("text is not null").withColumn("sha256", content_hash(F.col("text"))), ["sha256"], ["doc_id"])
        stored = spark.read.parquet(out).select("sha256", F.col("doc_id").alias("known"))
        fresh = hashed.join(stored, "sha256", "left").filter("known is null or doc_id < known").drop("known")
        fresh.select("doc_id", "text", "sha256").write.mode("append").parquet(out)

    q = stream.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
