"""Packs: portable corpora as folders of Parquet tables, attached side by side."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("sources", "chunks", "entities", "aliases", "facts")
TABLES = (*REQUIRED, "predicate_synonyms", "pending_links", "propositions", "proposition_entities", "vec_chunks", "vec_entities", "vec_facts", "vec_propositions", "db_meta")


def attach(corpora: list[tuple[str, DataFrame]]) -> DataFrame:
    """One table of several corpora, with the columns corpus and corpus_ord; ids are keyed by (corpus, id)."""
    parts = [df.withColumn("corpus", F.lit(name)).withColumn("corpus_ord", F.lit(i)) for i, (name, df) in enumerate(corpora)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def export_pack(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Write each table as Parquet, replacing what is there; the counts are observed during the write."""
    from pyspark.sql import Observation

    counts = {}
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"not a table of a pack: {name}")
        seen = Observation(name)
        df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        counts[name] = seen.get["n"]
    return counts


def missing_tables(spark: SparkSession, folder: str) -> list[str]:
    """The required tables that a folder lacks."""
    lacking = []
    for name in REQUIRED:
        try:
            spark.read.parquet(f"{folder}/{name}.parquet").schema  # noqa: B018
        except Exception:
            lacking.append(name)
    return lacking


def open_pack(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    lacking = missing_tables(spark, folder)
    if lacking:
        raise ValueError(f"not a pack, lacks: {', '.join(lacking)}")
    found = {}
    for name in TABLES:
        try:
            found[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        except Exception:
            continue
    return found


def size_on_disk(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and number of files below a path of any file system that Spark reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    summary = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where)
    return summary.getLength(), summary.getFileCount()


def read_registry(path: str) -> list[dict]:
    """The registered packs (name, path); none where the file doesn't exist."""
    file = Path(path)
    return json.loads(file.read_text()) if file.exists() else []


def register(path: str, name: str, folder: str) -> None:
    rows = [r for r in read_registry(path) if r["name"] != name] + [{"name": name, "path": folder}]
    Path(path).write_text(json.dumps(rows, indent=2))


def unregister(path: str, name: str) -> bool:
    rows = read_registry(path)
    kept = [r for r in rows if r["name"] != name]
    if len(kept) < len(rows):
        Path(path).write_text(json.dumps(kept, indent=2))
    return len(kept) < len(rows)
