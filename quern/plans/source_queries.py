"""Queries of readers and writers: each writes files into the shared folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.runtime import checkpoint_dir
from quern.runtime import read_table as read
from quern.sources import packs, readers


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT id, sha256(coalesce(title, '') || chr(10)) AS sha256, NULL::VARCHAR AS error FROM sources")
def read_documents(spark, d):
    """Every title as a text file of its own, read back as a document."""
    folder = _folder(spark, "documents")
    read(spark, d, "sources").select("id", F.coalesce("title", F.lit("")).alias("value")).write.partitionBy("id").text(folder)
    got = readers.read_documents(spark, folder).filter(F.col("path").contains("/id="))
    return got.select(F.regexp_extract("path", r"/id=(-?\d+)/", 1).cast("long").alias("id"), F.sha2("text", 256).alias("sha256"), "error")


@query("SELECT id, sha256(regexp_replace(text, '^[ \\t\\n\\r]+', '') || ' end') AS sha256 FROM chunks WHERE text IS NOT NULL")
def strip_html(spark, d):
    """Every chunk as markup, its marks written as character references, stripped again."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = read(spark, d, "chunks").filter("text is not null").select("id", F.concat(F.lit("<html><p class='x'>"), safe, F.lit("</p><b>end</b></html>")).alias("markup"))
    return readers.stripped(rows, "id", "markup").select("id", F.sha2("text", 256).alias("sha256"))


@query("SELECT DISTINCT q_id AS id, coalesce(q_type, 'fact') AS type, question, coalesce(answerable, true) AS answerable, 0 AS n_keywords FROM question_results WHERE question IS NOT NULL")
def qna_load(spark, d):
    """The questions of the runs written as JSON arrays, a few in each file, and loaded with their defaults."""
    folder = _folder(spark, "qna")
    r = read(spark, d, "question_results").filter("question is not null").select(F.col("q_id").alias("id"), F.col("q_type").alias("type"), "question", "answerable").distinct()
    parts = r.groupBy(F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(F.to_json(F.collect_list(F.struct("id", "type", "question", "answerable"))).alias("value"))
    parts.select("value").repartition(64).write.text(folder)
    return readers.read_qna(spark, folder).select("id", "type", "question", "answerable", F.size("expected_keywords").alias("n_keywords")).distinct()


@query(
    "SELECT 'sources' AS name, count(*) AS n FROM sources UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'aliases', count(*) FROM aliases "
    "UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'vec_chunks', count(*) FROM vec_chunks UNION ALL SELECT 'vec_entities', count(*) FROM vec_entities"
)
def pack_export_counts(spark, d):
    tables = {t: read(spark, d, t) for t in ("sources", "chunks", "entities", "aliases", "facts", "vec_chunks", "vec_entities")}
    folder = _folder(spark, "pack")
    counts = packs.export_pack(tables, folder)
    opened = packs.open_pack(spark, folder)
    if {n: df.count() for n, df in opened.items()} != counts:
        raise RuntimeError("a pack does not hold what was exported")
    return spark.createDataFrame(list(counts.items()), "name string, n long")


@query("SELECT q_id, run_index, judge_score, round(peak_rss_mb, 6) AS peak_rss_mb FROM question_results")
def run_log_read(spark, d):
    """A run log of all results, with a blank and a broken line, read back by type."""
    folder = _folder(spark, "log")
    results = read(spark, d, "question_results").select("q_id", "run_index", "judge_score", "peak_rss_mb")
    readers.write_run_log({"k": 12}, results, results.agg(F.count("*").alias("n")), folder)
    spark.createDataFrame([("",), ("{broken",), ('{"type": "other"}',)], "value string").write.mode("append").text(folder)
    got = readers.read_run_log(spark, folder, "result", "q_id string, run_index long, judge_score int, peak_rss_mb double")
    return got.select("q_id", F.col("run_index").cast(dict(results.dtypes)["run_index"]).alias("run_index"), "judge_score", F.round("peak_rss_mb", 6).alias("peak_rss_mb"))


@query("SELECT event, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT CASE WHEN text = '' THEN 'empty' ELSE 'document' END AS event, n_chars FROM documents WHERE text IS NOT NULL) GROUP BY event")
def event_sink(spark, d):
    """One JSON object per document appended to an event log in two goes, read back and counted."""
    folder = _folder(spark, "events")
    docs = read(spark, d, "documents").filter("text is not null").select(F.when(F.col("text") == "", "empty").otherwise("document").alias("event"), "n_chars")
    for event in ("empty", "document"):
        readers.append_events(docs.filter(F.col("event") == event), folder)
    return spark.read.schema("event string, n_chars long").json(folder).groupBy("event").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query()
def kb_size(spark, d):
    """Bytes and files of every table."""
    names = ("sources", "chunks", "entities", "aliases", "facts", "vec_chunks", "vec_entities")
    return spark.createDataFrame([(n, *packs.size_on_disk(spark, f"{d}/{n}.parquet")) for n in names], "name string, bytes long, files long")


@query("SELECT id, coalesce(json_extract_string(meta, '$.lang'), '') AS lang FROM sources")
def source_meta(spark, d):
    """One entry of every source's metadata, from pairs name=value as commands take them."""
    rows = read(spark, d, "sources").select("id", F.concat(F.lit("lang='"), F.coalesce(F.get_json_object("meta", "$.lang"), F.lit("")), F.lit("',kind=book")).alias("pairs"))
    return rows.select("id", readers.parse_meta(F.col("pairs"))["lang"].alias("lang"))


