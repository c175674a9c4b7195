"""Readers of documents, question files and run logs."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import map_batches

_READ = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data):
        self.parts.append(data)


def strip_html(markup: str | None) -> str | None:
    """Every text node, character references resolved, joined by blanks; null stays null."""
    if markup is None:
        return None
    p = _Text()
    p.feed(markup)
    p.close()
    return " ".join(p.parts).strip()


def _pdf(data: bytes) -> str:
    import io

    from pypdf import PdfReader  # optional

    return "\n\n".join(t for t in ((page.extract_text() or "").strip() for page in PdfReader(io.BytesIO(data)).pages) if t)


def _epub(data: bytes) -> str:
    """The HTML items of the archive in the order of its spine (of their names, where it has none), stripped; no further package is needed."""
    import io
    import posixpath
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        held = set(z.namelist())
        names = sorted(n for n in held if n.lower().endswith((".html", ".xhtml", ".htm")))
        book = next((n for n in sorted(held) if n.lower().endswith(".opf")), None)
        if book:
            root = ElementTree.fromstring(z.read(book))
            local = lambda e: e.tag.rsplit("}", 1)[-1]
            items = {e.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(book), e.get("href", ""))) for e in root.iter() if local(e) == "item"}
            spine = [items.get(e.get("idref")) for e in root.iter() if local(e) == "itemref"]
            ordered = [n for n in spine if n in held]
            names = ordered + [n for n in names if n not in ordered]
        return "\n\n".join(t for t in (strip_html(z.read(n).decode("utf-8", "replace")) for n in names) if t)


def stripped(df: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    """id, text: the text of every page of markup."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(markup_col).cast("string")), schema, lambda b: {"id": b.column(0), "text": [strip_html(m) for m in b.column(1).to_pylist()]})


def append_events(events: DataFrame, path: str) -> None:
    """Append one JSON object per row to an event log."""
    events.write.mode("append").json(path)


def parse_meta(pairs: Column) -> Column:
    """A map of comma-separated name=value pairs; quotes around a value are dropped."""
    bare = F.str_to_map(pairs, F.lit(","), F.lit("="))
    return F.transform_values(bare, lambda k, v: F.regexp_replace(F.trim(v), "^[\"']|[\"']$", ""))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of every file below a path: txt and md (bad bytes become U+FFFD), html, pdf, epub.

    Another suffix, or a file that can't be read, gives a row with its error and a null text.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def read(batch):
        out = {"path": [], "text": [], "error": []}
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            suffix = name.rsplit(".", 1)[-1].lower()
            text = error = None
            try:
                if suffix in ("txt", "md"):
                    text = data.decode("utf-8", "replace")
                elif suffix in ("html", "htm"):
                    text = strip_html(data.decode("utf-8", "replace"))
                elif suffix == "pdf":
                    text = _pdf(data)
                elif suffix == "epub":
                    text = _epub(data)
                else:
                    error = f"no reader for .{suffix}"
            except Exception as e:  # one bad file must not end the job
                error = f"{type(e).__name__}: {e}"
            for key, value in zip(out, (name, text, error)):
                out[key].append(value)
        return out

    return map_batches(raw, _READ, read)


QNA = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("question", T.StringType()),
        T.StructField("expected_keywords", T.ArrayType(T.StringType())), T.StructField("expected_sources", T.ArrayType(T.StringType())),
        T.StructField("expected_facts", T.ArrayType(T.StructType([T.StructField("subject", T.StringType()), T.StructField("predicate", T.StringType())]))),
        T.StructField("answerable", T.BooleanType()), T.StructField("expected_answer", T.StringType()), T.StructField("book", T.StringType()),
    ]
)


def read_qna(spark: SparkSession, path: str) -> DataFrame:
    """Questions with what is expected of their answers; missing lists are empty, answerable is true unless said otherwise."""
    df = spark.read.schema(QNA).json(path, multiLine=True)
    lists = {c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in ("expected_keywords", "expected_sources", "expected_facts")}
    return df.withColumns(lists | {"answerable": F.coalesce("answerable", F.lit(True)), "expected_answer": F.coalesce("expected_answer", F.lit("")), "type": F.coalesce("type", F.lit("fact"))})


def write_run_log(config: dict, results: DataFrame, aggregate: DataFrame, path: str) -> None:
    """One JSON object per line, told apart by its type: config, result, aggregate."""
    spark = results.sparkSession
    import json

    head = spark.createDataFrame([(json.dumps({"type": "config", "config": config}),)], "value string")

    def lines(df, kind):
        return df.select(F.to_json(F.struct(F.lit(kind).alias("type"), *df.columns)).alias("value"))

    head.unionByName(lines(results, "result")).unionByName(lines(aggregate, "aggregate")).write.mode("overwrite").text(path)


def read_run_log(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The rows of one type of a run log; blank and broken lines are skipped. schema: fields besides type."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"type string, {schema}").alias("r"))
    return parsed.filter(F.col("r.type") == kind).select("r.*").drop("type")
