"""Evaluation of runs: aggregates, comparison, judge output, mechanical scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import map_batches
from quern.operators.retrieval import cited_tags, is_refusal


def run_aggregate(results: DataFrame) -> DataFrame:
    """One row of a run: means over the first run of each question (all runs, where there is no first), conditional on answerable
    where that matters; a missing time counts as 0."""
    some = results.agg(F.coalesce(F.max(F.col("run_index") == 0), F.lit(False)).alias("any_first"))
    first = results.join(F.broadcast(some)).filter("run_index = 0 or not any_first")  # one row
    ok = F.col("answerable")
    m = "mechanical."

    def mean_if(cond, col):
        return F.coalesce(F.avg(F.when(cond, F.col(col).cast("double"))), F.lit(0.0))

    aggs = [
        F.countDistinct("q_id").alias("n_questions"),
        F.coalesce(F.avg(m + "keyword_recall"), F.lit(0.0)).alias("mean_keyword_recall"),
        F.coalesce(F.avg(m + "fact_hit_rate"), F.lit(0.0)).alias("mean_fact_hit_rate"),
        F.coalesce(F.avg(m + "retrieval_hit_rate"), F.lit(0.0)).alias("mean_retrieval_hit_rate"),
        mean_if(ok, m + "citation_present").alias("citation_present_rate"),
        mean_if(ok, m + "citation_valid").alias("citation_valid_rate"),
        F.sum(F.when(F.col(m + "hallucination"), 1).otherwise(0)).cast("long").alias("hallucination_count"),
        F.coalesce(F.avg(F.coalesce(F.col("timings")["gen_ms"], F.lit(0.0))), F.lit(0.0)).alias("mean_gen_ms"),
        F.coalesce(F.avg(F.coalesce(F.col("timings")["fact_ms"], F.lit(0.0))), F.lit(0.0)).alias("mean_fact_ms"),
        F.coalesce(F.avg("peak_rss_mb"), F.lit(0.0)).alias("mean_peak_rss_mb"),
        F.avg("judge_score").alias("mean_judge_score"),
        F.median("judge_score").alias("median_judge_score"),
        *[F.avg(F.when(F.col("q_type") == t, F.col("judge_score"))).alias(f"mean_judge_{t}") for t in ("fact", "paraphrase", "multi_hop", "negative")],
    ]
    out = first.agg(*aggs)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


def compare_runs(a: DataFrame, b: DataFrame, lower_is_better: list[str]) -> DataFrame:
    """metric, before, after, delta, verdict of two runs (metric, value); a metric of only one run has no verdict."""
    j = a.select("metric", F.col("value").alias("before")).join(b.select("metric", F.col("value").alias("after")), "metric", "full")
    delta = F.round(F.col("after") - F.col("before"), 6)
    sign = F.when(F.col("metric").isin(lower_is_better), -1).otherwise(1)
    verdict = F.when(delta.isNull(), None).when(delta == 0, "equal").when(delta * sign > 0, "better").otherwise("regress")
    return j.select("metric", "before", "after", delta.alias("delta"), verdict.alias("verdict"))


def score_answers(rows: DataFrame) -> DataFrame:
    """q_id, run_index and the six offline scores of every answer.

    rows: q_id, run_index, answer, answerable, keywords (expected), valid_tags, expected_facts (subject, predicate),
    fact_hits (subject, predicate), expected_sources, chunk_sources.  What isn't expected counts as found; answerable null is true.
    """
    answer = F.lower(F.coalesce("answer", F.lit("")))
    tags = cited_tags(F.coalesce("answer", F.lit("")))
    held = lambda found, n: F.round(F.when(F.coalesce(F.size(n), F.lit(0)) > 0, F.size(found) / F.size(n)).otherwise(1.0), 6)
    words = F.filter("keywords", lambda k: F.contains(answer, F.lower(k)))
    facts = F.filter("expected_facts", lambda e: F.exists("fact_hits", lambda h: F.contains(F.lower(h["subject"]), F.lower(e["subject"])) & (F.lower(h["predicate"]) == F.lower(e["predicate"]))))
    places = F.filter("expected_sources", lambda e: F.exists("chunk_sources", lambda c: F.contains(F.lower(c), F.lower(e))))
    return rows.select(
        "q_id", "run_index", (F.size(tags) > 0).alias("citation_present"), (F.size(F.array_except(tags, "valid_tags")) == 0).alias("citation_valid"),
        held(words, F.col("keywords")).alias("keyword_recall"), held(facts, F.col("expected_facts")).alias("fact_hit_rate"),
        held(places, F.col("expected_sources")).alias("retrieval_hit_rate"),
        (~F.coalesce("answerable", F.lit(True)) & ~is_refusal(F.coalesce("answer", F.lit("")))).alias("hallucination"),
    )


def fenced(text: Column) -> Column:
    """What stands inside a code fence, if there is one, trimmed."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.trim(F.regexp_replace(F.when(text.contains("```"), inside).otherwise(text), r"^\s+|\s+$", ""))


JUDGE = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("reason", T.StringType())]))


def parse_judge(rows: DataFrame) -> DataFrame:
    """batch_id, id, score, reason: items of a judge's response; nothing unless it is an array whose usable items have exactly the ids asked.

    rows: batch_id, response, asked (ids).  A code fence is stripped; items without an id or a number as score are
    passed over; scores are clamped to 0-100.
    """
    body = fenced(F.col("response"))
    items = F.filter(F.when(body.startswith("["), F.from_json(body, JUDGE)), lambda i: i["id"].isNotNull() & i["score"].isNotNull())
    df = rows.select("batch_id", "asked", items.alias("items"))
    same = F.array_sort(F.array_distinct(F.transform("items", lambda i: i["id"]))) == F.array_sort(F.array_distinct("asked"))
    return df.filter(same).select("batch_id", F.explode("items").alias("i")).select(
        "batch_id", F.col("i.id").alias("id"), F.least(F.lit(100), F.greatest(F.lit(0), F.col("i.score").cast("int"))).alias("score"),
        F.coalesce("i.reason", F.lit("")).alias("reason"),
    )


RUBRIC = "You grade answers of a question-answering system from 0 (wrong or unfounded) to 100 (right, whole and cited). A refusal of a question that can't be answered is right."


def judge_prompts(results: DataFrame, max_chars: int = 12_000) -> DataFrame:
    """batch_id, asked, prompt: the first run of every question in greedy batches of bounded length, in the order of their ids.

    results: q_id, q_type, question, answerable, answer, citations, run_index and, where known, expected_answer.
    The bins are cut within 64 parts by the hash of the question, so no task holds all questions.
    """
    known = "expected_answer" in results.columns
    first = results.filter("run_index = 0").dropDuplicates(["q_id"])
    fields = [F.col("q_id").alias("id"), F.col("q_type").alias("type"), "question", "answerable", F.col("answer").alias("system_answer"), F.col("citations").alias("citations_used")]
    item = F.to_json(F.struct(*fields, *(["expected_answer"] if known else [])))
    rows = first.select("q_id", item.alias("item"), F.pmod(F.xxhash64("q_id"), F.lit(64)).alias("part"))
    parts = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("q_id", "item"))).alias("l"))
    binned = split_bins(parts.select(F.col("part").alias("batch_id"), F.transform("l", lambda x: F.length(x["item"]).cast("long") + 2).alias("sizes")), max_chars - len(RUBRIC) - 200)
    one = parts.join(binned.withColumnRenamed("batch_id", "part"), "part").select("part", F.explode(F.arrays_zip("l", "bins")).alias("z"))
    g = one.groupBy("part", F.col("z.bins").alias("bin")).agg(F.sort_array(F.collect_list("z.l")).alias("l"))
    payload = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["item"]), ",\n"), F.lit("]"))
    ask = RUBRIC + '\n\nReply only with a JSON array: [{"id":"...","score":0-100,"reason":"one sentence"}]\n\n'
    return g.select(F.concat_ws("/", "part", "bin").alias("batch_id"), F.transform("l", lambda x: x["q_id"]).alias("asked"), F.concat(F.lit(ask), payload).alias("prompt"))


def run_judge(results: DataFrame, judge: Callable[[str], str] | None, max_chars: int = 12_000, tries: int = 2) -> DataFrame:
    """id, score, reason of every question from a judge (a function from a prompt to a response), asked again once where the response
    can't be used; no rows without a judge."""
    made = judge_prompts(results, max_chars)
    if judge is None:
        return results.sparkSession.createDataFrame([], "id string, score int, reason string")
    schema = T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("t", T.IntegerType()), T.StructField("response", T.StringType())])

    def call(batch):
        out = {"batch_id": [], "t": [], "response": []}
        for batch_id, asked, prompt in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for t in range(tries):
                try:
                    text = judge(prompt)
                except Exception:
                    continue
                for key, value in zip(out, (batch_id, t, text)):
                    out[key].append(value)
                if all(i in text for i in asked):
                    break
        return out if out["t"] else None

    said = map_batches(made.select("batch_id", "asked", "prompt"), schema, call).join(made.select("batch_id", "asked"), "batch_id")
    keyed = said.select(F.struct("batch_id", "t").alias("batch_id"), "response", "asked")
    good = parse_judge(keyed)
    first = good.groupBy(F.col("batch_id.batch_id").alias("b")).agg(F.min("batch_id.t").alias("t"))
    return good.join(first, (F.col("batch_id.batch_id") == F.col("b")) & (F.col("batch_id.t") == F.col("t"))).select("id", "score", "reason")


def judge_command(command: str, timeout: int = 300) -> Callable[[str], str] | None:
    """A judge that is a command reading its prompt from standard input; none where the program doesn't exist."""
    import shlex
    import shutil
    import subprocess

    parts = shlex.split(command)
    if not parts or not shutil.which(parts[0]):
        return None
    return lambda prompt: subprocess.run(parts, input=prompt, capture_output=True, text=True, timeout=timeout).stdout


def report(aggregate: dict, width: int = 28) -> str:
    """A table of one run's figures as fixed-width text."""
    rows = [f"{k:<{width}}{v:>12.3f}" if isinstance(v, float) else f"{k:<{width}}{v!s:>12}" for k, v in aggregate.items() if v is not None]
    return "\n".join(["-" * (width + 12), *rows, "-" * (width + 12)])


def changed_settings(a: dict, b: dict) -> dict[str, tuple]:
    """Settings that differ between two runs, one of which may lack them: name to (before, after)."""
    return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)}


class Measure:
    """Wall time, CPU time, peak memory and swap of a block on the driver; written to a log of JSON lines even if it fails."""

    def __init__(self, label: str, log: str | None = None):
        self.label, self.log, self.result = label, log, {}

    def __enter__(self):
        import resource
        import time

        self._start = (time.perf_counter(), time.process_time(), self._swap())
        self._rss = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        return self

    @staticmethod
    def _swap() -> float:
        try:
            with open("/proc/meminfo", encoding="ascii") as f:
                kb = {k: int(v.split()[0]) for k, v in (line.split(":") for line in f if ":" in line)}
            return (kb["SwapTotal"] - kb["SwapFree"]) / 1024
        except (OSError, KeyError):
            return 0.0

    def __exit__(self, kind, value, trace):
        import json
        import resource
        import time

        wall, cpu, swap = self._start
        self.result = {
            "label": self.label, "wall_s": time.perf_counter() - wall, "cpu_s": time.process_time() - cpu,
            "peak_rss_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, "swap_delta_mb": self._swap() - swap, "error": kind.__name__ if kind else None,
        }
        if self.log:
            with open(self.log, "a", encoding="utf-8") as f:
                f.write(json.dumps(self.result) + "\n")
        return False


FACTS = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("subject", "predicate", "object", "sentence", "qualifiers")] + [T.StructField("negated", T.BooleanType())])
)


def parse_model_facts(rows: DataFrame, taxonomy: list[str]) -> DataFrame:
    """chunk_id, n, subject, predicate, object, negated, sentence, qualifiers of a model's response (rows: chunk_id, response).

    Only an array counts; items need a subject and a predicate of the taxonomy (lower-cased); qualifiers count as an object only.
    """
    body = fenced(F.col("response"))
    items = F.when(body.startswith("["), F.from_json(body, FACTS))
    return (
        rows.select("chunk_id", F.posexplode(items).alias("n", "i"))
        .select(
            "chunk_id", "n", F.trim("i.subject").alias("subject"), F.lower(F.trim("i.predicate")).alias("predicate"), F.trim("i.object").alias("object"), F.coalesce("i.negated", F.lit(False)).alias("negated"),
            F.trim("i.sentence").alias("sentence"), F.when(F.col("i.qualifiers").startswith("{"), F.col("i.qualifiers")).alias("qualifiers"),
        )
        .filter(F.col("predicate").isin(taxonomy) & (F.col("subject") != ""))
    )


def split_bins(sizes: DataFrame, limit: int) -> DataFrame:
    """batch_id, bins: greedy bins of an ordered array of sizes, each at most limit (a larger item is alone)."""
    state = "struct<bin:int,used:bigint,out:array<int>>"
    start = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out")).cast(state)

    def step(acc, n):
        over = (acc["used"] + n > limit) & (acc["used"] > 0)
        b = F.when(over, acc["bin"] + 1).otherwise(acc["bin"])
        return F.struct(b.alias("bin"), F.when(over, n).otherwise(acc["used"] + n).cast("long").alias("used"), F.concat(acc["out"], F.array(b)).alias("out")).cast(state)

    return sizes.select("batch_id", F.aggregate("sizes", start, step, lambda acc: acc["out"]).alias("bins"))


# How a fact of this predicate is asked for; X stands for its subject.
TEMPLATES = {
    "take": "What did X take?", "observe": "What did X observe?", "enter": "Where did X enter?", "be": "What was X?", "possess": "What did X possess?",
    "say": "What did X say?", "find": "What did X find?", "give": "What did X give?", "see": "What did X see?", "know": "What did X know?",
}


def question_of(subject: Column, predicate: Column) -> Column:
    """The question that a fact answers, by its predicate."""
    text = F.concat(F.lit("What did "), subject, F.lit(" "), predicate, F.lit("?"))
    for name, template in TEMPLATES.items():
        before, after = template.split("X")
        text = F.when(predicate == name, F.concat(F.lit(before), subject, F.lit(after))).otherwise(text)
    return text


def skeleton(facts: DataFrame, entities: DataFrame, chunks: DataFrame, sources: DataFrame, source: str, limit: int, seed: int) -> DataFrame:
    """item, question, keyword, subject, predicate, source: `limit` draft questions from facts of confidence 0.8 or more in the sources whose title
    or path holds `source`, in the order of a seeded hash."""
    from quern.functions.text import source_info

    places = sources.filter(F.col("title").ilike(f"%{source}%") | F.col("path").ilike(f"%{source}%")).select(F.col("id").alias("source_id"), "title", "path")
    own = chunks.select(F.col("id").alias("chunk_id"), "source_id").join(places, "source_id")
    rows = facts.filter("confidence >= 0.8").join(own, "chunk_id").join(entities.select(F.col("id").alias("subject_id"), "canonical_name"), "subject_id")
    order = F.md5(F.concat(F.col("id").cast("string"), F.lit(f"#{seed}")))
    top = rows.withColumn("o", order).orderBy("o", "id").limit(limit)
    n = F.row_number().over(Window.orderBy("o", "id"))  # over at most `limit` rows
    return top.select(
        F.concat(F.lit("q"), F.lpad(n.cast("string"), 3, "0")).alias("item"), question_of(F.col("canonical_name"), F.col("predicate")).alias("question"),
        F.coalesce("object_text", F.lit("")).alias("keyword"), F.lower("canonical_name").alias("subject"), "predicate", source_info(F.col("title"), F.col("path")).alias("source"),
    )
