"""Batched question answering: parsing, mention scan, fusion, context packing, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import normalize_mention

# Question words, and words that are never the verb of a question.
WH_WORDS = "what who where when which how whom whose".split()
VERB_STOPS = "the a an did do does was were is are has have had been be of in on at by to for with from".split()
# Phrases that mark a refusal.
REFUSAL_PHRASES = [
    "not in my knowledge base", "no context available", "none available", "no relevant information", "context does not contain",
    "context does not include", "does not contain this information", "not mentioned in", "not provided in", "cannot find", "not found in",
    "not stated in the source",
]


def _lits(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def parse_question(questions: DataFrame) -> DataFrame:
    """q_id, wh_type, verb: the first question word, and the first word of letters after one (anywhere, if there is none) that is
    neither a question word nor a stop word."""
    words = F.filter(F.split(F.lower("question"), r"[ \t\n\r]+"), lambda w: w != "")
    asks = F.transform(words, lambda w: F.regexp_replace(w, r"^[?]+|[?]+$", ""))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[?.,!;:]+|[?.,!;:]+$", ""))
    df = questions.select("q_id", asks.alias("a"), bare.alias("w"))
    known = ", ".join(map(repr, WH_WORDS))
    wh = F.get(F.filter("a", lambda w: w.isin(*WH_WORDS)), F.lit(0))
    at = F.expr(f"nvl(array_position(transform(w, x -> x in ({known})), true), 0)")
    df = df.select("q_id", wh.alias("wh_type"), "w", at.alias("at"))
    rest = F.when(F.col("wh_type").isNull(), F.col("w")).otherwise(F.expr("slice(w, cast(at as int) + 1, size(w))"))
    verbs = F.filter(rest, lambda x: x.rlike(r"^\p{L}+$") & ~F.array_contains(_lits(VERB_STOPS + WH_WORDS), x))
    return df.select("q_id", "wh_type", F.get(verbs, F.lit(0)).alias("verb"))


def _spans(questions: DataFrame) -> DataFrame:
    """q_id, tier, start, span: all runs of three, two and one words of a question."""
    words = F.filter(F.split(F.regexp_replace(F.lower("question"), r"[^\p{L}\p{N}_\s]", " "), r"[ \t\n\r]+"), lambda w: w != "")
    base = questions.select("q_id", words.alias("w"))
    spans = None
    for length in (3, 2, 1):
        part = base.filter(F.size("w") >= length).select(
            "q_id", F.lit(3 - length).alias("tier"),
            F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - (length - 1)), lambda i: F.concat_ws(" ", F.slice("w", i, length)))).alias("start", "span"),
        )
        spans = part if spans is None else spans.unionByName(part)
    return spans


def _first_hits(spans: DataFrame, aliases: DataFrame) -> DataFrame:
    one = aliases.groupBy("alias").agg(F.min("entity_id").alias("entity_id"))
    hits = spans.filter("alias <> ''").join(one, "alias").groupBy("q_id", "entity_id").agg(F.min(F.struct("tier", "start")).alias("at"))
    order = Window.partitionBy("q_id").orderBy("at", "entity_id")
    return hits.select("q_id", "entity_id", F.row_number().over(order).alias("position"))


def mention_scan(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """q_id, entity_id, position: entities whose alias a span of one to three words of the question equals.

    Longer spans come first, then from left to right; an alias of several entities means the least id.
    """
    return _first_hits(_spans(questions).withColumn("alias", normalize_mention(F.col("span"))), aliases)


def plain_mentions(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """mention_scan with spans as they stand: titles count, as they do in the aliases of propositions."""
    return _first_hits(_spans(questions).withColumnRenamed("span", "alias"), aliases)


def rrf(lists: DataFrame) -> DataFrame:
    """q_id, key, score, rank: reciprocal rank fusion of ranked lists (q_id, list_no, key, rank, k).

    Ties keep the order in which keys are first met, list by list.
    """
    fused = lists.groupBy("q_id", "key").agg(
        F.round(F.sum(1.0 / (F.col("k") + F.col("rank"))), 8).alias("score"), F.min(F.struct("list_no", "rank")).alias("first")
    )
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "first", "key")
    return fused.select("q_id", "key", "score", F.row_number().over(order).alias("rank"))


def pack(rows: DataFrame, size: str, budget: int, order: list) -> DataFrame:
    """Rows of each q_id in order, up to the first that would pass the budget; later rows never follow it."""
    w = Window.partitionBy("q_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.col(size)).over(w)).filter(F.col("used") <= budget)


def cited_tags(text: Column) -> Column:
    """Distinct citation tags in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\[[FCP][0-9]+\])"), F.lit(1)))


def strip_citations(text: Column, valid: Column) -> Column:
    """The text without the tags that the context doesn't hold."""
    return F.aggregate(F.array_except(cited_tags(text), valid), text, lambda s, tag: F.replace(s, tag, F.lit("")))


def is_refusal(text: Column) -> Column:
    found = F.lit(False)
    for phrase in REFUSAL_PHRASES:
        found = found | F.lower(text).contains(phrase)
    return found


def trim_history(turns: DataFrame, max_turns: int = 3, token_budget: int = 1024) -> DataFrame:
    """The last pairs of a conversation, oldest dropped until the rest fits (turns: conv_id, turn, role, content).

    Pairs are turns 2i and 2i + 1 of the conversation; a turn without its partner is dropped.
    """
    own = Window.partitionBy("conv_id").orderBy("turn")
    numbered = turns.withColumn("n", F.row_number().over(own) - 1).withColumn("pair", F.floor(F.col("n") / 2))
    pair = Window.partitionBy("conv_id", "pair")
    paired = numbered.withColumn("members", F.count("*").over(pair)).filter("members = 2")
    last = paired.withColumn("back", F.dense_rank().over(Window.partitionBy("conv_id").orderBy(F.desc("pair")))).filter(F.col("back") <= max_turns)
    chars = last.withColumn("chars", F.sum(F.length("content")).over(Window.partitionBy("conv_id").orderBy("back").rangeBetween(Window.unboundedPreceding, 0)))
    return chars.filter(F.col("chars") <= token_budget * 4).select("conv_id", "turn", "role", "content")
