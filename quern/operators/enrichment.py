"""Passes that let a model read chunks: prompts, parsing of what it says, and rows for the tables.

Each pass is a version of the chunk or of the knowledge base; a pass runs only where its version isn't reached.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import normalize_mention
from quern.operators import entities as ents
from quern.operators import facts as fx
from quern.operators.evaluation import fenced, parse_model_facts
from quern.operators.generation import generate
from quern.operators.propositions import PROPOSITION_TAXONOMY

TASKS = {
    "extraction": "List the facts that the text states as a JSON array of objects with subject, predicate, object, qualifiers, negated and sentence. Use only these predicates: {taxonomy}.",
    "entity": "List all facts about {entity} that the passages state, as a JSON array of objects with subject, predicate, object, qualifiers, negated and sentence. Use only these predicates: {taxonomy}.",
    "implied": "List facts that the text implies without naming them (trades shown by what is done, foreign or old words and their meaning, roles), as a JSON array of objects with subject, predicate, object and sentence. Use only these predicates: {taxonomy}.",
    "proposition": "List the events and relations of the text as a JSON array of objects with predicate, agent, themes, location, statement and evidence. A statement stands by itself. Use only these predicates: {taxonomy}.",
}
#: What a pass says of itself: version, confidence of its rows, and tokens of an answer.
VERSIONS = {"extraction": 1, "entity": 1, "implied": 1, "proposition": 1}
CONFIDENCE = {"extraction": 0.7, "entity": 0.75, "implied": 0.65, "proposition": 0.8}
PROPOSITIONS_A_CHUNK = 8


def task(kind: str) -> str:
    words = PROPOSITION_TAXONOMY if kind == "proposition" else fx.FACT_TAXONOMY
    return TASKS[kind].replace("{taxonomy}", ", ".join(words))


def known_names(entities: DataFrame, facts: DataFrame, limit: int = 25) -> DataFrame:
    """One row, names: the most frequent subjects whose name can stand in a prompt, joined by commas; null where there are none.

    Of the 2 * limit entities with most facts (the least id first among equals) those with a clean name, limit of them.
    """
    name = F.col("canonical_name")
    top = ents.degree(entities, facts).orderBy(F.desc("n"), "id").limit(2 * limit)
    clean = top.filter((F.length(name) <= 40) & (name != F.lower(name)) & ~name.contains("\n") & ~name.contains(",")).orderBy(F.desc("n"), "id").limit(limit)
    return clean.agg(F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "id", "canonical_name"))), lambda x: x["canonical_name"]), ", "), F.lit("")).alias("names"))


def known_line(names: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Known entities in this corpus (prefer these canonical names):\n"), names, F.lit("\n\n")), F.lit(""))


def prompts(kind: str, texts: DataFrame, names: DataFrame) -> DataFrame:
    """q_id, system, content, prefill of a pass (texts: q_id, text and, for the entity pass, entity; names: one row)."""
    rows = texts.join(F.broadcast(names))  # one row of at most 25 names
    lead = F.concat(F.lit("Text passages about "), "entity", F.lit(":\n")) if kind == "entity" else F.lit("Text:\n")
    system = F.replace(F.lit(task(kind)), F.lit("{entity}"), F.col("entity")) if kind == "entity" else F.lit(task(kind))
    return rows.select(
        F.col("q_id").cast("string").alias("q_id"), system.alias("system"), F.concat(known_line(F.col("names")), lead, "text").alias("content"), F.lit(None).cast("string").alias("prefill")
    )


PROPS = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("predicate", "agent")] + [T.StructField("themes", T.StringType())] + [T.StructField(n, T.StringType()) for n in ("location", "statement", "evidence")])
)


def parse_model_propositions(rows: DataFrame) -> DataFrame:
    """chunk_id, n, predicate, agent, themes, location, statement, evidence of a model's response (rows: chunk_id, response).

    Only an array counts; an item needs a predicate of the taxonomy (lower-cased), an agent and a statement; one theme
    may stand without its array; blank themes are dropped.
    """
    body = fenced(F.col("response"))
    items = F.when(body.startswith("["), F.from_json(body, PROPS))
    i = rows.select("chunk_id", F.posexplode(items).alias("n", "i"))
    listed = F.col("i.themes").startswith("[")
    themes = F.when(listed, F.from_json("i.themes", T.ArrayType(T.StringType()))).otherwise(F.array("i.themes"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return i.select(
        "chunk_id", "n", F.lower(F.trim("i.predicate")).alias("predicate"), F.trim("i.agent").alias("agent"),
        F.coalesce(F.filter(F.transform(themes, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>")).alias("themes"),
        blank(F.col("i.location")).alias("location"), F.trim("i.statement").alias("statement"), blank(F.col("i.evidence")).alias("evidence"),
    ).filter(F.col("predicate").isin(PROPOSITION_TAXONOMY) & (F.col("agent") != "") & (F.col("statement") != ""))


def entity_id_of(name: Column) -> Column:
    """The id of a new entity: a hash of its normalised name, so that equal names meet without a counter."""
    return F.abs(F.xxhash64(normalize_mention(name)))


def resolved(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, entity_id, is_new: the entity of the least id whose alias a name's normalised form equals, else a new one (names: name)."""
    one = aliases.groupBy(F.col("alias").alias("mention")).agg(F.min("entity_id").alias("known"))
    rows = names.filter("name is not null").distinct().withColumn("mention", normalize_mention(F.col("name"))).filter("mention <> ''")
    return rows.join(one, "mention", "left").select("name", F.coalesce("known", entity_id_of(F.col("name"))).alias("entity_id"), F.col("known").isNull().alias("is_new"))


def fact_rows(parsed: DataFrame, texts: DataFrame, aliases: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(facts, new entities: id, canonical_name) from parsed model facts (chunk_id, n, subject, predicate, object, negated, sentence, qualifiers).

    An object that begins with a capital is an entity.  A fact without its sentence takes the chunk's first 300 characters
    in the extraction pass, none in the others.
    """
    capital = F.substring("object", 1, 1)
    rows = parsed.withColumn("named", F.when((capital != F.lower(capital)) & (F.col("object") != ""), F.col("object")))
    names = resolved(rows.select(F.col("subject").alias("name")).union(rows.select("named")), aliases)
    of = lambda c: names.select(F.col("name").alias(c), F.col("entity_id").alias(f"{c}_id"))
    start = texts.select("chunk_id", F.substring("text", 1, 300).alias("start")) if kind == "extraction" else texts.select("chunk_id", F.lit("").alias("start"))
    joined = rows.join(of("subject"), "subject").join(of("named"), "named", "left").join(start.distinct(), "chunk_id")
    text = F.when(F.col("named_id").isNull(), F.nullif("object", F.lit("")))
    made = joined.select(
        F.abs(F.xxhash64("chunk_id", "subject_id", "predicate", text, "named_id", "qualifiers")).alias("id"), "chunk_id", "subject_id",
        F.coalesce(F.nullif("sentence", F.lit("")), "start").alias("sentence"), "predicate", F.col("named_id").alias("object_id"), text.alias("object_text"),
        "qualifiers", "negated", F.lit(CONFIDENCE[kind]).alias("confidence"), F.lit("llm").alias("source"),
    )
    fresh = names.filter("is_new").groupBy(F.col("entity_id").alias("id")).agg(F.min("name").alias("canonical_name"))
    return fx.dedup_facts(made), fresh


def read_facts(kind: str, texts: DataFrame, names: DataFrame, generator: Callable[[list[dict]], str]) -> DataFrame:
    """chunk_id and the parsed facts of a pass over texts (chunk_id, text and, for the entity pass, entity); failing calls give none."""
    asked = prompts(kind, texts.withColumn("q_id", F.col("chunk_id")), names)
    said = generate(asked, generator).filter("answer is not null")
    return parse_model_facts(said.select(F.col("q_id").cast("long").alias("chunk_id"), F.col("answer").alias("response")), fx.FACT_TAXONOMY)


def read_propositions(texts: DataFrame, names: DataFrame, generator: Callable[[list[dict]], str]) -> DataFrame:
    """The parsed propositions of every chunk (chunk_id, text), the first eight of each."""
    asked = prompts("proposition", texts.withColumn("q_id", F.col("chunk_id")), names)
    said = generate(asked, generator).filter("answer is not null")
    return parse_model_propositions(said.select(F.col("q_id").cast("long").alias("chunk_id"), F.col("answer").alias("response"))).filter(F.col("n") < PROPOSITIONS_A_CHUNK)


def proposition_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(propositions, bridge rows, entities) of parsed propositions: the first of each chunk, predicate and statement.

    Entities are found or made by their canonical name; a location is of kind LOCATION, all others PERSON.
    """
    from quern.operators.ingest import first_by

    once = first_by(parsed, ["chunk_id", "predicate", "statement"], ["n"])
    key = lambda c: F.abs(F.xxhash64(c))
    own = once.withColumn("prop_id", F.abs(F.xxhash64("chunk_id", "predicate", "statement")))
    propositions = own.select(
        "prop_id", "chunk_id", "predicate", key(F.col("agent")).alias("agent"), F.transform("themes", lambda t: F.abs(F.xxhash64(t))).alias("theme"),
        F.when(F.col("location").isNotNull(), key(F.col("location"))).alias("location"), F.lit("positive").alias("polarity"), F.lit(CONFIDENCE["proposition"]).alias("confidence"), "statement", "evidence",
    )
    parts = own.select("prop_id", F.explode(F.concat(
        F.array(F.struct(F.col("agent").alias("name"), F.lit("agent").alias("role"))),
        F.transform("themes", lambda t: F.struct(t.alias("name"), F.lit("theme").alias("role"))),
        F.array(F.struct(F.col("location").alias("name"), F.lit("location").alias("role"))),
    )).alias("x")).select("prop_id", "x.name", "x.role").filter("name is not null")
    bridge = parts.select("prop_id", key(F.col("name")).alias("entity_id"), "role").distinct()
    kinds = parts.groupBy("name").agg(F.min(F.when(F.col("role") == "location", "LOCATION").otherwise("PERSON")).alias("kind"))
    return propositions, bridge, kinds.select(key(F.col("name")).alias("id"), F.col("name").alias("canonical_name"), "kind")
