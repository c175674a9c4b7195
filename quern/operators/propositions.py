"""Propositions (n-ary facts): entities and their aliases, roles, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import normalize_mention

# Predicates that minted propositions may bear.
PROPOSITION_TAXONOMY = (
    "introduce reside_at work_as murder possess relationship_to leader_of call be means located_at travel_to find use married_to "
    "killed_by employed_by"
).split()
# Predicates that answer a question with this verb, besides the verb itself.
VERB_PREDICATES = {
    "profession": "work_as", "occupation": "work_as", "job": "work_as", "work": "work_as employed_by", "employ": "employed_by work_as",
    "live": "reside_at located_at", "reside": "reside_at", "stay": "reside_at", "locate": "located_at", "meet": "introduce",
    "introduce": "introduce", "kill": "murder killed_by", "die": "killed_by murder", "murder": "murder kill killed_by", "possess": "possess",
    "own": "possess", "call": "call", "name": "call named_after", "mean": "means", "travel": "travel_to", "go": "travel_to", "find": "find",
    "marry": "married_to", "lead": "leader_of", "command": "leader_of", "use": "use",
}
# Predicates that answer a question with this noun.
NOUN_PREDICATES = {
    "profession": "work_as", "occupation": "work_as", "job": "work_as", "career": "work_as", "role": "work_as", "address": "reside_at located_at",
    "home": "reside_at", "residence": "reside_at", "location": "located_at reside_at", "name": "named_after", "alias": "call named_after",
    "meaning": "means", "leader": "leader_of", "killer": "murder kill killed_by", "murderer": "murder kill killed_by", "victim": "murder killed_by",
    "relationship": "relationship_to", "weapon": "use",
}
# Nouns that count only in a question without a verb.
CONDITIONAL_NOUNS = "killer murderer victim weapon".split()
# Single words that never name an entity.
PRONOUNS = "i he she it we they him her us them his its our their you your me".split()


def from_facts(facts: DataFrame) -> DataFrame:
    """Facts whose predicate is in the proposition taxonomy, as propositions with an agent and a theme."""
    return facts.filter(F.lower("predicate").isin(PROPOSITION_TAXONOMY)).select(
        F.col("id").alias("prop_id"), "chunk_id", F.lower("predicate").alias("predicate"), F.col("subject_id").alias("agent"),
        F.col("object_id").alias("theme"), "negated", "confidence", F.col("sentence").alias("statement"),
    )


def roles(props: DataFrame) -> DataFrame:
    """prop_id, entity_id, role: the bridge rows of every proposition."""
    return props.select(
        "prop_id", F.explode(F.array(F.struct(F.col("agent").alias("e"), F.lit("agent").alias("r")), F.struct(F.col("theme").alias("e"), F.lit("theme").alias("r")))).alias("x")
    ).filter("x.e is not null").select("prop_id", F.col("x.e").alias("entity_id"), F.col("x.r").alias("role")).distinct()


def junk_entities(entities: DataFrame) -> DataFrame:
    """Entities whose name is a pronoun, shorter than three letters, or without a capital."""
    name = F.trim("canonical_name")
    return entities.filter(F.lower(name).isin(PRONOUNS) | (F.length(name) < 3) | (F.col("canonical_name") == F.lower("canonical_name")))


def entity_aliases(entities: DataFrame) -> DataFrame:
    """entity_id, alias: the lower-cased and the normalised form of every name."""
    name = F.col("canonical_name")
    return entities.select(
        F.col("id").alias("entity_id"), F.explode(F.array_distinct(F.array(normalize_mention(name), F.lower(name)))).alias("alias")
    ).filter("alias <> ''").distinct()


def holding_all(bridge: DataFrame, props: DataFrame, wanted: DataFrame) -> DataFrame:
    """group_id, prop_id, is_agent, confidence, rank: propositions that hold all entities of a group (wanted: group_id, entity_id, first).

    first marks the entity whose agent role ranks a proposition higher.
    """
    need = wanted.groupBy("group_id").agg(F.countDistinct("entity_id").alias("need"))
    have = bridge.join(wanted, "entity_id").groupBy("group_id", "prop_id").agg(
        F.countDistinct("entity_id").alias("have"), F.max(F.when(F.col("first") & (F.col("role") == "agent"), 1).otherwise(0)).alias("is_agent")
    )
    order = Window.partitionBy("group_id").orderBy(F.desc("is_agent"), F.col("confidence").desc_nulls_last(), "prop_id")
    return have.join(need, "group_id").filter("have >= need").join(props.select("prop_id", "confidence"), "prop_id").select(
        "group_id", "prop_id", "is_agent", "confidence", F.row_number().over(order).alias("rank")
    )


def ensure_entities(names: DataFrame) -> DataFrame:
    """entity_id, canonical, alias: one entity per name (its id is the name's hash), under its lower-case and its normalised form."""
    name = F.col("name")
    own = names.filter("name is not null").distinct()
    return own.select(
        F.abs(F.xxhash64(name)).alias("entity_id"), name.alias("canonical"), F.explode(F.array_distinct(F.array(F.lower(name), normalize_mention(name)))).alias("alias")
    ).filter("alias <> ''")
