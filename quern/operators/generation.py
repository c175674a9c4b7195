"""Prompts, model calls and what is made of answers.

A generator is any function from a list of messages (role, content) to a text; it runs inside
Arrow batches on the executors and may keep its model in a module-level cache.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import map_batches
from quern.operators.retrieval import pack

SYSTEM = (
    "You answer questions from the passages and facts of a knowledge base. Use nothing else. Cite every statement with the tag of "
    "what it rests on. If the context doesn't hold the answer, say that it is not in my knowledge base."
)
NO_CONTEXT = " There is no context for this question; say so."
PREFILL = "Based on the provided context: "
PROPOSITION_TASK = "Answer the question from the facts below in one sentence and cite their tags. If they don't hold the answer, say: not stated in the source."
NO_PROPOSITION = "No fact is known that answers this question. Reply only: not stated in the source."


def _nothing(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def answer_prompts(questions: DataFrame, contexts: DataFrame, no_think: bool = False) -> DataFrame:
    """q_id, system, content, prefill of every question (q_id, question); contexts: q_id, context."""
    rows = questions.join(contexts.select("q_id", "context"), "q_id", "left")
    none, head = _nothing(F.col("context")), F.lit("/no_think\n" if no_think else "")
    asked = F.concat(head, F.lit("Question: "), "question")
    full = F.concat(
        head, F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "question", F.lit("\nAnswer with inline citations ([C#] or [F#]):")
    )
    return rows.select(
        "q_id", F.when(none, F.lit(SYSTEM + NO_CONTEXT)).otherwise(F.lit(SYSTEM)).alias("system"), F.when(none, asked).otherwise(full).alias("content"),
        F.when(~none, F.lit(PREFILL)).alias("prefill"),
    )


def proposition_prompts(questions: DataFrame, hits: DataFrame, budget: int = 800) -> DataFrame:
    """q_id, block, content: the prompt of every question from its ranked propositions (q_id, rank, statement), or one that abstains.

    The block ends before the first line that would pass the budget.
    """
    line = F.concat(F.lit("[P"), F.col("rank").cast("string"), F.lit("] "), F.coalesce("statement", F.lit("")))
    rows = hits.select("q_id", "rank", line.alias("line")).withColumn("chars", F.length("line"))
    g = pack(rows, "chars", budget, ["rank"]).groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("l"))
    blocks = g.select("q_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"))
    asked = F.concat(F.lit("\n\nQuestion: "), "question")
    return questions.join(blocks, "q_id", "left").select(
        "q_id", "block",
        F.when(F.col("block").isNull(), F.concat(F.lit(NO_PROPOSITION), asked)).otherwise(F.concat(F.lit(PROPOSITION_TASK + "\n\n"), "block", asked)).alias("content"),
    )


def footers(tags: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """q_id, footer: where each cited tag comes from, in the order of the tags (q_id, tag, part, rank); unknown tags are left out.

    chunks: q_id, tag, source_info.  facts: q_id, tag, source_info, subject_name, predicate.
    """
    source = F.coalesce("source_info", F.lit("unknown source"))
    plain = chunks.select("q_id", "tag", F.concat(F.lit("  "), "tag", F.lit(" → "), source).alias("line"))
    named = facts.select("q_id", "tag", F.concat(F.lit("  "), "tag", F.lit(" → "), source, F.lit(" (fact: "), "subject_name", F.lit(" — "), "predicate", F.lit(")")).alias("line"))
    rows = tags.join(plain.unionByName(named), ["q_id", "tag"])
    g = rows.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("part", "rank", "line"))).alias("l"))
    return g.select("q_id", F.concat(F.lit("Sources:\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("footer"))


_ANSWER = T.StructType([T.StructField("q_id", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])


def generate(prompts: DataFrame, generator: Callable[[list[dict]], str]) -> DataFrame:
    """q_id, answer, error: the model's text for every prompt (q_id, system, content, prefill); a call that fails gives its error.

    A prefill opens the answer and stands before what the model adds to it.
    """

    def run(batch):
        out = {"q_id": [], "answer": [], "error": []}
        for q_id, system, content, prefill in zip(*(batch.column(i).to_pylist() for i in range(4))):
            messages = [{"role": r, "content": c} for r, c in (("system", system), ("user", content), ("assistant", prefill)) if c]
            text = error = None
            try:
                text = (prefill or "") + generator(messages)
            except Exception as e:  # one failing call must not end the job
                error = f"{type(e).__name__}: {e}"
            for key, value in zip(out, (q_id, text, error)):
                out[key].append(value)
        return out

    return map_batches(prompts.select(F.col("q_id").cast("string"), "system", "content", "prefill"), _ANSWER, run)


def stream(messages: list[dict], deltas: Callable[[list[dict]], Iterator[str]], prefill: str = "") -> Iterator[str]:
    """The pieces of one answer as they come, on the driver, the prefill first."""
    if prefill:
        yield prefill
    yield from deltas(messages)


def chat_messages(question: str, context: str, history: list[dict], max_turns: int = 3, token_budget: int = 1024) -> list[dict]:
    """The messages of one turn: the last pairs of the history within the budget, then the question with fresh context."""
    pairs = [history[i : i + 2] for i in range(0, len(history) - 1, 2)][-max_turns:]
    while pairs and sum(len(m["content"]) for p in pairs for m in p) > token_budget * 4:
        pairs = pairs[1:]
    content = f"Context:\n{context}\n\nQuestion: {question}\nAnswer with inline citations ([C#] or [F#]):" if context.strip() else f"Question: {question}"
    system = SYSTEM if context.strip() else SYSTEM + NO_CONTEXT
    return [{"role": "system", "content": system}, *(m for p in pairs for m in p), {"role": "user", "content": content}]


def extractive(messages: list[dict]) -> str:
    """The default generator, where no model is given: the first passage of the context with its tag, or a refusal."""
    user = next(m["content"] for m in messages if m["role"] == "user")
    for line in user.splitlines():
        if line.startswith("[") and "] " in line:
            tag, _, text = line.partition(" ")
            return f"{text.strip(chr(34))} {tag}"
    return "It is not in my knowledge base."


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False)
