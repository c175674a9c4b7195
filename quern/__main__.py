"""Commands: config, ingest, ask, chat, stats, maintain, entities, packs, enhance, synonyms, reindex, bench, export."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys

from quern import config as settings


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("config")
    c.add_argument("action", nargs="?", choices=("show", "init"), default="show")
    c.add_argument("--out", default="quern.toml")

    def add(name: str, *positional: str, **optional):
        c = sub.add_parser(name)
        c.add_argument("folder")
        for x in positional:
            c.add_argument(x)
        for x, kind in optional.items():
            c.add_argument(f"--{x.replace('_', '-')}", **kind)

    flag = {"action": "store_true"}
    pack = {"pack": {"action": "append", "default": [], "metavar": "NAME=FOLDER"}}
    add("ingest", "path", full=flag)
    add("ask", "question", explain=flag, **pack)
    add("chat", **pack)
    add("stats")
    add("maintain")
    add("review")
    add("merge", "drop_id", "keep_id")
    add("dismiss", "mention")
    add("close")
    add("prune", signals={"required": True}, bridge_terms={"required": True}, dry_run=flag)
    add("synonyms", similarity={"type": float, "default": 0.8}, dry_run=flag)
    add("reindex")
    add("export", "target")
    add("skeleton", "source", limit={"type": int, "default": 20}, seed={"type": int, "default": 7})
    add("bench", "questions", log={"default": ""})
    c = sub.add_parser("report")
    c.add_argument("log")
    c = sub.add_parser("packs")
    c.add_argument("action", choices=("list", "add", "remove"))
    c.add_argument("registry")
    c.add_argument("name", nargs="?")
    c.add_argument("target", nargs="?")
    return p


def _packs(args) -> int:
    from quern.sources import packs

    if args.action == "add":
        packs.register(args.registry, args.name, args.target)
    elif args.action == "remove":
        return 0 if packs.unregister(args.registry, args.name) else 1
    print(json.dumps(packs.read_registry(args.registry), indent=2))
    return 0


def _bench(spark, kb, args) -> None:
    from pyspark.sql import functions as F

    from quern.operators import evaluation as ev
    from quern.operators.retrieval import cited_tags
    from quern.sources.readers import read_qna, write_run_log

    qna = read_qna(spark, args.questions)
    asked = qna.select(F.col("id").alias("q_id"), "question")
    with ev.Measure("bench") as m:
        stages = kb.stages(asked)
        chunks, hits = stages["chunks"], stages["facts"]
        tags = chunks.select("q_id", "tag").unionByName(hits.select("q_id", "tag")).groupBy("q_id").agg(F.collect_set("tag").alias("valid_tags"))
        places = chunks.filter("source_info is not null").groupBy("q_id").agg(F.collect_set("source_info").alias("chunk_sources"))
        names = kb.all_rows("entities").select(F.col("id").alias("subject_id"), F.col("canonical_name").alias("subject"))
        held = hits.join(kb.all_rows("facts").select("id", "subject_id", "predicate"), "id").join(names, "subject_id")
        held = held.groupBy("q_id").agg(F.collect_list(F.struct("subject", "predicate")).alias("fact_hits"))
        rows = kb.answer(asked).join(qna.withColumnRenamed("id", "q_id"), "q_id").withColumn("run_index", F.lit(0)).withColumnRenamed("expected_keywords", "keywords")
        for part in (tags, places, held):
            rows = rows.join(part, "q_id", "left")
        empty = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("valid_tags", "chunk_sources", "fact_hits")}
        rows = rows.withColumns(empty)
        scores = ev.score_answers(rows)
        parts = ("citation_present", "citation_valid", "keyword_recall", "fact_hit_rate", "retrieval_hit_rate", "hallucination")
        results = rows.join(scores.select("q_id", F.struct(*parts).alias("mechanical")), "q_id").select(
            "q_id", F.col("type").alias("q_type"), "question", "answerable", "answer", cited_tags(F.col("answer")).alias("citations"), "mechanical",
            F.lit(None).cast("int").alias("judge_score"), F.lit(None).cast("string").alias("judge_reason"), F.create_map().cast("map<string,double>").alias("timings"),
            F.lit(0.0).alias("peak_rss_mb"), F.lit(0.0).alias("swap_delta_mb"), "run_index",
        )
        aggregate = ev.run_aggregate(results)
        if args.log:
            write_run_log(dataclasses.asdict(kb.config), results, aggregate, args.log)
        print(ev.report(aggregate.first().asDict() | {"seconds": 0.0}))
    print(json.dumps(m.result))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    config, origin = settings.load(args.config)
    if args.command == "config":
        if args.action == "init":
            if os.path.exists(args.out):
                print(f"{args.out} is there already", file=sys.stderr)
                return 1
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(settings.as_toml(config))
        else:
            print(json.dumps({"config": dataclasses.asdict(config), "origin": origin}, indent=2))
        return 0
    if args.command == "packs":
        return _packs(args)
    from pyspark.sql import SparkSession

    from quern.knowledge import KnowledgeBase
    from quern.operators import generation
    from quern.runtime import ship_package
    from quern.sources.readers import read_documents, read_run_log

    spark = SparkSession.builder.appName("quern").getOrCreate()
    ship_package(spark)
    if args.command == "report":
        from quern.operators.evaluation import report

        for r in read_run_log(spark, args.log, "aggregate", "n_questions long, mean_keyword_recall double, mean_fact_hit_rate double, mean_retrieval_hit_rate double, citation_present_rate double, hallucination_count long").collect():
            print(report(r.asDict()))
        return 0
    kb = KnowledgeBase(spark, args.folder, config)
    for item in getattr(args, "pack", []):
        name, _, folder = item.partition("=")
        kb.attach(name, folder)
    ask = lambda text: spark.createDataFrame([("q", text)], "q_id string, question string")
    if args.command == "stats":
        print(json.dumps(kb.stats()))
    elif args.command == "ingest":
        docs = read_documents(spark, args.path)
        print(json.dumps(kb.ingest_all(docs) if args.full else kb.ingest(docs)))
    elif args.command == "maintain":
        print(json.dumps(kb.maintain()))
    elif args.command == "review":
        for r in kb.review().orderBy("mention").toLocalIterator():
            print(f"{r['mention']}: {r['candidates']}")
    elif args.command == "merge":
        kb.merge_entities(spark.createDataFrame([(int(args.drop_id), int(args.keep_id))], "drop_id long, keep_id long"))
    elif args.command == "dismiss":
        kb.dismiss(args.mention)
    elif args.command == "close":
        print(kb.close_facts())
    elif args.command == "prune":
        print(json.dumps(kb.prune_facts(args.signals.split(","), args.bridge_terms.split(","), args.dry_run)))
    elif args.command == "synonyms":
        for r in kb.learn_synonyms(args.similarity, not args.dry_run).toLocalIterator():
            print(f"{r['predicate']} = {r['synonym']} ({r['similarity']:.3f})")
    elif args.command == "reindex":
        print(json.dumps(kb.reindex()))
    elif args.command == "export":
        print(json.dumps(kb.export(args.target)))
    elif args.command == "skeleton":
        from quern.operators.evaluation import skeleton

        rows = skeleton(*[kb.table(t) for t in ("facts", "entities", "chunks", "sources")], args.source, args.limit, args.seed)
        print(json.dumps([r.asDict() for r in rows.collect()], indent=2))
    elif args.command == "bench":
        _bench(spark, kb, args)
    elif args.command == "chat":
        history: list[dict] = []
        for line in sys.stdin:
            text = line.strip()
            if not text:
                break
            got = kb.stages(ask(text))["context"].first()
            said = generation.extractive(generation.chat_messages(text, got["context"] if got else "", history))
            history += [{"role": "user", "content": text}, {"role": "assistant", "content": said}]
            print(said)
    else:
        r = kb.answer(ask(args.question)).first()
        print(r["answer"] or "nothing found")
        if r["footer"]:
            print(r["footer"])
        if args.explain:
            for e in kb.explain(ask(args.question)).collect():
                print(e["report"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
