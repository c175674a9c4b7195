"""A knowledge base: a folder of Parquet tables and the operators over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Config
from quern.operators import answering as an
from quern.operators import enrichment as en
from quern.operators import entities as ents
from quern.operators import extraction as ex
from quern.operators import facts as fx
from quern.operators import generation as gen
from quern.operators import ingest as ing
from quern.operators import propositions as props
from quern.operators import retrieval as rt
from quern.operators import vectors as vec
from quern.operators.fulltext import StoredIndex
from quern.runtime import folder_path, stored
from quern.sources import packs

SCHEMAS = {
    "sources": "id long, path string, title string, author string, meta string, sha256 string, ingested_at timestamp",
    "chunks": "id long, source_id long, ordinal int, text string, sha256 string, extracted_v int",
    "entities": "id long, canonical_name string, kind string, created_at timestamp",
    "aliases": "entity_id long, alias string",
    "facts": "id long, chunk_id long, subject_id long, sentence string, predicate string, object_id long, object_text string, qualifiers string, negated boolean, confidence double, source string",
    "predicate_synonyms": "predicate string, synonym string",
    "propositions": "prop_id long, chunk_id long, predicate string, agent long, theme array<long>, location long, polarity string, confidence double, statement string, evidence string",
    "proposition_entities": "prop_id long, entity_id long, role string",
    "pending_links": "mention string, entity_ids array<long>",
    "vec_chunks": "id long, embedding array<float>",
    "vec_entities": "id long, embedding array<float>",
    "vec_facts": "id long, embedding array<float>",
    "vec_propositions": "id long, embedding array<float>",
    "db_meta": "key string, value string",
}
#: Columns that hold ids, by table: re-keyed where a pack is attached.
ID_COLUMNS = {
    "sources": ["id"], "chunks": ["id", "source_id"], "entities": ["id"], "aliases": ["entity_id"], "facts": ["id", "chunk_id", "subject_id", "object_id"],
    "vec_chunks": ["id"], "vec_entities": ["id"], "vec_facts": ["id"],
}


class KnowledgeBase:
    """Tables are read when used; a writing method replaces or appends Parquet files of its table.

    Rows of `sources` are written last: they mark their chunks as complete, so a job that was cut off
    finds nothing registered and can be run again.  Ids are hashes of content; two contents with one id are an error.
    """

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, embedder=vec.hash_embedding):
        self.spark, self.folder, self.config, self.embedder = spark, folder.rstrip("/"), config or Config(), embedder
        self.attached: list[tuple[str, str]] = []

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def table(self, name: str) -> DataFrame:
        """A table, empty with its schema where it was never written; a replacement that was cut off is finished first."""
        path = f"{self.folder}/{name}.parquet"
        fs, here = self._fs(path)
        _, new = self._fs(path + ".new")
        if not fs.exists(here) and fs.exists(self._fs(path + ".new/_SUCCESS")[1]):
            fs.rename(new, here)
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}.parquet")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Replace a table by rows that may be computed from it: the new one is written whole beside it, then takes its name."""
        path = f"{self.folder}/{name}.parquet"
        rows.write.mode("overwrite").parquet(path + ".new")
        fs, here = self._fs(path)
        fs.delete(here, True)
        fs.rename(self._fs(path + ".new")[1], here)

    def _append_hashed(self, name: str, rows: DataFrame, content: str = "sha256") -> None:
        """Append rows whose id is a hash of their content, unless one id would stand for two contents."""
        known = self.table(name).select("id", content).join(rows.select("id"), "id", "left_semi")
        clash = rows.select("id", content).unionByName(known).groupBy("id").agg(F.countDistinct(content).alias("n")).filter("n > 1")
        if not clash.isEmpty():
            raise ValueError(f"two contents of {name} have one id: {clash.first()['id']}")
        self.append(name, rows)

    def ingest(self, documents: DataFrame) -> dict[str, int]:
        """Register documents (path, text) whose content is new, and their chunks; counts of what was added.

        Ids are content hashes, so that they need no counter and no order of all rows.
        """
        rows = documents.filter("text is not null").select("path", "text", ing.content_hash(F.col("text")).alias("sha256"))
        fresh = stored(ing.new_rows(rows, self.table("sources"), "sha256", ["path"]).withColumn("id", F.abs(F.xxhash64("sha256"))))
        size, overlap = self.config.ingest.chunk_tokens * 4, self.config.ingest.overlap_sentences
        pieces = fresh.select(F.col("id").alias("source_id"), F.posexplode(ing.make_chunks(ing.plain_sentences(F.col("text")), size, overlap)).alias("ordinal", "text"))
        chunks = pieces.withColumn("sha256", ing.content_hash(F.col("text"))).withColumn("id", F.abs(F.xxhash64("sha256")))
        chunks = stored(ing.new_rows(chunks, self.table("chunks"), "sha256", ["source_id", "ordinal"]))
        self._append_hashed("chunks", chunks.select("id", "source_id", "ordinal", "text", "sha256", F.lit(0).alias("extracted_v")))
        self._append_hashed(
            "sources",
            fresh.select("id", "path", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("meta"), "sha256", F.current_timestamp().alias("ingested_at")),
        )
        return {"sources": fresh.count(), "chunks": chunks.count()}

    def ingest_all(self, documents: DataFrame) -> dict[str, int]:
        """ingest, then vectors, facts with their coreferences, propositions and indexes of the new chunks; counts of all."""
        before = self.table("chunks").select("id")
        counts = self.ingest(documents)
        new = stored(self.table("chunks").join(before, "id", "left_anti")) if counts["chunks"] else self.table("chunks").limit(0)
        self.append("vec_chunks", vec.embed(new, "id", "text", self.embedder))
        counts["facts"] = self._extract(new)
        found = ex.extract_introductions(new)
        parsed = found.select("chunk_id", "n", "predicate", "agent", "themes", F.lit(None).cast("string").alias("location"), "statement", "evidence")
        counts["propositions"] = self._add_propositions(parsed)
        self.index("chunks").append(new.select("id", "text"), "id", "text")
        return counts

    def _extract(self, chunks: DataFrame) -> int:
        """Facts of new chunks by the plain parser; a pronoun takes the last named subject of its chunk with less confidence."""
        sentences = chunks.select(F.col("id").alias("chunk_id"), F.posexplode(ing.plain_sentences(F.col("text"))).alias("n", "text"))
        sentences = stored(sentences.withColumn("sentence_id", F.abs(F.xxhash64("chunk_id", "n"))))
        parsed = ex.parse_sentences(sentences)
        rows = ex.extract_facts(parsed).join(ex.qualifiers(parsed), "sentence_id", "left").join(sentences, "sentence_id")
        rows = ex.carry_subject(rows).filter("subject is not null")
        made, fresh = en.fact_rows(
            rows.select("chunk_id", "n", "subject", "predicate", F.coalesce("object", F.lit("")).alias("object"), "negated", F.col("text").alias("sentence"), "qualifiers"),
            chunks.select(F.col("id").alias("chunk_id"), "text"), self.table("aliases"), "extraction",
        )
        return self._add_facts(made.withColumn("confidence", F.lit(1.0)).withColumn("source", F.lit("svo")), fresh)

    def _add_facts(self, made: DataFrame, fresh: DataFrame) -> int:
        key = ["chunk_id", "subject_id", "predicate", "object_text", "qualifiers"]
        old = self.table("facts").select(*key)
        same = F.lit(True)
        for c in key:
            same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
        rows = stored(made.alias("n").join(old.alias("o"), same, "left_anti"))
        new = stored(fresh.join(self.table("entities").select("id"), "id", "left_anti"))
        self.append("entities", new.select("id", "canonical_name", F.lit("unknown").alias("kind"), F.current_timestamp().alias("created_at")))
        self.append("aliases", props.entity_aliases(new))
        self.append("vec_entities", vec.embed(new, "id", "canonical_name", self.embedder))
        self.append("facts", rows.select(*[c.split()[0] for c in SCHEMAS["facts"].split(", ")]))
        return rows.count()

    def _add_propositions(self, parsed: DataFrame) -> int:
        made, bridge, entities = en.proposition_rows(parsed)
        rows = stored(made.join(self.table("propositions").select("prop_id"), "prop_id", "left_anti"))
        self.append("propositions", rows.select(*[c.split()[0] for c in SCHEMAS["propositions"].split(", ")]))
        self.append("proposition_entities", bridge.join(rows.select("prop_id"), "prop_id", "left_semi"))
        self.append("vec_propositions", vec.embed(rows, "prop_id", "statement", self.embedder))
        new = stored(entities.join(self.table("entities").select("id"), "id", "left_anti"))
        self.append("entities", new.select("id", "canonical_name", "kind", F.current_timestamp().alias("created_at")))
        self.append("aliases", props.entity_aliases(new))
        return rows.count()

    def index(self, name: str) -> StoredIndex:
        """The stored full-text index of chunks, facts or minted facts."""
        return StoredIndex(self.spark, folder_path(f"{self.folder}/index-{name}"))

    def reindex(self) -> dict[str, int]:
        """Rebuild the indexes and the vectors of facts; the number of documents of each."""
        named = fx.with_names(self.table("facts"), self.table("entities"))
        counts = {"chunks": self.index("chunks").rebuild(self.table("chunks"), "id", "text")["documents"]}
        for name, minted in (("facts", False), ("minted", True)):
            counts[name] = self.index(name).rebuild(fx.fact_documents(named, minted), "id", "document")["documents"]
        self.replace("vec_facts", vec.embed(fx.fact_documents(named), "id", "document", self.embedder))
        return counts

    def attach(self, name: str, folder: str) -> None:
        """Read a pack beside this knowledge base from now on."""
        lacking = packs.missing_tables(self.spark, folder)
        if lacking:
            raise ValueError(f"not a pack, lacks: {', '.join(lacking)}")
        self.attached.append((name, folder))

    def all_rows(self, name: str) -> DataFrame:
        """A table with those of all attached packs, whose ids are re-keyed by the pack's name."""
        out = self.table(name)
        for pack, folder in self.attached:
            rows = packs.open_pack(self.spark, folder).get(name)
            if rows is None:
                continue
            for c in ID_COLUMNS.get(name, []):
                rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.abs(F.xxhash64(F.lit(pack), F.col(c)))))
            out = out.unionByName(rows, allowMissingColumns=True)
        return out

    def settings(self) -> an.Settings:
        c = self.config.retrieval
        return an.Settings(
            c.top_k_chunks, c.top_k_chunks, c.rrf_k_vec, c.rrf_k_fts, c.token_budget, c.fact_fts_top_k, c.max_facts_in_context, c.fact_sources, c.fact_vec_mode, c.fact_vec_top_k,
            c.fact_expand_names, c.rerank_mode, c.rerank_pool,
        )

    def stages(self, questions: DataFrame) -> dict[str, DataFrame]:
        """What every stage of a retrieval finds for the questions (q_id, question)."""
        tables = {t: self.all_rows(t) for t in ("chunks", "sources", "facts", "entities", "aliases")}
        tables["synonyms"] = fx.both_directions(self.table("predicate_synonyms"))
        for t in ("vec_chunks", "vec_facts"):
            tables[t] = self.all_rows(t).select("id", F.col("embedding").cast("array<double>").alias("vec"))
        return an.retrieve(tables, questions, self.settings(), self.embedder)

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """q_id, chunk_id, tag, text, score, source_info: the packed chunks of every question (q_id, question)."""
        return self.stages(questions)["chunks"].select("q_id", "chunk_id", "tag", "text", "score", "source_info")

    def explain(self, questions: DataFrame) -> DataFrame:
        return an.explain(self.stages(questions))

    def answer(self, questions: DataFrame, generator: Callable[[list[dict]], str] = gen.extractive) -> DataFrame:
        """q_id, answer, footer, refused: the model's answer from propositions where some fit, else from chunks and facts.

        Citations of what the context doesn't hold are dropped.
        """
        stages = self.stages(questions)
        chunks, hits = stored(stages["chunks"]), stored(stages["facts"])
        prompts = gen.answer_prompts(questions, stages["context"])
        said = stored(gen.generate(prompts, generator))
        known = chunks.select("q_id", "tag").unionByName(hits.select("q_id", "tag")).groupBy("q_id").agg(F.collect_set("tag").alias("valid"))
        rows = said.join(known, "q_id", "left").withColumn("valid", F.coalesce("valid", F.array().cast("array<string>")))
        clean = rows.select("q_id", rt.strip_citations(F.col("answer"), F.col("valid")).alias("answer"))
        tags = clean.select("q_id", F.posexplode(rt.cited_tags(F.col("answer"))).alias("rank", "tag")).withColumn("part", F.lit(0))
        hydrated = hits.join(fx.hydrate(*[self.all_rows(t) for t in ("facts", "entities", "chunks", "sources")]), "id")
        feet = gen.footers(tags, chunks.select("q_id", "tag", "source_info"), hydrated)
        return clean.join(feet, "q_id", "left").withColumn("refused", rt.is_refusal(F.col("answer")))

    def answer_propositions(self, questions: DataFrame, generator: Callable[[list[dict]], str] = gen.extractive) -> DataFrame:
        """q_id, answer: answers from the propositions alone."""
        p = self.table("propositions").withColumn("theme", F.element_at("theme", 1))
        vectors = self.table("vec_propositions").select("id", F.col("embedding").cast("array<double>").alias("vec"))
        hits = an.proposition_hits(questions, p, self.table("aliases"), vectors=vectors, embedder=self.embedder).join(p.select("prop_id", "statement"), "prop_id")
        prompts = gen.proposition_prompts(questions, hits)
        return gen.generate(prompts.select("q_id", F.lit(None).cast("string").alias("system"), "content", F.lit(None).cast("string").alias("prefill")), generator)

    def proposition(self, prop_id: int) -> dict | None:
        """One proposition with its roles as a structure, or none."""
        row = self.table("propositions").filter(F.col("prop_id") == prop_id).first()
        return row.asDict(recursive=True) if row else None

    def _meta(self, key: str) -> str | None:
        row = self.table("db_meta").filter(F.col("key") == key).first()
        return row["value"] if row else None

    def _set_meta(self, key: str, value: str) -> None:
        rows = self.spark.createDataFrame([(key, value)], SCHEMAS["db_meta"])
        self.replace("db_meta", vec.upsert(self.table("db_meta"), rows, "key"))

    def enhance(self, generator: Callable[[list[dict]], str], passes: tuple[str, ...] = ("extraction",), force: bool = False, limit: int | None = None) -> dict[str, int]:
        """Run model passes whose version isn't reached (all, with force); the number of facts or propositions each added.

        The extraction pass reads chunks of the backlog and marks them, also where the model failed.
        """
        added = {}
        for kind in passes:
            version = str(en.VERSIONS[kind])
            if kind != "extraction" and not force and self._meta(f"pass_{kind}") == version:
                added[kind] = 0
                continue
            names = en.known_names(self.table("entities"), self.table("facts"))
            texts = self.table("chunks").select(F.col("id").alias("chunk_id"), "text", "extracted_v").filter("text is not null")
            if kind == "extraction":
                texts = texts if force else texts.filter("extracted_v = 0")
                texts = stored(texts.orderBy("chunk_id").limit(limit) if limit else texts)
            elif kind == "entity":
                wanted = ents.proper_names(self.table("entities")).select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))
                found = ex.entity_context(wanted, self.table("chunks").filter("text is not null"))
                texts = found.join(wanted, "entity_id").select(F.col("first_chunk").alias("chunk_id"), F.col("context").alias("text"), F.col("name").alias("entity"))
            if kind == "proposition":
                added[kind] = self._add_propositions(stored(en.read_propositions(texts, names, generator)))
            else:
                parsed = stored(en.read_facts(kind, texts, names, generator))
                added[kind] = self._add_facts(*en.fact_rows(parsed, texts, self.table("aliases"), kind))
            if kind == "extraction":
                done = texts.select(F.col("chunk_id").alias("id")).distinct().withColumn("done", F.lit(en.VERSIONS[kind]))
                marked = self.table("chunks").join(done, "id", "left").withColumn("extracted_v", F.coalesce("done", "extracted_v")).drop("done")
                self.replace("chunks", marked)
            else:
                self._set_meta(f"pass_{kind}", version)
        self.reindex()
        return added

    def learn_synonyms(self, similarity: float = 0.8, write: bool = True) -> DataFrame:
        """predicate, synonym, similarity: pairs of predicates whose vectors are that similar; kept in the table unless write is off."""
        own = self.table("facts").select("predicate").filter("predicate is not null").distinct().withColumn("words", F.regexp_replace("predicate", "_", " "))
        v = vec.embed(own, "predicate", "words", self.embedder).select(F.col("id").alias("predicate"), F.col("embedding").alias("v"))
        b = v.select(F.col("predicate").alias("synonym"), F.col("v").alias("w"))
        # predicates are a closed set of some dozens
        near = v.join(b, F.col("predicate") < F.col("synonym")).withColumn("d", vec.l2(F.col("v"), F.col("w"))).filter(F.col("d") < vec.cosine_threshold(similarity))
        pairs = stored(near.select("predicate", "synonym", (1 - F.col("d") * F.col("d") / 2).alias("similarity")))
        if write:
            self.append("predicate_synonyms", pairs.select("predicate", "synonym").join(self.table("predicate_synonyms"), ["predicate", "synonym"], "left_anti"))
        return pairs.orderBy(F.desc("similarity"), "predicate", "synonym")

    def review(self) -> DataFrame:
        """mention, candidates: ambiguous mentions with the details of what they may mean; dismissed ones are left out."""
        gone = self.table("pending_links").filter("size(entity_ids) = 0").select("mention")
        return ents.pending_details(ents.pending(self.table("aliases")).join(gone, "mention", "left_anti"), self.table("entities"))

    def dismiss(self, mention: str) -> None:
        """Leave a mention out of later reviews."""
        self.append("pending_links", self.spark.createDataFrame([(mention, [])], SCHEMAS["pending_links"]))

    def maintain(self, rows_per_file: int = 2_000_000) -> dict[str, int]:
        """Rewrite every table in few files; the number of files of each afterwards."""
        out = {}
        for name in SCHEMAS:
            n = self.table(name).count()
            if n:
                files = max(1, -(-n // rows_per_file))
                self.replace(name, self.table(name).repartition(files))
                out[name] = files
        return out

    def close_facts(self) -> int:
        """Mint the closure facts that are missing; the number added."""
        made = fx.closure(self.table("facts"), self.table("entities"))
        names = self.table("entities").select(F.col("id").alias("subject_id"), "canonical_name")
        rows = stored(
            made.join(names, "subject_id").select(
                F.abs(F.xxhash64("subject_id", "predicate", "object_text")).alias("id"), "chunk_id", "subject_id",
                F.concat(F.lit("Derived: "), "canonical_name", F.lit(" "), "predicate", F.lit(" "), "object_text").alias("sentence"), "predicate",
                F.lit(None).cast("long").alias("object_id"), "object_text", F.lit(None).cast("string").alias("qualifiers"), F.lit(False).alias("negated"), "confidence", F.lit("closure").alias("source"),
            )
        )
        self.append("facts", rows)
        return rows.count()

    def prune_facts(self, signals: list[str], bridge_terms: list[str], dry_run: bool = False) -> dict[str, int]:
        bad = stored(fx.prune(self.table("facts"), signals, bridge_terms))
        counts = {r["kind"]: r["count"] for r in bad.groupBy("kind").count().collect()}
        if not dry_run and counts:
            self.replace("facts", self.table("facts").join(bad.select("id"), "id", "left_anti"))
        return {"bridge": counts.get("bridge", 0), "closure": counts.get("closure", 0)}

    def merge_entities(self, merges: DataFrame) -> None:
        """Rewrite merged ids (drop_id, keep_id) in facts and aliases, and drop the merged entities."""
        m = stored(merges.select("drop_id", "keep_id").distinct())
        self.replace("facts", ents.merge(self.table("facts"), m))
        a = self.table("aliases").join(m.withColumnRenamed("drop_id", "entity_id"), "entity_id", "left")
        self.replace("aliases", a.select(F.coalesce("keep_id", "entity_id").alias("entity_id"), "alias").distinct())
        self.replace("entities", ents.without_merged(self.table("entities"), "id", m))
        self.replace("vec_entities", ents.without_merged(self.table("vec_entities"), "id", m))
        ids = m.select("drop_id").union(m.select("keep_id"))
        self.replace("pending_links", ents.dismiss(self.table("pending_links"), ids))

    def stats(self) -> dict[str, int]:
        return {t: self.table(t).count() for t in ("sources", "chunks", "entities", "aliases", "facts")}

    def export(self, folder: str) -> dict[str, int]:
        return packs.export_pack({t: self.table(t) for t in SCHEMAS}, folder)
