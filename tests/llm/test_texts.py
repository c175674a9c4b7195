"""Personal information, broken pairs and mixtures."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import mixture
from quern.llm.defects import asked_languages, find_defects, is_copy, is_empty, question_language
from quern.llm.personal import KINDS, LEAST_SLOTS, LOWER_SURNAME, STRONG, SURNAME, Labelers, SpanClassifier, _slot, choose, find_personal, name_candidates, redact, span_rows, word_knowledge


@pytest.fixture(scope="module")
def found(spark, folder):
    d = spark.read.parquet(folder + "/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame(
        [
            (-1, "Dr. Wunorodane met Octavia Wunorodane. E-mail: octavia dot wunorodane at post dot example or x.y+z@mail.test."), (-2, None), (-3, ""),
            (-4, "Call +44 20 7946 0713 or 646-555-0142. ISBN 978-0-00-667787-X is out of print. The parcel bore the number 00626-9428."),
            (-5, "Lives at Flat 3, 22a Harbour Road, Boneskawick 46230. SSN QQ 40 63 17 C."),
        ],
        "doc_id long, text string",
    )
    return {r.doc_id: r for r in find_personal(d.unionByName(extra)).collect()}, {r.doc_id: r.text for r in d.unionByName(extra).collect()}


def test_spans_are_exact_and_apart(found):
    rows, texts = found
    assert -2 not in rows and rows[-3].spans == []
    for i, r in rows.items():
        at = 0
        for s in r.spans:
            assert at <= s.start_char < s.end_char <= len(texts[i]) and s.kind in KINDS
            at = s.end_char
        assert r.redacted == redact(texts[i], [(s.kind, s.start_char, s.end_char) for s in r.spans])


def test_kinds(found):
    rows, texts = found

    def of(i, kind):
        return [texts[i][s.start_char : s.end_char] for s in rows[i].spans if s.kind == kind]

    assert of(-1, "email") == ["octavia dot wunorodane at post dot example", "x.y+z@mail.test"]
    assert of(-4, "phone") == ["+44 20 7946 0713", "646-555-0142"] and of(-4, "id_number") == []
    assert of(-5, "address") == ["Flat 3, 22a Harbour Road, Boneskawick 46230"] and of(-5, "id_number") == ["QQ 40 63 17 C"]


def test_name_orders():
    table = np.zeros(LEAST_SLOTS, dtype=np.uint8)
    table[_slot("wunorodane", table)] = SURNAME | STRONG | LOWER_SURNAME
    m = SpanClassifier()
    m.votes[:] = 0.3
    text = "OCTAVIA WUNORODANE, wunorodane octavia, Wunorodane, Octavia / O. Wunorodane and Wunorodane & Sons"
    got = [text[s:e] for k, s, e in choose(text, table, m) if k == "name"]
    assert got[:4] == ["OCTAVIA WUNORODANE", "wunorodane octavia", "Wunorodane, Octavia", "O. Wunorodane"]


def test_ordinary_given_names_in_lower_case():
    table = np.zeros(LEAST_SLOTS, dtype=np.uint8)
    table[_slot("lendogeston", table)] = SURNAME | STRONG | LOWER_SURNAME

    def of(text):
        return [text[s:e] for s, e, _, _ in name_candidates(text, table)]

    assert of("they met jack lendogeston there") == ["jack lendogeston"]
    assert of("signed lendogeston, tom") == ["lendogeston, tom"]
    assert of("they met jo lendogeston there") == ["jo lendogeston"]
    assert of("they will sit and nod") == []


def test_surnames_with_inner_marks_are_counted(spark):
    df = spark.createDataFrame([("Thomas Smith-Jones met Margaret O'Brien's sister, Dr. Wunorodane's guest.",)], "text string")
    table = word_knowledge(df)
    assert all(table[_slot(w, table)] & SURNAME for w in ("smith-jones", "smith", "o'brien", "wunorodane")) and not table[_slot("wunorodane's", table)] & SURNAME


def test_names_outside_every_list_are_learned(spark):
    """Given names that no list holds, short surnames, other scripts, any case; and capitalised words that are no names."""
    names = ["Aisha Khan", "Giovanni Rossi", "Priya Natarajan", "Mary Lee", "Margaret Bell", "John Smith"]
    places = ["Yesterday {} wrote a letter.", "We met {} at the station.", "The parcel was for {}, who lives by the river."]
    texts = [t.format(n) for n in names for t in places for _ in range(4)]
    texts += ["Вчера Анна Петрова написала письмо.", "Мы встретили её, это была Анна Петрова.", "Посылка для Анна Петрова пришла."] * 4
    texts += ["昨天张伟给办公室写了一封信。", "我们在车站遇见了张伟。"]
    texts += ["Then Thomas Kingsward left.", "then tom kingsward came in", "the entry is kingsward, M. there", "ed kingsward"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r.doc_id][r.start_char : r.end_char] for r in span_rows(find_personal(df)).collect()}
    assert got == {*names, "Анна Петрова", "张伟", "Thomas Kingsward", "tom kingsward", "kingsward, M.", "ed kingsward"}


def test_labelers_trust_agreement():
    rows = [("phone", (1, 1, 0, 0, 1, 1))] * 50 + [("phone", (-1, -1, 0, 0, 0, -1))] * 50 + [("phone", (0, 0, 0, 0, 1, 1))] * 5
    fit = Labelers().fit(rows)
    assert fit.posterior("phone", (1, 1, 0, 0, 1, 1)) > 0.9 > 0.1 > fit.posterior("phone", (-1, -1, 0, 0, 0, -1))


def test_empty_documents_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert span_rows(find_personal(df)).count() == 0


def test_exact_readings():
    assert is_empty(None) and is_empty(" [C1][F2] ") and is_empty("N/A.") and is_empty("​") and not is_empty("Burned.")
    q = "Who kept the ledger in 1822?"
    assert is_copy(q, "Q: who kept the LEDGER in 1822") and is_copy(q, f"{q} {q} [C1]") and is_copy(q, f"Question: {q}\nAnswer:")
    assert not is_copy(q, q + " Ann kept it.") and not is_copy(None, "x") and not is_copy(q, None)
    assert question_language("Wer führte das Hauptbuch?") == "de" and question_language("¿Quién lo llevaba?") == "es" and question_language("谁？他是谁") == "zh"
    assert asked_languages("Answer in French: Who kept it?") == {"fr", "en"}


def test_defects(spark, folder):
    base = spark.read.parquet(folder + "/question_results.parquet").select("q_id", "run_index", "question", "answer", "answerable")
    q = "Who kept the ledger of Bell & Sons in 1822?"
    extra = spark.createDataFrame(
        [
            ("x1", 0, q, None, True), ("x2", 0, q, "[C1]", None), ("x3", 0, q, q.upper(), True), ("x4", 0, q, "I don't know.", None), ("x5", 0, q, "I don't know.", False),
            ("x6", 0, None, "Ann kept it.", None), ("x1", 0, q, None, True),
        ],
        "q_id string, run_index int, question string, answer string, answerable boolean",
    )
    got = {(r.q_id, r.run_index): r.defect for r in find_defects(base.unionByName(extra)).collect()}
    assert got[("x1", 0)] == "empty" and got[("x2", 0)] == "empty" and got[("x3", 0)] == "copies_question" and got[("x4", 0)] == "refusal" and ("x5", 0) not in got
    assert find_defects(base.limit(0)).count() == 0


def test_splitting_tree():
    rng = np.random.default_rng(1)
    quotas = np.array([100, 7, 0, 33])
    out = mixture.split_quotas(quotas, 6, rng)
    assert (out.sum(axis=0) == quotas).all() and (out >= 0).all() and np.ptp(out.sum(axis=1)) <= 3


def test_mixture(spark):
    docs = [(i, "a" if i % 3 else " A ", 10 + i % 5) for i in range(300)] + [(1000 + i, "b", 10) for i in range(20)] + [(2000, None, 5), (2001, " ", 5), (3000, "c", 50)]
    sizes = spark.createDataFrame([(i, s.strip().lower(), n) for i, s, n in docs if s and s.strip()], "doc_id long, label string, tokens long")
    targets = spark.createDataFrame([("A", 0.5, 1), ("b", 0.2, 2), ("d", 0.1, 9), (None, 0.2, 1), ("c", None, None)], "source string, target_share double, max_repeats int")
    plan = mixture.plan_shares(sizes, targets)
    mix = mixture.draw_mixture(sizes, targets, shards=4, least_blocks=16).cache()
    assert mix.groupBy("doc_id", "pass").count().filter("count > 1").count() == 0
    got = {r.source: r for r in mixture.reached_shares(mix, plan).collect()}
    total = sum(n for _, s, n in docs if s and s.strip())
    assert abs(got["A"].tokens - 0.5 * total) <= 14 and got["A"].most_uses == 1 and got["A"].reachable
    assert got["b"].tokens == 400 and got["b"].most_uses == 2 and not got["b"].reachable
    assert got["d"].tokens == 0 and not got["d"].reachable and got["c"].tokens == 0
    assert mix.select("shard").distinct().count() == 4


@pytest.mark.skipif(not os.path.exists(mixture.TOKENIZER), reason="no tokenizer file")
def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", " X "), (2, None, "x"), (3, "", "x"), (4, "a", None)], "doc_id long, text string, source string").withColumn("tokens", F.lit(9))
    got = {r.doc_id: (r.label, r.tokens) for r in mixture.count_tokens(df).collect()}
    assert got == {1: ("x", 2), 2: ("x", 0), 3: ("x", 0)}
