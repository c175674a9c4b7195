"""Sentence offsets: rules by example, and a round trip on any text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.automaton import build_trie, sentence_spans
from quern.llm.sentences import split_sentences

ONE = [
    "“Stop! Nobody leaves. The register is gone,” said Ann Bell.",
    "“Who has it?! Was it a cabinet?” cried Tom, and that cart avoided Lucy.",
    "Ann wrote: “The boat is late. Send the harbour at once.”",
    "The messenger (nobody knew why. perhaps the porter did) left.",
    "The words ‘No cart. No ledger.’ were painted on the door.",
    "Item No. 286 shows the garden, e.g. the one that St. Peter watched at 3.25 p.m. and later.",
    "The file ledger_216.txt (v23.12) lists the carriage.",
    "The boat paused ... and then dragged the rope.",
    "J. R. Smith and Mrs. Brown met Dr. Ann K. Bell.",
    "—Alto. Nadie sale. Es tarde —gritó la casera.",
    "«Где ключ?» — спросил свидетель.",
    "« Où est la clef ? » demanda le gardien.",
    "Am 28. März 1817 kopierte Hr. Braun z. B. den Brief, vgl. S. 79.",
    "Цена выросла до 57,13 руб. за фунт, т. е. почти вдвое.",
    "“钥匙在哪里？”女房东在树林边上问道。",
    "路很长……档案员还是来了。",
    "「止まれ！誰も出るな。もう遅い。」と粉屋は叫んだ。",
    "“रुको। कोई नहीं जाएगा।” मुंशी ने चिल्लाकर कहा।",
    "घर नं. 18 से 29.20 कि.मी. दूर है।",
    "A sentence over\ntwo lines without a break",
]


@pytest.mark.parametrize("text", ONE)
def test_one_sentence(text):
    assert sentence_spans(text) == [(0, len(text))]


MANY = [
    ("A heading\n\nIt went to Bell & Co. The rope broke.", ["A heading", "It went to Bell & Co.", "The rope broke."]),
    ("Ann wrote: “It is late. Go.” The quarry paused.", ["Ann wrote: “It is late. Go.”", "The quarry paused."]),
    ("In the rain.The file fell! what then?", ["In the rain.", "The file fell!", "what then?"]),
    ("Nägel, Seile usw. Kurz darauf kam er.", ["Nägel, Seile usw.", "Kurz darauf kam er."]),
    ("The doctor reached the mill at 9.10 p.m. In the meantime he slept.", ["The doctor reached the mill at 9.10 p.m.", "In the meantime he slept."]),
    ("天亮了。“站住！谁也不许走。”女教师喊道。他写道：“船不来了。”为什么？", ["天亮了。", "“站住！谁也不许走。”女教师喊道。", "他写道：“船不来了。”", "为什么？"]),
    ("ปีนั้นเจ้าของบ้าน ตอนเย็นช่างพิมพ์จาก Weltagogate นับ", ["ปีนั้นเจ้าของบ้าน", "ตอนเย็นช่างพิมพ์จาก Weltagogate นับ"]),
    ("One.\n \t\nTwo", ["One.", "Two"]),
]


@pytest.mark.parametrize("text,want", MANY)
def test_many_sentences(text, want):
    assert [text[a:b] for a, b in sentence_spans(text)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1 .!?\n“”‘’«»()[]—…。「」ก,é", max_size=60))
def test_sentences_cover_everything_but_white_space(text):
    at = 0
    for a, b in sentence_spans(text):
        assert not text[at:a].strip() and b > a and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


def test_empty_and_long():
    assert sentence_spans(None) == [] and sentence_spans("") == [] and sentence_spans(" \n ") == []
    assert len(sentence_spans("It rained. " * 20000)) == 20000


def test_trie_reads_backwards():
    assert build_trie(["ab"]) == {"b": {"a": {"": True}}}


def test_rows_with_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "A b. C d.", 5), (3, "A b. C d.", 5), (None, "X", 5)], "id long, text string, start_char int")
    got = split_sentences(df, "id", "text", with_text=True).collect()
    assert sorted((r.rec_id or 0, r.ordinal, r.sentence) for r in got) == [(0, 0, "X"), (3, 0, "A b."), (3, 0, "A b."), (3, 1, "C d."), (3, 1, "C d.")]
    assert split_sentences(df.limit(0), "id", "text").count() == 0


def _texts(text):
    return [text[a:b] for a, b in sentence_spans(text)]


def test_list_levels_nest():
    assert _texts("Buy:\n1. Fruit\n   a) apples\n   b) pears\n2. Bread and\nbutter\n3. Milk") == ["Buy:", "1. Fruit", "a) apples", "b) pears", "2. Bread and\nbutter", "3. Milk"]
    assert _texts("- one item\n- two items\nthat go on\n- three") == ["- one item", "- two items\nthat go on", "- three"]
    # a number at the start of a wrapped line is no item
    assert _texts("He came on the\n12. März and left.") == ["He came on the\n12. März and left."]
    assert _texts("It stood\n- as they say - alone.") == ["It stood\n- as they say - alone."]


def test_open_quotations_do_not_depend_on_length():
    words, more = "He said “go now. She left. He came.", " More text stands here." * 30
    assert _texts(words)[:3] == _texts(words + more)[:3] == ["He said “go now.", "She left.", "He came."]
    assert len(_texts("He said “go now. " + "She left. " * 40 + "He")) == 1


def test_reporting_clauses_by_position():
    for verb in ("asked", "inquired", "demanded loudly"):
        assert _texts(f"“Where is it?” Ann {verb}. He left.") == [f"“Where is it?” Ann {verb}.", "He left."]
    assert _texts("«Dov'è?» Anna mormorò. Poi uscì.") == ["«Dov'è?» Anna mormorò.", "Poi uscì."]
    assert _texts("“Where is it?” The door was locked. He left.") == ["“Where is it?”", "The door was locked.", "He left."]
