"""Pieces of oversized texts: limits, overlap, and reassembly."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.pieces import cut_pieces, split_oversized


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["Word word. ", "longish clause, ", "x" * 40, "\n\n", "。", "é "]), max_size=40), st.integers(30, 120))
def test_pieces_keep_the_limit_and_cover(parts, limit):
    text = "".join(parts)
    boundary, pieces = cut_pieces(text, limit, overlap=limit // 10)
    if len(text) <= limit:
        assert pieces == [] and boundary is None
        return
    assert boundary in ("paragraph", "sentence", "word", "none")
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a <= c <= b < d and b - c <= limit // 10
    assert all(0 < b - a <= limit for a, b, _ in pieces)


def test_classes():
    assert cut_pieces("a" * 30, 10, 2)[0] == "none"
    assert cut_pieces("aaa bbb " * 5, 10, 2)[0] == "word"
    assert cut_pieces("Aaa bb. " * 5, 10, 2)[0] == "sentence"
    assert cut_pieces("aaaa\n\nbbbb\n \nccccc", 10, 2)[0] == "paragraph"


def test_overlap_is_the_last_sentence():
    text = "First one here. Second one here. Third one here. Fourth one."
    _, pieces = cut_pieces(text, 40, 20)
    for (a, b, _), (c, _, _) in zip(pieces, pieces[1:]):
        assert text[c:b].strip() == text[a:b].strip()[-len(text[c:b].strip()):]


def test_a_blank_line_far_before_the_target_is_taken():
    text = "A short opening." + "\n\n" + "One more sentence of the long part. " * 65
    _, pieces = cut_pieces(text)
    assert pieces[0] == (0, 16, "paragraph") and all(b - a <= 2048 for a, b, _ in pieces) and pieces[-1][1] == len(text)
    _, pieces = cut_pieces("  \n\n" + "One more sentence of the long part. " * 65)
    assert all(k == "sentence" for _, _, k in pieces[:-1])


def test_rows(spark):
    df = spark.createDataFrame([(1, 9, 0, None, "x"), (2, 9, 1, "short", "x"), (3, 9, 2, "word " * 900, "x")], "id long, source_id long, ordinal int, text string, piece string")
    got = split_oversized(df).collect()
    assert {r.chunk_id for r in got} == {3} and [r.piece for r in sorted(got, key=lambda r: r.piece)] == list(range(len(got)))
    assert split_oversized(df.limit(0)).count() == 0
