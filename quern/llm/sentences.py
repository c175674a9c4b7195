"""Sentence units with their offsets, for texts of any language and script.

Cases: a null, empty or blank text yields no rows; a very long text is scanned once, in
linear time; repeated rows and equal texts each yield their own sentences; an empty table
yields no rows; extra columns are dropped before Python sees them, so clashing names
cannot matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import map_batches
from quern.llm.automaton import sentence_spans

_SPANS = T.StructType(
    [
        T.StructField("rec_id", T.LongType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("start_char", T.LongType()),
        T.StructField("end_char", T.LongType()),
    ]
)
_WITH_TEXT = T.StructType([*_SPANS, T.StructField("sentence", T.StringType())])


def split_sentences(df: DataFrame, id_col: str, text_col: str, with_text: bool = False) -> DataFrame:
    """One row per sentence: rec_id, ordinal, start_char, end_char and, if asked for, the sentence itself."""

    def spans(batch):
        ids, ordinals, starts, ends, texts = [], [], [], [], []
        for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for n, (a, b) in enumerate(sentence_spans(text)):
                ids.append(rec)
                ordinals.append(n)
                starts.append(a)
                ends.append(b)
                if with_text:
                    texts.append(text[a:b])
        return {"rec_id": ids, "ordinal": ordinals, "start_char": starts, "end_char": ends, "sentence": texts}

    rows = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, _WITH_TEXT if with_text else _SPANS, spans)


def sentences_of_records(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """The sentences of chunks.text and facts.sentence: rec_type, rec_id, start_char, end_char."""
    parts = [
        split_sentences(df, "id", column).select(F.lit(kind).alias("rec_type"), "rec_id", "start_char", "end_char")
        for kind, df, column in (("chunk", chunks, "text"), ("fact", facts, "sentence"))
    ]
    return parts[0].unionByName(parts[1])
