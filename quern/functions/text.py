"""Text expressions that stay in the JVM: tokens, query terms, mentions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what full-text search folds them to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"
# Question words left out of chunk and fact full-text queries.
QUERY_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can must "
    "of in on at by to for with from and or but not no it its this that their there they them he she his her we our you "
    "your i my what who where when which how whom whose name called used ever first said replied remarked cried"
).split()
# The same for proposition queries, which keep verbs of speech.
PROPOSITION_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can must "
    "of in on at by to for with from and or but not no it its this that their there they them he she his her we our you "
    "your i my what who where when which how whom whose"
).split()
# Titles dropped from mentions.
MENTION_TITLES = "mr mrs ms dr prof sir lady lord miss saint st".split()


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def terms(text: Column) -> Column:
    """Full-text tokens: lower case, diacritics folded, split at everything that is neither letter nor digit."""
    parts = F.split(F.translate(F.lower(text), ACCENTED, FOLDED), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")


def query_terms(question: Column, stopwords: list[str] | None = None) -> Column:
    """Terms of a question that count in a full-text query; repeats are kept, as they weigh twice."""
    stop = _literals(QUERY_STOPWORDS if stopwords is None else stopwords)
    return F.filter(terms(question), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def normalize_mention(text: Column) -> Column:
    """Lower case without punctuation and titles, single blanks."""
    words = F.split(F.regexp_replace(F.lower(text), "[.,;:!?\"'`]", " "), r"[ \t\n\r]+")
    titles = _literals(MENTION_TITLES)
    return F.concat_ws(" ", F.filter(words, lambda w: (w != "") & ~F.array_contains(titles, w)))


def file_name(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, "[^/]+$", 0), F.lit(""))


def source_info(title: Column, path: Column) -> Column:
    """What a citation shows: the title, else the file name, else null."""
    return F.coalesce(F.nullif(title, F.lit("")), file_name(path))
