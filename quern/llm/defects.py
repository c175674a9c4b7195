"""Broken question-answer pairs: empty, truncated, refused, copied, or in the wrong language.

A multi-label linear classifier over hashed n-grams of the answer and features of the pair.  It
is trained on a bounded sample of rows (sample_rows, a parameter) whose clean answers are cut
short, exchanged for the question, for a refusal or for an answer in another language, or
emptied; one threshold per label is calibrated on held-out synthetic pairs.  Word statistics for
telling languages apart are counted over all rows, by Spark; the `vocabulary_rows` most widespread
of them are sent to the tasks.  Every row is then scored, and a label is given where its score passes its threshold, the first
of LABELS where several do.  What can be read off the pair exactly (only tags and fillers; nothing but the
question) is a feature like the others.  An answer of several sentences is a refusal if the least
of their scores passes.

Cases: a null answer is empty; a null question or q_type leaves only the answer to judge;
answerable null counts as true; a row delivered twice is reported once; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import map_batches
from quern.llm.automaton import sentence_spans
from quern.runtime import durable, hash_sample

LABELS = ("empty", "copies_question", "refusal", "wrong_language", "truncated")
BITS = 17
DENSE = 24
_TAG = re.compile(r"\[\s*[A-Z]{1,2}\s*\d+\s*\]")
_OPEN_TAG = re.compile(r"\[[A-Z]{0,2}\d*\s*$")
_LABEL = re.compile(
    r"^\W*(?:q|a|question|answer|frage|antwort|réponse|pregunta|respuesta|response|prompt|user|assistant|问题|问|回答|答案|答)\s*[:：]\s*", re.IGNORECASE
)
_END_LABEL = re.compile(r"\W(?:a|answer|antwort|réponse|respuesta|response|assistant|回答|答案|答)\s*[:：]\s*$", re.IGNORECASE)
_QUOTED = re.compile(r"“[^”“]*[”“]|„[^“”]*[“”]|«[^»]*»|「[^」]*」|\"[^\"]*\"")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W_]+")
# Words that stand for no answer.
FILLERS = frozenset("na n/a none null nil nan tbd todo unknown undefined empty blank no answer k a s o sin respuesta keine antwort aucune réponse 无 暂无 空".split())
# Frequent function words by language, to tell the language of a question.
FUNCTION_WORDS = {
    "en": "the of and to in is was were who what how why which that did for from with by it at on does did are".split(),
    "de": "der die das und ist was wer wie warum welcher welche dem den von zu mit im ein eine nicht auf bei vor wem".split(),
    "fr": "le la les de des du et est qui que quoi comment pourquoi quel quelle dans sur une un au à se où chez sont".split(),
    "es": "el la los las de del y es quién qué cómo por qué cuál en una un con se para dónde lo a al".split(),
}
REQUESTS = {
    "en": r"\bin english\b|auf englisch|en anglais|en inglés|用英[文语]",
    "de": r"\bin german\b|auf deutsch|en allemand|en alemán|用德[文语]",
    "fr": r"\bin french\b|auf französisch|en français|en francés|用法[文语]",
    "es": r"\bin spanish\b|auf spanisch|en espagnol|en español|用西班牙[文语]",
    "zh": r"\bin chinese\b|auf chinesisch|en chinois|en chino|用中[文语]|用汉语",
    "ru": r"\bin russian\b|auf russisch|en russe|en ruso|用俄[文语]",
    "ja": r"\bin japanese\b|auf japanisch|en japonais|en japonés|用日[文语]",
}
_REQUESTS = {k: re.compile(v, re.IGNORECASE) for k, v in REQUESTS.items()}
_REQUEST_PART = re.compile(
    r"^[^:：]{0,40}[:：]\s*(?=\S)|\s*[(（][^()（）]{0,40}[)）]\s*$",
)
_EMPTIES = ["", " ", "...", "-", "[C1]", "\n", *(f + end for f in ("N/A", "n/a", "NA", "null", "None", "nil", "TBD", "无", "k. A.") for end in ("", ".", " [C1]"))]
REFUSALS = {
    "en": ["I don't know.", "I cannot answer this question.", "I'm sorry, but I can't answer that.", "The context does not mention it.", "There is no information about this.", "Not stated in the text.", "I am unable to help with that.", "The answer cannot be determined from the sources.", "I would rather not say.", "The passages leave this open.", "No information is available.", "As an AI I cannot comment on that."],
    "de": ["Ich weiß es nicht.", "Das kann ich nicht beantworten.", "Dazu gibt es keine Angaben.", "Der Text enthält keine Information darüber.", "Leider kann ich dabei nicht helfen.", "Das geht aus den Auszügen nicht hervor."],
    "fr": ["Je ne sais pas.", "Je ne peux pas répondre à cette question.", "Désolé, aucune information à ce sujet.", "Les extraits ne permettent pas de répondre.", "Le texte ne le dit pas."],
    "es": ["No lo sé.", "No puedo responder a esa pregunta.", "Lo siento, no hay información sobre eso.", "El texto no lo dice.", "Los pasajes no permiten contestar."],
    "zh": ["我不知道。", "我无法回答这个问题。", "没有相关信息。", "根据资料无法判断。", "抱歉，无法提供答案。"],
}


def bare(text: str | None) -> str:
    """The answer without citation tags and outer blanks."""
    return _TAG.sub(" ", text or "").replace("​", " ").replace("﻿", " ").strip()


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFKC", text).casefold())


def is_empty(answer: str | None) -> bool:
    content = tokens(bare(answer))
    return not content or (len(content) <= 3 and "".join(content) in ("na", "none", "null", "nil", "nan", "tbd", "noanswer", "ka", "keineantwort", "sinrespuesta", "sansréponse", "无", "暂无", "空", "unknown", "undefined", "todo"))


def is_copy(question: str | None, answer: str | None) -> bool:
    """Is the answer nothing but the question, once or more?"""
    q = tokens(question or "")
    if not q:
        return False
    text = bare(answer)
    text = _END_LABEL.sub(" ", " " + text)
    rest = tokens(text)
    labels = {"q", "a", "question", "answer", "frage", "antwort", "réponse", "pregunta", "respuesta", "问题", "问", "回答", "答案", "答"}
    variants = [q]
    core = tokens(_REQUEST_PART.sub("", (question or "").strip()))
    if core and core != q:
        variants.append(core)
    for v in variants:
        i, copies = 0, 0
        while i < len(rest):
            if rest[i : i + len(v)] == v:
                copies += 1
                i += len(v)
            elif rest[i] in labels:
                i += 1
            else:
                break
        if copies and i >= len(rest):
            return True
    squeezed = "".join(rest)
    return any(len(v) and squeezed == "".join(v) for v in variants)


_OTHER_SCRIPT = re.compile("[\u0400-\u04ff\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]")


def script_of(text: str) -> str | None:
    if not _OTHER_SCRIPT.search(text):
        return None
    counts = {"zh": 0, "ja": 0, "ru": 0, "hi": 0, "th": 0, "ar": 0, "ko": 0}
    for c in text:
        o = ord(c)
        if 0x4E00 <= o <= 0x9FFF:
            counts["zh"] += 1
        elif 0x3040 <= o <= 0x30FF:
            counts["ja"] += 3
        elif 0x0400 <= o <= 0x04FF:
            counts["ru"] += 1
        elif 0x0900 <= o <= 0x097F:
            counts["hi"] += 1
        elif 0x0E00 <= o <= 0x0E7F:
            counts["th"] += 1
        elif 0x0600 <= o <= 0x06FF:
            counts["ar"] += 1
        elif 0xAC00 <= o <= 0xD7AF:
            counts["ko"] += 1
    best = max(counts, key=counts.get)
    return best if counts[best] >= 2 else None


@lru_cache(maxsize=1 << 16)
def question_language(question: str | None) -> str | None:
    """The language of a question, its request for another language left out."""
    if not question:
        return None
    core = _REQUEST_PART.sub("", question.strip()) or question
    script = script_of(core)
    if script:
        return script
    words = [w.lower() for w in _WORD.findall(core)]
    scores = {lang: sum(w in fw for w in words) for lang, fw in _FUNCTION.items()}
    if "¿" in core or "¡" in core:
        scores["es"] += 3
    if re.search(r"[äöüß]", core):
        scores["de"] += 1
    if re.search(r"\b[lqdjns]['’]", core, re.IGNORECASE) or re.search(r"\s\?", core):
        scores["fr"] += 2
    best = max(scores, key=scores.get)
    return best if scores[best] else None


_FUNCTION = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}


@lru_cache(maxsize=1 << 16)
def asked_languages(question: str | None) -> frozenset[str]:
    """The languages in which an answer is right."""
    found = {k for k, p in _REQUESTS.items() if question and p.search(question)}
    own = question_language(question)
    return frozenset(found | ({own} if own else set()))


def answer_words(answer: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(_QUOTED.sub(" ", bare(answer)))]


def word_counts(rows: DataFrame) -> DataFrame:
    """word, lang, n: in how many distinct questions of a language a word stands in an answer; over all rows."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("q_id", T.StringType())])

    def count(batch):
        out = {"word": [], "lang": [], "q_id": []}
        for q_id, question, answer in zip(*(batch.column(i).to_pylist() for i in range(3))):
            asked = [k for k, p in _REQUESTS.items() if question and p.search(question)]
            lang = asked[0] if asked else question_language(question)
            if not lang or not answer:
                continue
            for w in set(answer_words(answer)):
                out["word"].append(w)
                out["lang"].append(lang)
                out["q_id"].append(q_id)
        return out

    pairs = map_batches(rows.select("q_id", "question", "answer"), schema, count)
    return pairs.distinct().groupBy("word", "lang").agg(F.count("*").alias("n"))


class Languages:
    """Log odds of words by language; words seen in few questions carry nothing."""

    def __init__(self, counts: list[tuple[str, str, int]], totals: dict[str, int]):
        self.langs = sorted(totals)
        table: dict[str, np.ndarray] = {}
        index = {lang: i for i, lang in enumerate(self.langs)}
        for word, lang, n in counts:
            table.setdefault(word, np.zeros(len(self.langs)))[index[lang]] += n
        total = np.array([max(1, totals[x]) for x in self.langs], dtype=float)
        self.weights = {}
        for word, c in table.items():
            if c.sum() >= 6:
                rate = (c + 0.3) / (total + 0.3 * len(total))
                self.weights[word] = np.clip(np.log(rate / rate.mean()), -4, 4)

    def scores(self, answer: str | None) -> dict[str, float]:
        text = _QUOTED.sub(" ", bare(answer))
        script = script_of(text)
        total = np.zeros(len(self.langs))
        for w in answer_words(answer):
            got = self.weights.get(w)
            if got is not None:
                total += got
        out = dict(zip(self.langs, total.tolist()))
        latin = sum(len(w) for w in _WORD.findall(text) if w.islower() and w.isascii())
        if script:
            out[script] = out.get(script, 0.0) + 8
        elif latin:
            for s in ("zh", "ja", "ru", "hi", "th"):
                if s in out:
                    out[s] -= 8
        return out

    def foreign(self, question: str | None, answer: str | None) -> float:
        """How much better the best other language fits the answer than those that were asked for."""
        allowed = asked_languages(question)
        scores = self.scores(answer)
        if not allowed or not scores:
            return 0.0
        inside = max((scores.get(a, -8.0) for a in allowed), default=0.0)
        outside = max((v for k, v in scores.items() if k not in allowed), default=0.0)
        return outside - inside


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) & ((1 << BITS) - 1)


_FINAL = re.compile(r"[.!?。！？।…][\"”’»“」)\]]*$")
_ALL_FUNCTION = frozenset(
    w for ws in FUNCTION_WORDS.values() for w in ws
) | frozenset("a an or but so as because until when while than be been had has have no not she he they their his her its und oder weil bis dass car mais ou ne pas avec depuis pero o porque hasta desde sin fue había".split())


def refusal_parts(answer: str | None) -> list[str]:
    text = bare(answer)
    return [text[a:b] for a, b in sentence_spans(text)]


def features(question: str | None, answer: str | None, languages: Languages, cache: dict | None = None) -> tuple[list[int], np.ndarray]:
    """Hashed feature numbers and the dense pair features."""
    raw = (answer or "").strip()
    text = bare(answer)
    toks = tokens(text)
    low = [t for t in toks]
    tagged = bool(re.search(r"\[\s*[A-Z]{1,2}\s*\d+\s*\]\W*$", raw))
    closed = bool(_FINAL.search(text)) or tagged
    q = tokens(question or "")
    qs = set(q)
    hashed = [_hash("w:" + t) for t in set(low)]
    hashed += [_hash(f"b:{a} {b}") for a, b in zip(low, low[1:])]
    if script_of(text) in ("zh", "ja", "th"):
        hashed += [_hash("c:" + text[i : i + 2]) for i in range(len(text) - 1)]
        units = max(1, len(text) // 2)
    else:
        units = len(low)
    shape = " ".join("9" if t.isdigit() else t for t in low[:2])
    if not closed and low:
        hashed += [_hash("open-start:" + shape), _hash("open-end:" + low[-1]), _hash(f"open-size:{min(units, 12)}")]
    dense = np.zeros(DENSE, dtype=np.float32)
    dense[0] = 1
    dense[1] = is_empty(answer)
    dense[2] = is_copy(question, answer)
    dense[3] = not closed
    dense[4] = bool(_OPEN_TAG.search(raw))
    dense[5] = bool(re.search(r"[,;:，；：]\W*$", text)) and not closed
    dense[6] = bool(low) and low[-1] in _ALL_FUNCTION and not closed
    dense[7] = (not closed) * min(units, 20) / 10
    dense[8] = closed
    foreign = languages.foreign(question, answer)
    dense[9] = float(np.clip(foreign, -10, 10)) / 4
    dense[10] = foreign > 2.5
    dense[11] = len(qs & set(low)) / max(1, len(set(low)))
    dense[12] = len(qs & set(low)) / max(1, len(qs))
    dense[13] = min(units, 40) / 20
    dense[14] = any(t.isdigit() for t in low)
    dense[15] = bool(low) and low[0].isdigit() and not closed
    dense[16] = not closed and bool(low) and all(w[:1].isupper() or w in "&" or w.isdigit() for w in text.split())
    parts = [len(p) for p in refusal_parts(answer)]
    dense[17] = min(len(parts), 5) / 3
    dense[18] = bool(re.search(r"[;；]", text)) and not closed
    return hashed, dense


class _Rows:
    """Feature rows as flat arrays: the hashed numbers of all rows one after the other, and the dense matrix."""

    def __init__(self, rows):
        sizes = np.array([len(h) for h, _ in rows], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.hashed = np.fromiter((x for h, _ in rows for x in h), dtype=np.int64, count=int(self.start[-1]))
        self.dense = np.array([d for _, d in rows], dtype=np.float32).reshape(len(rows), DENSE)
        self.value = (1 / np.sqrt(np.maximum(sizes, 1))).astype(np.float32)

    def entries(self, at: np.ndarray):
        """Hashed numbers of the chosen rows, the place of each one's row in `at`, and its weight."""
        size = self.start[at + 1] - self.start[at]
        which = np.repeat(np.arange(len(at)), size)
        first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(at) else np.zeros(0, np.int64)
        own = self.hashed[np.arange(len(which)) - first[which] + self.start[at][which]]
        return own, which, self.value[at][which]

    def scores(self, model: LinearModel, at) -> np.ndarray:
        at = np.arange(len(self.dense))[at]
        out = self.dense[at] @ model.d.T
        own, which, value = self.entries(at)
        for k in range(len(LABELS)):
            out[:, k] += np.bincount(which, model.w[k, own] * value, len(at)).astype(np.float32)
        return out


class LinearModel:
    """One-vs-rest logistic regression over hashed and dense features, fitted by Adagrad."""

    def __init__(self):
        self.w = np.zeros((len(LABELS), 1 << BITS), dtype=np.float32)
        self.d = np.zeros((len(LABELS), DENSE), dtype=np.float32)
        self.threshold = np.zeros(len(LABELS), dtype=np.float32)

    def score(self, hashed: list[int], dense: np.ndarray) -> np.ndarray:
        s = self.d @ dense
        if hashed:
            s = s + self.w[:, hashed].sum(axis=1) / np.sqrt(len(hashed))
        return s

    def scores(self, rows) -> np.ndarray:
        """rows x labels."""
        return _Rows(rows).scores(self, slice(0, len(rows)))

    def fit(self, rows, labels, epochs: int = 6, rate: float = 0.3, seed: int = 0, batch: int = 64):
        """Adagrad over small batches; all arithmetic on whole batches."""
        data, y = _Rows(rows), np.array(labels, dtype=np.float32)
        gw, gd = np.full_like(self.w, 1e-3), np.full_like(self.d, 1e-3)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for s in range(0, len(order), batch):
                at = order[s : s + batch]
                err = 1 / (1 + np.exp(-np.clip(data.scores(self, at), -30, 30))) - y[at]
                g = err.T @ data.dense[at]
                gd += g * g
                self.d -= rate * g / np.sqrt(gd)
                own, which, value = data.entries(at)
                if not len(own):
                    continue
                columns, where = np.unique(own, return_inverse=True)
                part = err[which] * value[:, None]
                g = np.stack([np.bincount(where, part[:, k], len(columns)) for k in range(len(LABELS))]).astype(np.float32)
                gw[:, columns] += g * g
                self.w[:, columns] -= rate * g / np.sqrt(gw[:, columns])
        return self

    def calibrate(self, rows, labels):
        """For each label the threshold of the best F1 on held-out pairs, in the middle of its plateau."""
        scores = self.scores(rows)
        y = np.array(labels)
        for k in range(len(LABELS)):
            grid = np.linspace(0, 6, 61)
            f1 = []
            for t in grid:
                p = scores[:, k] > t
                tp = (p & (y[:, k] > 0.5)).sum()
                f1.append(2 * tp / max(1, p.sum() + (y[:, k] > 0.5).sum()))
            f1 = np.array(f1)
            best = grid[f1 >= f1.max() - 1e-9]
            self.threshold[k] = best[len(best) // 2] if len(best) else 0.0
        return self


def overlap(question: str | None, answer: str | None) -> bool:
    """Do question and answer share a word of some length, or a pair of letters in scripts without spaces?"""
    def units(text):
        found = set()
        for t in tokens(text):
            if script_of(t) in ("zh", "ja", "th"):
                found |= {t[i : i + 2] for i in range(len(t) - 1) if not t[i : i + 2].isascii()}
                found |= set(re.findall(r"[a-z]{5,}", t))
            elif len(t) > 4:
                found.add(t)
        return found

    return bool(units(question or "") & units(bare(answer)))


def synthetic_pairs(clean, refusals, languages: Languages, rng: random.Random):
    """(question, answer, label or None): clean pairs and each kind of defect made from them."""
    by_lang: dict[str, list[str]] = {}
    for q, a in clean:
        by_lang.setdefault(question_language(q) or "?", []).append(a)
    out = []
    for q, a in clean:
        out.append((q, a, None))
        body = bare(a)
        words = body.split()
        if len(words) >= 5 and script_of(body) is None:
            cut = rng.randint(3, len(words) - 1)
            short = " ".join(words[:cut]).rstrip(".,;")
            short += rng.choice(["", "", "", ",", " [F", " [C1"])
            if not _FINAL.search(short):
                out.append((q, short, "truncated"))
            for m in re.finditer(r"\d+(?: [^\W\d_]+){1,2}", body):
                out.append((q, m.group(), None))
            names = re.findall(r"[A-Z][a-z]{3,}(?: (?:& )?[A-Z][a-z]{3,}){1,2}", body)
            if names:
                out.append((q, rng.choice(names), None))
                numbers = re.findall(r"\d+ [^\W\d_]{3,}", body)
                if numbers:
                    out.append((q, f"{rng.choice(numbers)}; {rng.choice(names)}", None))
        elif len(body) >= 10 and script_of(body):
            cut = rng.randint(5, max(6, len(body) - 2))
            if not _FINAL.search(body[:cut]):
                out.append((q, body[:cut], "truncated"))
            for m in re.finditer(r"\d+[一-鿿]{1,2}", body):
                out.append((q, m.group(), None))
            names = re.findall(r"[A-Z][a-z]{3,}(?: (?:& )?[A-Z][a-z]{3,}){1,2}", body)
            numbers = re.findall(r"\d+[一-鿿]{2}", body)
            if names:
                out.append((q, rng.choice(names), None))
                if numbers:
                    out.append((q, f"{rng.choice(numbers)}，{rng.choice(names)}", None))
        if q:
            made = rng.choice([q, q.upper(), q.lower(), f"Question: {q}\nAnswer:", f"Q: {q}", f"{q} {q}", f"“{q}”", q.rstrip("?？ "), f"{q} [C1]"])
            out.append((q, made, "copies_question"))
            out.append((q, f"{q} {a}", None))
        lang = question_language(q) or "en"
        out.append((q, rng.choice(refusals.get(lang) or refusals["en"]) + rng.choice(["", "", " [C1]"]), "refusal"))
        if rng.random() < 0.5:
            out.append((q, rng.choice(_EMPTIES), "empty"))
        others = [x for x in by_lang if x not in asked_languages(q) and x != "?"]
        if others:
            foreign = rng.choice(by_lang[rng.choice(others)])
            out.append((q, foreign, "wrong_language"))
            short = re.findall(r"\d+ [^\W\d_]+(?: [^\W\d_]+){0,2}|\d+[一-鿿]{2,4}", bare(foreign))
            if short and languages.foreign(q, short[0]) > 1.5:
                out.append((q, short[0], "wrong_language"))
    return out


def train(rows: DataFrame, sample_rows: int = 3000, seed: int = 7, vocabulary_rows: int = 200_000) -> tuple[LinearModel, Languages]:
    """The classifier, fitted on at most sample_rows rows; the word statistics are those of all rows, of which the
    vocabulary_rows of the most widespread words tell languages apart."""
    counted = durable(word_counts(rows))
    # a word of one language that fewer than six questions hold is never used, so only the others are sent
    used = counted.join(counted.groupBy("word").agg(F.sum("n").alias("all_n")).filter("all_n >= 6"), "word")
    top = used.orderBy(F.desc("all_n"), "word", "lang").limit(vocabulary_rows).collect()
    totals: dict[str, int] = {}
    for r in counted.groupBy("lang").agg(F.max("n").alias("n")).collect():
        totals[r["lang"]] = r["n"]
    languages = Languages([(r["word"], r["lang"], r["n"]) for r in top], totals)
    rng = random.Random(seed)
    sample = [
        (r["question"], r["answer"], r["answerable"])
        for r in hash_sample(rows.filter("answer is not null and question is not null"), ["q_id", "run_index"], sample_rows)
        .orderBy("q_id", "run_index", "answer")
        .collect()
    ]
    refusals = {k: list(v) for k, v in REFUSALS.items()}
    # sentences that recur over unlike questions: refusals where most of those can't be answered, else plain short answers
    seen: dict[str, list] = {}
    for q, a, ok in sample:
        for part in refusal_parts(a):
            if not re.search(r"\d", part) and not overlap(q, part) and not is_empty(part):
                at = seen.setdefault(part, [set(), 0, 0])
                at[0].add(q)
                at[1] += ok is False
                at[2] += 1
    plain = []
    for part, (qs, no, n) in seen.items():
        q = min(qs)
        if len(qs) >= 2 and _FINAL.search(part) and no >= 0.5 * n:
            refusals.setdefault(question_language(q) or "en", []).append(part)
        elif len(qs) >= 2 and no < 0.4 * n:
            plain += [(q, part)] * 8
    clean = [
        (q, a)
        for q, a, ok in sample
        if ok is not False and _FINAL.search(bare(a)) and len(bare(a)) > 18 and not is_copy(q, a)
        and languages.foreign(q, a) < 0 and overlap(q, a)
    ]
    rng.shuffle(clean)
    pairs = synthetic_pairs(clean, refusals, languages, rng) + [(q, a, None) for q, a in plain]
    rng.shuffle(pairs)
    feats = [features(q, a, languages) for q, a, _ in pairs]
    labels = [np.array([float(x == lab) for x in LABELS], dtype=np.float32) for _, _, lab in pairs]
    part = int(len(pairs) * 0.8)
    model = LinearModel()
    if part:
        model.fit(feats[:part], labels[:part])
        model.calibrate(feats[part:], labels[part:])
    return model, languages


_RESULT = T.StructType(
    [
        T.StructField("q_id", T.StringType()),
        T.StructField("run_index", T.LongType()),
        T.StructField("defect", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def judge(question, answer, answerable, model: LinearModel, languages: Languages) -> tuple[str | None, float]:
    """The defect of one pair, or None, and the score of the decision: the first label whose score passes its threshold."""
    scores = model.score(*features(question, answer, languages)) - model.threshold
    parts = refusal_parts(answer)
    if len(parts) > 1:
        # nothing but a refusal: the least of its sentences counts
        least = np.inf
        for p in parts:
            least = min(least, (model.score(*features(question, p, languages)) - model.threshold)[2])
            if least <= 0:
                break
        scores[2] = least
    for label, value in zip(LABELS, scores.tolist()):
        if value > 0 and not (label == "refusal" and answerable is False):
            return label, value
    return None, float(scores.max())


def find_defects(rows: DataFrame, sample_rows: int = 3000, vocabulary_rows: int = 200_000) -> DataFrame:
    """q_id, run_index, defect, score: one row per defective pair."""
    rows = rows.select(
        F.col("q_id").cast("string"), F.col("run_index").cast("long"), F.col("question").cast("string"),
        F.col("answer").cast("string"), F.col("answerable").cast("boolean"),
    )
    model, languages = train(rows, sample_rows, vocabulary_rows=vocabulary_rows)
    weights = (model.w.astype(np.float16), model.d, model.threshold)
    words = (languages.langs, languages.weights)
    ready: list = []

    def score(batch):
        if not ready:
            m, lang = LinearModel(), Languages([], {})
            m.w, m.d, m.threshold = weights[0].astype(np.float32), weights[1], weights[2]
            lang.langs, lang.weights = words
            ready.extend((m, lang))
        out = {f.name: [] for f in _RESULT}
        for q_id, run, question, answer, ok in zip(*(batch.column(i).to_pylist() for i in range(5))):
            defect, value = judge(question, answer, ok, *ready)
            if defect:
                for name, x in zip(out, (q_id, run, defect, value)):
                    out[name].append(x)
        return out if out["q_id"] else None

    found = map_batches(rows, _RESULT, score)
    return found.groupBy("q_id", "run_index").agg(F.min("defect").alias("defect"), F.max("score").alias("score"))
