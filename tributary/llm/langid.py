"""Language identification of whole texts, with spans of mixed-language text.

Script ranges narrow the languages a word can be of; character n-grams score it under each of them; Viterbi
over the words, with a penalty for each switch, labels spans. Words are letters of one script with the marks that
combine with them (vowel signs, accents); longer runs, as in scripts without blanks, are cut into pieces, of which
each is scored. A document's language is the one whose spans hold most letters, its score their share of all letters.

The model is learnt from labelled rows: the ``SAMPLE`` documents of all languages together whose doc_id has the
smallest hash, whole texts, and of each language its most frequent n-grams, ``FEATURES`` for all languages together.
Both bounds are parameters. Rows without doc_id teach nothing. Predictions read the text only.

Null texts and texts without a letter give ``und`` and score 0; a text whose letters are all in scripts no
learnt language uses gives the most frequent learnt language with score 0; with nothing learnt, ``und``.
Ties go to the language first in order. Repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import forget, map_columns, map_values, only

SAMPLE, FEATURES, ORDERS, SWITCH, CACHE, WORDS = 4_000, 100_000, 3, 6.0, 200_000, 300_000
#: First and last code point of the scripts told apart (fixed values of the Unicode blocks).
SCRIPTS = {
    "latin": [(0x0041, 0x024F), (0x1E00, 0x1EFF)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F)],
    "armenian": [(0x0530, 0x058F)],
    "hebrew": [(0x0590, 0x05FF)],
    "arabic": [(0x0600, 0x077F), (0x08A0, 0x08FF)],
    "devanagari": [(0x0900, 0x097F)],
    "bengali": [(0x0980, 0x09FF)],
    "tamil": [(0x0B80, 0x0BFF)],
    "thai": [(0x0E00, 0x0E7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}


#: Letters a piece has at most; fewer where words stand without blanks.
PIECE, PIECES = 40, {"han": 8, "kana": 8, "thai": 8}


#: Marks that combine with letters of any script, and joiners.
ACCENTS = "\u0300-\u036f\u200c\u200d"


def _pattern() -> re.Pattern:
    """Runs of letters of one script and their marks, cut into pieces that begin with a letter and end before one."""
    named, every = [], ""
    for name, ranges in SCRIPTS.items():
        letters = _ranges(ranges, lambda c: c.isalpha() or re.match(r"[^\W\d_]", c))
        marks = _ranges(ranges, _is_mark) + ACCENTS
        every += letters
        named.append(f"[{letters}][{letters}{marks}]{{0,{PIECES.get(name, PIECE) - 1}}}[{marks}]*+")
    other = f"(?:(?![{every}])[^\\W\\d_])"
    return re.compile("|".join(named) + f"|{other}(?:{other}|[{ACCENTS}]){{0,{PIECE - 1}}}")


def _is_mark(c: str) -> bool:
    return unicodedata.category(c).startswith("M")


def _ranges(ranges: list[tuple[int, int]], holds) -> str:
    """The code points of ``ranges`` for which ``holds``, as a regular expression's class."""
    out = ""
    for first, last in ranges:
        start = None
        for p in range(first, last + 2):
            inside = p <= last and holds(chr(p))
            if inside and start is None:
                start = p
            elif not inside and start is not None:
                out += f"{re.escape(chr(start))}-{re.escape(chr(p - 1))}"
                start = None
    return out


WORD = _pattern()


def script(word: str) -> str:
    if word[0].isascii():
        return "latin"
    point = ord(word[0])
    for name, ranges in SCRIPTS.items():
        if any(lo <= point <= hi for lo, hi in ranges):
            return name
    return "other"


def grams(word: str) -> list[str]:
    """Letters, pairs and triples of a word with its ends marked."""
    w = f"^{word}$"
    return [*w[1:-1], *map("".join, zip(w, w[1:])), *map("".join, zip(w, w[1:], w[2:]))]


def letters_of(token: str) -> str:
    """The letters and marks of a token; nothing if it has no letter."""
    if token.isalpha():
        return token
    kept = "".join(c for c in token if c.isalpha() or _is_mark(c))
    return kept if any(map(str.isalpha, kept)) else ""


@dataclass
class Model:
    langs: list[str]
    default: str
    index: Index
    matrix: np.ndarray  # log probability of each n-gram by language; the last row is for n-grams not learnt
    scripts: dict[str, np.ndarray]

    def words(self, ws: list[str]) -> np.ndarray:
        """Log scores of words; languages that don't use a word's script are out of reach, an unknown script tells nothing."""
        parts = [grams(w) for w in ws]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        rows = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(ends[-1]))
        sums = np.add.reduceat(self.matrix[rows], ends - sizes, axis=0) / ORDERS
        named = [script(w) for w in ws]
        out = np.zeros_like(sums)  # a script of no learnt language tells nothing
        for s in set(named) & self.scripts.keys():
            mine = np.fromiter((n == s for n in named), bool, len(named))
            out[mine] = np.where(self.scripts[s], sums[mine], -1e6)
        return out


class Index(dict):
    """Rows of n-grams; the last row is for those not learnt."""

    def __missing__(self, key: str) -> int:
        return len(self)


def counts(docs: DataFrame) -> DataFrame:
    """``(lang, kind, item, n)``: n-grams, scripts and documents of labelled rows ``(text, lang)``."""

    def make():
        forget()

        def run(texts, langs):
            by: Counter = Counter()
            tokens: dict[str, Counter] = {}
            for text, lang in zip(texts, langs, strict=True):
                by[lang, "doc", ""] += 1
                tokens.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            for lang, found in tokens.items():
                for token, n in found.items():
                    if w := letters_of(token):
                        by[lang, "script", script(w)] += n
                        for g in grams(w):
                            by[lang, "gram", g] += n
            keys = list(by)
            return {"lang": [k[0] for k in keys], "kind": [k[1] for k in keys], "item": [k[2] for k in keys], "n": list(by.values())}

        return run

    part = map_columns(docs.select("text", "lang"), "lang string, kind string, item string, n long", make)
    return part.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fit on the rows of ``docs`` with text and lang; see the module's bounds."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("id is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("id"))
    cut = rows.select("h").orderBy("h").limit(sample).agg(F.max("h"), F.count("*")).first()  # ids alone are read
    picked = rows.where(F.col("h") <= F.lit(cut[0]))
    if cut[1] == sample and (held := picked.count()) > 2 * sample:  # one id on many rows
        picked = picked.where(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(held)) < sample)
    picked = picked.where("text is not null")
    each = max(1, features // max(1, picked.select("lang").distinct().count()))
    ranked = counts(picked).withColumn("r", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")))
    got = ranked.where((F.col("kind") != "gram") | (F.col("r") <= each)).orderBy("lang", "kind", "r").collect()  # at most `features` n-grams
    docs_of = {r.lang: r.n for r in got if r.kind == "doc"}
    langs = sorted(docs_of)
    at = {x: i for i, x in enumerate(langs)}
    table: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    totals = np.ones((ORDERS + 1, len(langs)))
    for r in got:
        if r.kind == "gram":
            table.setdefault(r["item"], np.zeros(len(langs)))[at[r.lang]] += r.n
            totals[len(r["item"]), at[r.lang]] += r.n
        elif r.kind == "script":
            scripts.setdefault(r["item"], np.zeros(len(langs)))[at[r.lang]] += r.n
    used = sum(scripts.values(), np.zeros(len(langs)))
    scripts = {k: m for k, v in scripts.items() if (m := v > 0.01 * used).any()}
    rows = [np.log((v + 0.5) / (totals[len(g)] + 0.5 * 1e4)) for g, v in table.items()]
    # An n-gram nobody has seen tells nothing; one value for all languages.
    rows.append(np.full(len(langs), float(np.log(0.5 / (totals.max() + 5e3))) if langs else 0.0))
    default = min(langs, key=lambda x: (-docs_of[x], x), default="und")
    return Model(langs, default, Index((g, i) for i, g in enumerate(table)), np.array(rows, np.float32), scripts)


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word, for many documents at once: ``scores`` (words, langs), documents in blocks.

    One step handles the t-th word of all documents that have one, longest documents first.
    """
    order = np.argsort(-sizes, kind="stable")
    first, length = starts[order], sizes[order]
    back = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int32)
    label = np.zeros(len(scores), np.int64)
    n = int((length > 0).sum())
    best = np.zeros((n, scores.shape[1]))
    at = np.arange(scores.shape[1])
    alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    for t, m in enumerate(alive):
        here = first[:m] + t
        if t:
            top = best[:m].argmax(1)
            away = best[np.arange(m), top] - switch
            stay = best[:m] >= away[:, None]
            back[here] = np.where(stay, at, top[:, None])
            best[:m] = np.where(stay, best[:m], away[:, None])
        best[:m] += scores[here]
        ends = np.flatnonzero(length[:m] == t + 1)
        label[here[ends]] = best[ends].argmax(1)
    for t in range(len(alive) - 1, 0, -1):
        here = first[: alive[t]] + t
        label[here - 1] = back[here, label[here]]
    return label


class _Numbers(dict):
    """Numbers new keys as they come."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Labeller:
    """Labels documents under a model; word scores are cached up to ``CACHE`` words."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.ids = _Numbers()
        self.matrix, self.size, self.known = np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int32), np.zeros(0, bool)

    def _number(self, tokens: list[str]) -> np.ndarray:
        """Numbers of words in the order of ``matrix``, which ``_score`` then brings up to date."""
        return np.fromiter(map(self.ids.__getitem__, tokens), np.int32, len(tokens))

    def _score(self) -> None:
        fresh, model = list(itertools.islice(reversed(self.ids), len(self.ids) - len(self.size)))[::-1], self.model
        for at in range(0, len(fresh), 20_000):
            words = [letters_of(t) for t in fresh[at : at + 20_000]]
            rows = np.zeros((len(words), len(model.langs)), np.float32)
            some = [i for i, w in enumerate(words) if w]
            if some and model.langs:
                rows[some] = model.words([words[i] for i in some])
            self.matrix = np.concatenate([self.matrix, rows])
            self.size = np.concatenate([self.size, np.array([sum(map(str.isalpha, w)) for w in words], np.int32)])
            self.known = np.concatenate([self.known, np.array([bool(w) and script(w) in model.scripts for w in words], bool)])

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """For each text: language, score and spans ``(start, end, lang)`` of code points."""
        words = []
        for t in texts:
            low = t.lower() if t else ""
            words.append([(m.start(), m.group()) for m in WORD.finditer(low if t and len(low) == len(t) else t or "")])
        return self._label(texts, words)

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float, int]]:
        """For each text: language, score and number of spans; some hundred thousand words at a time."""
        out, part, held = [], [], 0
        for t in texts:
            part.append(self._number(WORD.findall(t.lower())) if t else np.zeros(0, np.int32))
            held += len(part[-1])
            if held >= WORDS:
                out += self._predict(part)
                part, held = [], 0
        return out + self._predict(part)

    def _predict(self, part: list[np.ndarray]) -> list[tuple[str, float, int]]:
        if not part:
            return []
        ids, found, sizes = self._run(part)
        out = [(*self._judge(i, lab), 1 + int((lab[1:] != lab[:-1]).sum()) if len(lab) else 0) for i, lab in self._split(ids, found, sizes)]
        if len(self.ids) > CACHE:
            self._forget()
        return out

    def _run(self, numbered: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._score()
        sizes = np.array([len(n) for n in numbered], np.int64)
        ids = np.concatenate([*numbered, np.zeros(0, np.int32)])
        if not self.model.langs or not len(ids):
            return ids, np.zeros(len(ids), np.int64), sizes
        return ids, viterbi(self.matrix[ids], np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes), sizes

    @staticmethod
    def _split(ids, found, sizes):
        ends = np.cumsum(sizes)[:-1]
        return zip(np.split(ids, ends), np.split(found, ends), strict=True)

    def _judge(self, ids, labels) -> tuple[str, float]:
        size = self.size[ids] if len(ids) else np.zeros(0)
        total = size.sum()
        if not total or not self.model.langs:
            return "und", 0.0
        held = np.bincount(labels, size * self.known[ids], len(self.model.langs))
        if not held.sum():
            return self.model.default, 0.0
        return self.model.langs[int(held.argmax())], round(float(held.max() / total), 6)

    def _label(self, texts, words):
        ids, found, sizes = self._run([self._number([w for _, w in ws]) for ws in words])
        out = []
        for ws, (i, lab) in zip(words, self._split(ids, found, sizes), strict=True):
            spans: list[tuple[int, int, str]] = []
            for (start, w), k, word in zip(ws, lab, i, strict=True):
                if not self.model.langs or not self.known[word]:
                    continue
                lang = self.model.langs[k]
                if spans and spans[-1][2] == lang:
                    spans[-1] = (spans[-1][0], start + len(w), lang)
                else:
                    spans.append((start, start + len(w), lang))
            out.append((*self._judge(i, lab), spans))
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, n_spans)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES

    def make():
        labeller = _labeller(shared)

        def run(ids, texts):
            out = labeller.predict(texts)
            return {"doc_id": ids, "lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "n_spans": [x[2] for x in out]}

        return run

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, n_spans int", make)


def keep_recognised(docs: DataFrame, model: Model, least: float = 0.25) -> DataFrame:
    """The rows whose text has a language that holds at least ``least`` of its letters, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller = _labeller(shared)
        return lambda texts: [lang != "und" and score >= least for lang, score, _ in labeller.predict(texts)]

    recognised = map_values("boolean", make)
    return docs.where(recognised(F.col("text").cast("string")))


def _labeller(shared) -> Labeller:
    """One labeller for each model and Python worker, so that tasks share its cache."""
    return only(("labeller", id(shared.value)), lambda: Labeller(shared.value))
