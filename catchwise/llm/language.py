"""Language of every span and text: script ranges, per-word scores, Viterbi with a switching penalty.

Words are runs of letters in lower case. The script of a word's first letter leaves only the languages whose training
words use that script. A word's score for a language is its log share among the candidates, from the language's word
counts and, for rarer words, from its letter trigrams; one word's evidence is bounded by ``FLOOR``. Viterbi decoding
over the words of a text, with ``SWITCH`` taken off for each change of language, labels spans; the text's language is
the one with most letters, its score their share. All texts of a block are decoded in step, longest first.

The model is counted by Spark on about ``SAMPLE`` texts a language, picked by the hash of their id (a bound on the fit
only); every language that occurs in the training rows is learned. Null text, and text without a letter, is
``und`` with score 0. With no training row every text is ``und``. Repeated rows give repeated results; input columns
named like an added column are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwise.llm.common import map_text

SAMPLE, SAMPLE_BYTES = 1200, 32_768
#: Words and trigrams that the model keeps, by count (parameters of the fit).
VOCABULARY, GRAMS = 30_000, 60_000
SWITCH, FLOOR = 6.0, -5.0
#: A language uses a script that so many of its training words are written in.
SCRIPT_SHARE = 0.005
UNDETERMINED = "und"
#: Words remembered by a worker, and letters decoded at once (speed parameters; they never change a result).
REMEMBERED, BLOCK = 400_000, 4_000_000

WORDS = re.compile(r"[^\W\d_]+")

#: First code points of ranges and their scripts.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Other"), (0x20000, "Han"),
]
_STARTS = [s for s, _ in SCRIPTS]


def script(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray  # (words, languages), log shares among all languages
    grams: dict[str, int]
    gram_scores: np.ndarray  # (grams + 1, languages), log share of a gram in a language; the last row is for unknown ones
    scripts: dict[str, np.ndarray]  # script: which languages use it


def examples(docs: DataFrame, lang: str, keep: Column) -> DataFrame:
    """(lang, text) of the training sample."""
    known = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & keep).select("doc_id", F.col(lang).cast("string").alias("_lang"), "text")
    rates = known.groupBy("_lang").agg((F.lit(float(SAMPLE)) / F.count("*")).alias("_rate"))  # a row a language
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 11) / F.lit(float(1 << 53))
    own = known.join(F.broadcast(rates), "_lang").filter((uniform < F.col("_rate")) & (F.octet_length("text") <= SAMPLE_BYTES))
    return own.groupBy("doc_id", "_lang").agg(F.min("text").alias("text"))


def train(docs: DataFrame, lang: str, keep: Column) -> Model:
    # a row for each word; the sample bounds all counts
    words = examples(docs, lang, keep).select("_lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = words.groupBy("_lang", "word").agg(F.count("*").alias("n")).toPandas()
    languages = sorted(counts["_lang"].unique())
    if not languages:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((1, 0)), {})
    at = {x: i for i, x in enumerate(languages)}
    of_words: dict[str, np.ndarray] = {}
    of_grams: dict[str, np.ndarray] = {}
    of_scripts: dict[str, np.ndarray] = {}
    zero = np.zeros(len(languages))
    for language, word, n in counts.itertuples(index=False):
        i = at[language]
        of_words.setdefault(word, zero.copy())[i] += n
        of_scripts.setdefault(script(word), zero.copy())[i] += n
        for g in trigrams(word):
            of_grams.setdefault(g, zero.copy())[i] += n
    totals = sum(of_scripts.values())
    most = lambda d, k: sorted(d, key=lambda w: (-d[w].sum(), w))[:k]
    words_kept = [w for w in most(of_words, VOCABULARY) if of_words[w].sum() >= 3]
    grams_kept = most(of_grams, GRAMS)
    by_word = np.array([of_words[w] for w in words_kept]).reshape(-1, len(languages))
    by_gram = np.array([of_grams[g] for g in grams_kept] + [zero]).reshape(-1, len(languages))
    gram_totals = sum(of_grams.values())
    return Model(
        languages, {w: i for i, w in enumerate(words_kept)}, shares(np.log((by_word + 0.1) / (totals + 0.1 * len(of_words)))),
        {g: i for i, g in enumerate(grams_kept)}, np.log((by_gram + 0.2) / (gram_totals + 0.2 * len(of_grams))),
        {s: n >= SCRIPT_SHARE * totals for s, n in of_scripts.items()})


def trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def shares(logs: np.ndarray) -> np.ndarray:
    """Log shares of each row's languages, not under ``FLOOR``."""
    top = logs - logs.max(axis=1, keepdims=True) if logs.size else logs
    return np.maximum(top - np.log(np.exp(top).sum(axis=1, keepdims=True)), FLOOR) if logs.size else logs


class Decoder:
    """Word scores of a worker, and Viterbi over blocks of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.empty((1024, len(self.model.languages)), dtype=np.float32)
        self.letters = np.empty(1024, dtype=np.int32)

    def learn(self, new: list[str]) -> None:
        m = self.model
        unknown, none = len(m.grams), np.ones(len(m.languages), dtype=bool)
        spelled = [[m.grams.get(g, unknown) for g in trigrams(w)] for w in new]
        first = np.cumsum([0, *map(len, spelled)])[:-1]
        scores = shares(np.add.reduceat(m.gram_scores[np.concatenate(spelled)], first))
        for i, w in enumerate(new):
            if (known := m.words.get(w)) is not None:
                scores[i] = m.word_scores[known]
            used = m.scripts.get(script(w), none)
            scores[i][~used] = 2 * FLOOR
        n = len(self.ids)
        if n + len(new) > len(self.scores):
            grow = max(len(self.scores), len(new))
            self.scores = np.concatenate([self.scores, np.empty((grow, self.scores.shape[1]), dtype=np.float32)])
            self.letters = np.concatenate([self.letters, np.empty(grow, dtype=np.int32)])
        self.scores[n : n + len(new)] = scores
        self.letters[n : n + len(new)] = [sum(map(str.isalpha, w)) for w in new]
        self.ids.update(zip(new, range(n, n + len(new)), strict=True))

    def numbers(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.ids]
        if new:
            self.learn(sorted(new))
        return np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))

    def viterbi(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The language of every word of every text; texts are walked in step, so only those that reach a step are touched."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order])
        flat, start = np.concatenate([texts[i] for i in order]), np.cumsum([0, *sizes])[:-1]
        reach = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts longer than t
        now = np.zeros((len(order), self.scores.shape[1]), dtype=np.float32)
        came, moved = [], []
        for t in range(sizes[0]):
            n = reach[t]
            stay = now[:n]
            best = stay.argmax(axis=1)
            top = stay[np.arange(n), best][:, None]
            came.append(best.astype(np.int16))
            moved.append(stay < top - SWITCH)
            now[:n] = np.maximum(stay - top, -SWITCH) + self.scores[flat[start[:n] + t]]
        at = now.argmax(axis=1)
        out = np.empty(len(flat), dtype=np.int16)
        for t in range(sizes[0] - 1, -1, -1):
            n = reach[t]
            out[start[:n] + t] = at[:n]
            at[:n] = np.where(moved[t][np.arange(n), at[:n]], came[t], at[:n])
        found: list[np.ndarray] = [np.empty(0)] * len(order)
        for i, s, n in zip(order, start, sizes, strict=True):
            found[i] = out[s : s + n]
        return found

    def label(self, texts: list[str | None]) -> list[tuple[str, float, str]]:
        """Language, score and spans (``language:start:end`` in code points) of each text."""
        out: list[tuple[str, float, str]] = [(UNDETERMINED, 0.0, "")] * len(texts)
        held: list[tuple[int, np.ndarray]] = []
        letters = 0

        def flush() -> None:
            for (i, numbers), path in zip(held, self.viterbi([n for _, n in held]), strict=True):
                weight = np.bincount(path, self.letters[numbers], minlength=len(self.model.languages))
                if not weight.any():  # digits of other kinds count as parts of words, not as letters
                    continue
                best = int(weight.argmax())
                out[i] = (self.model.languages[best], float(weight[best] / weight.sum()), self.spans(texts[i], path))

        for i, t in enumerate(texts):
            words = WORDS.findall(t.lower()) if t and self.model.languages else []
            if not words:
                continue
            held.append((i, self.numbers(words)))
            letters += len(t)
            if letters >= BLOCK or len(self.ids) >= REMEMBERED:
                flush()
                held, letters = [], 0
                if len(self.ids) >= REMEMBERED:
                    self.forget()
        if held:
            flush()
        return out

    def spans(self, text: str, path: np.ndarray) -> str:
        change = np.flatnonzero(np.diff(path)) + 1
        if not len(change):
            return f"{self.model.languages[path[0]]}:0:{len(text)}"
        # word starts are needed only in mixed texts; lower-casing may change lengths, so words are found again
        begin = [m.start() for m in WORDS.finditer(text)]
        if len(begin) != len(path):
            lower = text.lower()
            begin = [m.start() for m in WORDS.finditer(lower)]
        cuts = [0, *(begin[i] for i in change), len(text)]
        return ",".join(f"{self.model.languages[path[max(0, i)]]}:{a}:{b}" for i, a, b in zip([0, *change], cuts[:-1], cuts[1:], strict=True))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``lang_spans``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    made: list[Decoder] = []

    def run(texts: list[str | None]) -> list:
        if not made:
            made.append(Decoder(shared.value))
        rows = made[0].label(texts)
        return list(zip(*rows, strict=True)) if rows else [[]] * 3

    return map_text(df, [text], run, "lang_pred string, score double, lang_spans string", rows=4096)
