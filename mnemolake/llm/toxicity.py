"""Toxicity: a weighted lexicon matched by Aho-Corasick, normalised by length, with exception phrases.

Texts are folded first: look-alike letters of other scripts become Latin ones, accents go, digits and signs that
stand for letters become those letters, everything else between words becomes one space. The lexicon is learned
from labelled documents: whole words, and beginnings of words, that stand in toxic documents far more often than in
others, each with its log odds as weight. A lexicon word and a neighbour that stand together in clean documents alone
form an exception phrase: it cancels the match, in learning the odds as well as in scoring. One automaton finds entries and exceptions in one pass over a text of any length.
The score is a logistic function of the weight found in all and per word.

Learning takes at most ``LEARN_ROWS`` labelled documents, those of lowest hash; scoring reads every whole text.

Defined results: a missing text is an empty one, and a text without match has the score of no evidence; documents
without doc_id are never learned from; conflicting or repeated labels of a document count as toxic if any is;
without a toxic or without a clean label the lexicon is empty and every score is the share of toxic labels (0 if
there is none). Labels, language, source and doc_id are no part of a score. Further columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import slices, small_batches, text_of

#: Bounds of the learned model: labelled documents read, entries and exceptions kept, support an entry needs.
LEARN_ROWS = 12_000
ENTRIES = 4_000
EXCEPTIONS = 1_000
SUPPORT = 5
MIN_ODDS = 2.0
#: How many times more documents a beginning must reach than the longer entries it stands for.
BROADER = 1.25
LEANING = 0.7
EXCEPTION_SUPPORT = 8
SHORTEST, LONGEST = 4, 9
CUT = 0.3

# Letters that look like Latin ones, and digits or signs written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ɑ": "a", "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "2": "z", "6": "g", "@": "a", "$": "s"}


class _Fold(dict):
    """Translation table, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if unicodedata.category(char) in ("Mn", "Cf"):  # combining accents, invisible characters
            out = ""
        else:
            plain = unicodedata.normalize("NFKD", char).lower()
            plain = "".join(c for c in plain if not unicodedata.combining(c))
            plain = "".join(LOOKALIKES.get(c, DIGITS.get(c, c)) for c in plain)
            out = "".join(c if c.isalpha() else " " for c in plain) or " "
        self[code] = out
        return out


FOLD = _Fold()


def folded(text: str) -> str:
    """Folded words, one space before and after each."""
    return " " + " ".join(text.translate(FOLD).split()) + " "


def _grams(word: str) -> Iterator[str]:
    """Lexicon candidates of one folded word: the word itself, and its beginnings."""
    yield f" {word} "
    for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
        yield f" {word[:k]}"


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): documents of one task that hold each gram."""
    bad: Counter[str] = Counter()
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            bad.update({g for w in set(folded(text).split()) for g in _grams(w)})
    yield pa.RecordBatch.from_arrays([pa.array(list(bad), pa.string()), pa.array(list(bad.values()), pa.int64())], ["gram", "n"])


def _automaton(entries: dict[str, object]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for text, value in entries.items():
        found.add_word(text, value)
    if entries:
        found.make_automaton()
    return found


def _matched(batches: Iterator[pa.RecordBatch], grams: list[str], phrases: list[str]) -> Iterator[pa.RecordBatch]:
    """(gram, n): documents of one task that hold each known gram outside the phrases."""
    matcher, n = _automaton({g: (len(g), k) for k, g in enumerate(grams)} | {p: (len(p), None) for p in phrases}), np.zeros(len(grams), np.int64)
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            n[list({k for _, k in unspared(folded(text), matcher)})] += 1
    seen = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array([grams[i] for i in seen], pa.string()), pa.array(n[seen])], ["gram", "n"])


@dataclass
class Model:
    entries: dict[str, float]
    exceptions: tuple[str, ...]
    beta: tuple[float, ...]  # constant, weight found in all, weight per word

    def matcher(self) -> ahocorasick.Automaton:
        return _automaton({g: (len(g), w) for g, w in self.entries.items()} | {g: (len(g), None) for g in self.exceptions})

    def score(self, total: float, words: int) -> float:
        x = self.beta[0] + self.beta[1] * math.log1p(total) + self.beta[2] * total / (words + 20)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def unspared(flat: str, matcher: ahocorasick.Automaton) -> list[tuple[int, object]]:
    """(start, value) of each match in a folded text that no exception phrase (value None) covers."""
    if not len(matcher):
        return []
    hits: list[tuple[int, object]] = []
    spared: list[tuple[int, int]] = []
    for end, (size, value) in matcher.iter(flat):
        if value is None:
            spared.append((end - size + 1, end))
        else:
            hits.append((end - size + 1, value))
    if not spared:
        return hits
    # phrases as disjoint stretches: one look-up per match, however many phrases a text holds
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spared):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [h for h in hits if not (i := bisect_right(starts, h[0])) or h[0] >= ends[i - 1]]


def weigh(text: str, matcher: ahocorasick.Automaton) -> tuple[float, int, int]:
    """(weight found, matches, words): each word counts its heaviest entry, unless an exception phrase covers it."""
    flat = folded(text)
    words = flat.count(" ") - 1 if len(flat) > 2 else 0
    best: dict[int, float] = {}
    for start, weight in unspared(flat, matcher):
        if weight > best.get(start, 0.0):
            best[start] = weight
    return sum(best.values()), len(best), words


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the learning rows: labelled documents outside the held-out quarter, lowest hashes first."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(known)).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(LEARN_ROWS)
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return texts.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])  # ``LEARN_ROWS`` rows of two numbers at most


def held_out(docs: DataFrame):
    return F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 4 == 2, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; rows are the learning sample's."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    beta = np.zeros(z.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * x.shape[1]]) * len(x) / 100
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T * (p * (1 - p)) @ z + ridge, z.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), *(float(b / s) for b, s in zip(beta[1:], scale, strict=True))


def _phrases(batches: Iterator[pa.RecordBatch], entries: list[str]) -> Iterator[pa.RecordBatch]:
    """(phrase, toxic, n): documents of each kind that hold a lexicon word together with a neighbour."""
    automaton, n = _automaton({g: len(g) for g in entries}), Counter()
    for batch in slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            flat, found = folded(text), set()
            for end, size in automaton.iter(flat) if len(automaton) else ():
                start = end - size + 1
                stop = flat.index(" ", start + 1)
                after, before = flat.find(" ", stop + 1), flat.rfind(" ", 0, start)
                if after > 0:
                    found.add(flat[start : after + 1])
                if before >= 0:
                    found.add(flat[before : stop + 1])
            n.update((p, toxic) for p in found)
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in n], pa.string()), pa.array([t for _, t in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["phrase", "toxic", "n"])


def _holders(sample: DataFrame, toxic: int, grams: list[str], phrases: list[str]) -> dict[str, int]:
    """Learning documents of one kind that hold each gram outside the phrases."""
    counts = sample.where(F.col("toxic") == toxic).select("text").mapInArrow(lambda b: _matched(b, grams, phrases), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counts.collect()}


def _odds(bad: dict[str, int], good: dict[str, int], n_bad: int, n_good: int) -> dict[str, float]:
    return {g: math.log((b + 0.5) / (n_bad + 1) / ((good.get(g, 0) + 0.5) / (n_good + 1))) for g, b in bad.items()}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The lexicon, its exception phrases and the three numbers of the score."""
    small_batches(docs)
    sample = labelled(docs, labels).withColumn("toxic", (F.col("toxic") > 0).cast("int")).persist()
    try:
        size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        n_bad, n_good = size.get(1, 0), size.get(0, 0)
        if not n_bad or not n_good:
            share = n_bad / max(1, n_bad + n_good)
            return Model({}, (), (math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0))
        texts = sample.where("toxic = 1").select("text")
        bad = texts.mapInArrow(_gram_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("bad")).where(F.col("bad") >= SUPPORT)
        bad = {r["gram"]: r["bad"] for r in bad.orderBy(F.desc("bad"), "gram").limit(25 * ENTRIES).collect()}
        grams = list(bad)
        # words that lean to toxic documents at all, then the phrases that make them harmless, then their odds outside those
        lean = _odds(bad, _holders(sample, 0, list(bad), []), n_bad, n_good)
        leaning = sorted((g for g in lean if lean[g] > LEANING), key=lambda g: (-lean[g] * math.sqrt(bad[g]), g))[:ENTRIES]
        near = sample.select("text", "toxic").mapInArrow(lambda b: _phrases(b, leaning), "phrase string, toxic int, n long").groupBy("phrase", "toxic").agg(F.sum("n").alias("n"))
        wide = near.groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"))
        likely = wide.where((F.col("good") >= EXCEPTION_SUPPORT) & (F.col("good") * n_bad > F.col("bad") * n_good * 20)).orderBy(F.desc("good"), "phrase").limit(EXCEPTIONS)
        phrases = [r["phrase"] for r in likely.collect()]
        bad = _holders(sample, 1, leaning, phrases)
        odds = _odds(bad, _holders(sample, 0, leaning, phrases), n_bad, n_good)
        kept = sorted((g for g in odds if odds[g] > MIN_ODDS and bad[g] >= SUPPORT), key=lambda g: (-odds[g] * math.sqrt(bad[g]), g))
        # a beginning is an entry only where it reaches clearly more documents than any one longer entry it begins
        reach: dict[str, int] = {}
        for g in kept:
            for k in range(SHORTEST + 1, len(g)):
                reach[g[:k]] = max(reach.get(g[:k], 0), bad[g])
        kept = [g for g in kept if bad[g] > BROADER * reach.get(g, 0)]
        # and a longer entry says nothing new where a kept beginning weighs as much
        chosen = set(kept)
        entries = {g: odds[g] for g in kept if not any(g[:k] in chosen and odds[g[:k]] >= odds[g] - 0.1 for k in range(SHORTEST + 1, len(g)))}
        phrases = [p for p in phrases if any(e in p for e in entries)]
        plain = Model(entries, tuple(phrases), (0.0, 0.0, 0.0))
        seen = sample.select(F.lit(0).cast("bigint").alias("doc_id"), "text", "toxic").mapInArrow(lambda b: _weighed(b, plain, ["toxic"]), "doc_id long, weight double, matches int, words long, score double, toxic int").select("weight", "words", "toxic").toPandas()
        x = np.column_stack([np.log1p(seen["weight"]), seen["weight"] / (seen["words"] + 20)])
        return Model(entries, tuple(phrases), _logistic(x, seen["toxic"].to_numpy(float)))
    finally:
        sample.unpersist()


def _weighed(batches: Iterator[pa.RecordBatch], model: Model, more: list[str]) -> Iterator[pa.RecordBatch]:
    matcher = model.matcher()
    for batch in slices(batches):
        found = [weigh(t, matcher) for t in batch.column("text").to_pylist()]
        score = [model.score(w, n) for w, _, n in found]
        columns = [batch.column("doc_id"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64()), pa.array(score, pa.float64())]
        yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in more)], ["doc_id", "weight", "matches", "words", "score", *more])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, weight, matches, words, score) of every whole text."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``ENTRIES`` and ``EXCEPTIONS`` short strings at most
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(lambda b: _weighed(b, shared.value, []), "doc_id long, weight double, matches int, words long, score double")


def accepted(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that score ``cut`` or more, all columns as they were."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text):
        matcher = shared.value.matcher()
        return text.map(lambda t: shared.value.score(*weigh(t or "", matcher)[::2]))

    return docs.where(score(text_of(docs)) < cut)
