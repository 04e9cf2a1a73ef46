"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts
and digits or signs that stand for letters to plain ones, drops invisible
characters and turns each run of the rest into one space, so phrases match
across punctuation. The lexicon is learned: beginnings of words (and short
words whole) whose log odds to stand in toxic documents are high beyond chance,
each as long as it can be without losing documents. Phrases around a term that
stand only in clean documents are exceptions and take its weight back. The sum
of weights goes through a logistic curve twice: divided by length, which tells
an insult from a slip in a long text, and as it is, since the same words do not
become harmless because more text follows. Which counts how much is learned.

The fit uses at most ``BOUND`` labelled rows, chosen by hash, and keeps every
term that they support; a word longer than ``LONGEST`` letters is known by its
first ``LONGEST``. Defined results: a null or empty text scores as one
without terms; repeated rows score alike; without labelled rows of both kinds
the lexicon is empty and every score is the share of toxic rows; an empty table
gives an empty result; other columns pass through ``classify`` unless named as
an output.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_arrow

BOUND = 8000
#: Letters of a beginning (words with fewer are taken whole), least log odds of a term.
SHORTEST, LONGEST, LEAST_ODDS = 4, 14, 2.5
#: Least log-likelihood ratio of a term against chance: 19.5 is passed by one in a hundred thousand features that mean nothing, whatever the sample's size.
LEAST_RATIO = 19.5

_LOOKALIKES = dict(zip("аеорсухіјѕԁһпгтмвкοαερτυνικηζᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢıłøđ", "aeopcyxijsdhnrtmbkoaeptuvikhzabcdeghijklmnoprstuvwyzilod", strict=True))
_STANDINS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_INVISIBLE = [0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF, *range(0x300, 0x370)]


class _Fold(dict):
    """Code point to what it folds to; unknown ones are worked out once."""

    def __missing__(self, c: int):
        x = chr(c)
        self[c] = x if x.isalnum() else " "
        return self[c]


_FOLD = _Fold({c: None for c in _INVISIBLE} | {ord(a): b for a, b in _LOOKALIKES.items()} | {ord(a): b for a, b in _STANDINS.items()})


def fold(text: str) -> str:
    """Folded words, one space before, between and after them."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    words = text.lower().translate(_FOLD).split()
    return f" {' '.join(words)} " if words else " "


def _terms_of(word: str) -> list[str]:
    """What a lexicon may hold of a word: its beginnings, or a short word itself, ended by a space."""
    return [word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)] or [word + " "]


def _beginnings(text: str) -> set[str]:
    return {t for w in set(fold(text).split()) for t in _terms_of(w)}


def _counted(sample: DataFrame, features) -> DataFrame:
    """(feature, pos, neg): documents with it, by label; counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(pos | neg)
            cols = [pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())]
            pos.clear()
            neg.clear()
            return pa.RecordBatch.from_arrays(cols, names=["feature", "pos", "neg"])

        for batch in batches:
            for t, y in zip(batch["text"], batch["label"].to_pylist(), strict=True):
                (pos if y else neg).update(features(t.as_py() or ""))
                if len(pos) + len(neg) > 1_000_000:
                    yield out()
        yield out()

    made = map_arrow(sample.select("text", "label"), run, "feature string, pos long, neg long")
    return made.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Terms of a lexicon from beginning to (log odds, toxic documents)."""
    longer: dict[str, int] = {}
    for f, (_, n) in found.items():
        longer[f[:-1]] = max(n, longer.get(f[:-1], 0))
    kept: dict[str, float] = {}
    for f in sorted(found, key=lambda f: (len(f), f)):
        odds, n = found[f]
        if longer.get(f, 0) >= 0.9 * n:  # a longer beginning says the same
            continue
        if any(kept.get(f[:k], -9.0) >= odds - 1.5 for k in range(SHORTEST, len(f))):
            continue
        kept[f] = odds
    return kept


class Model:
    """Lexicon, exceptions and the curve."""

    def __init__(self, terms: dict[str, float], exceptions: dict[str, float], curve: tuple[float, ...] = (0.0, 0.0, 0.0)):
        self.terms, self.exceptions, self.curve, self._machine = terms, exceptions, curve, None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    @property
    def machine(self):
        if self._machine is None and (self.terms or self.exceptions):
            self._machine = ahocorasick.Automaton()
            for t, w in self.terms.items():
                self._machine.add_word(" " + t, w)
            for t, w in self.exceptions.items():
                self._machine.add_word(" " + t + " ", -w)
            self._machine.make_automaton()
        return self._machine

    def measure(self, text: str) -> tuple[float, float]:
        """Sum of weights of the terms, and log of the words."""
        folded = fold(text)
        total = sum(w for _, w in self.machine.iter(folded)) if self.machine else 0.0
        return max(0.0, total), math.log1p(folded.count(" "))

    def score(self, text: str) -> float:
        total, length = self.measure(text)
        a, b, c = self.curve
        z = a + b * math.log1p(total) + c * math.log1p(100 * total / math.exp(length))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _around(terms: dict[str, float]):
    """Features: a term's word with the word before or after."""

    def features(text: str) -> set[str]:
        words, out = fold(text).split(), set()
        for i, w in enumerate(words):
            if any(t in terms for t in _terms_of(w)):
                if i:
                    out.add(f"{words[i - 1]} {w}")
                if i + 1 < len(words):
                    out.add(f"{w} {words[i + 1]}")
        return out

    return features


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(100 * x[:, 0] / np.exp(x[:, 1]))])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.5, 0.5])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - np.array([1e-3, 0.5, 0.5]) * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """From a bounded frame of (id, text, label, weight)."""
    # Copies are one witness.
    sample = sample.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("text"), "label").agg(F.sum("weight").alias("weight"))
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        share = 0.5 if not n else float(1 in n)
        return Model({}, {}, (math.log((share + 0.01) / (1.01 - share)), 0.0, 0.0))
    rate = lambda k: (F.col("pos" if k else "neg") + 0.5) / F.lit(n[k] + 1.0)
    odds = (F.log(rate(1)) - F.log(rate(0))).alias("odds")
    # Documents with the feature of either kind against those that chance would give.
    both, share = F.col("pos") + F.col("neg"), n[1] / (n[0] + n[1])
    part = lambda k, q: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (both * q))).otherwise(0.0)
    ratio = 2 * (part("pos", share) + part("neg", 1 - share))
    rows = _counted(sample, _beginnings).where(ratio >= LEAST_RATIO).select("feature", "pos", odds).where(F.col("odds") >= LEAST_ODDS).collect()
    terms = choose({r["feature"]: (r["odds"], r["pos"]) for r in rows})
    exceptions: dict[str, float] = {}
    if terms:
        for r in _counted(sample, _around(terms)).where("pos = 0").where(ratio >= LEAST_RATIO).collect():
            exceptions[r["feature"]] = sum(terms[t] for w in r["feature"].split() for t in _terms_of(w) if t in terms)
    model = Model(terms, exceptions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.measure(t.as_py() or "") for t in batch["text"]]
            cols = [pa.array([g[i] for g in got], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, batch["label"], batch["weight"]], names=["total", "length", "label", "weight"])

    measured = sorted(tuple(r) for r in map_arrow(sample, run, "total double, length double, label int, weight double").collect())
    m = np.array(measured, float)
    model.curve = _curve(m[:, :2], m[:, 2], m[:, 3] / m[:, 3].mean())
    return model


def classify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Columns of ``df`` but the text, and ``score`` (0 to 1, higher: more likely toxic)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in df.columns if c not in (text_col, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [m.score(t.as_py() or "") for t in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(scores, pa.float64())], names=[*rest, "score"])

    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField("score", T.DoubleType())])
    return map_arrow(df.select(*rest, F.col(text_col).alias("__text")), run, schema)
