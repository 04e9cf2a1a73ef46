"""Language identification by word-first backoff.

A word that the model knows scores by its log frequency in each language; an
unseen word falls back to its longest known character n-grams (5 down to 1,
the word's ends included), scored by the mean of their log frequencies. The
scores of all words of the whole text add up; the posterior is taken
as if a text had ``EVIDENCE`` words at most, so that it stays a probability
worth reading.

The fit uses about ``BOUND`` documents, the same number from each language
where there are as many, chosen by hash, so what is broadcast is bounded by
them. Known is a word or n-gram that they have ``KNOWN`` times or more; a word
met once backs off like an unseen one. Frequencies are shares of all that was
counted. A table without a language column's values teaches nothing. Defined results: ``und`` with score 0 for a null text, one without a
letter, or where nothing was learned; repeated rows score alike; an empty table
gives an empty result; other columns pass through ``identify`` unless named
as an output.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_arrow, materialize
from .samples import share_of

BOUND, KNOWN, LONGEST = 8000, 2, 5
SMOOTH, EVIDENCE = 0.1, 20
ROWS = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def grams(word: str, n: int) -> list[str]:
    word = f" {word} "
    return [word[i : i + n] for i in range(len(word) - n + 1)]


class Model:
    """Log frequencies by language of words (key ``w`` + word) and of n-grams (``1`` to ``5`` + n-gram): a row of a matrix each."""

    def __init__(self, features: list[str], counts: np.ndarray, langs: list[str], totals: dict[str, np.ndarray]):
        """counts: features by languages; totals: of each kind of feature, all counts by language and how many features there were."""
        self.langs = langs
        under = {k: np.log(x[:-1] + SMOOTH * (x[-1] + 1)) for k, x in totals.items()}
        self.row = {f: i for i, f in enumerate(features)}
        below = np.array([under[f[0]] for f in features]).reshape(len(features), len(langs))
        self.matrix = (np.log(counts.reshape(below.shape) + SMOOTH) - below).astype(np.float32)
        self._rows: dict[str, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None, "_matrix": None}

    def word(self, w: str) -> np.ndarray:
        found = self.row.get("w" + w)
        if found is not None:
            return self.matrix[found]
        for n in range(LONGEST, 0, -1):
            known = [self.row[k] for g in grams(w, n) if (k := f"{n}{g}") in self.row]
            if known:
                return self.matrix[known].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def total(self, words: list[str]) -> np.ndarray:
        """Sum of the words' scores; scores of words met before are kept in a bounded matrix."""
        out = np.zeros(len(self.langs))
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            if self._rows is None or len(self._rows) + len(part) > ROWS:
                self._rows, self._matrix = {}, np.zeros((ROWS, len(self.langs)), np.float32)
            rows, matrix = self._rows, self._matrix
            for w in set(part).difference(rows):
                matrix[len(rows)] = self.word(w)
                rows[w] = len(rows)
            out += matrix[[rows[w] for w in part]].sum(0, dtype=np.float64)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.langs:
            return "und", 0.0
        z = self.total(words) * min(1.0, EVIDENCE / len(words))
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def sample(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", bound: int = BOUND, seed: int = 11) -> DataFrame:
    """Rows with a language, about ``bound`` of them, dealt evenly over the languages, chosen by hash of the id."""
    docs = docs.where(F.col(lang_col).isNotNull())
    n = {r[0]: r[1] for r in docs.groupBy(lang_col).count().collect()}
    if not n:
        return docs
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, bound / len(n) / v))])
    return docs.where(share_of(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed) < F.try_element_at(share, F.col(lang_col)))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """From a bounded frame; counting is done by the executors, the driver gets the most frequent features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for t, l in zip(batch["text"], batch["lang"].to_pylist(), strict=True):
                seen.setdefault(l, Counter()).update(words_of(t.as_py() or ""))
        for l, words in seen.items():
            found: Counter = Counter()
            for w, n in words.items():
                found["w" + w] += n
                for k in range(1, LONGEST + 1):
                    for g in grams(w, k):
                        found[f"{k}{g}"] += n
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(keys)), pa.array(keys), pa.array([found[k] for k in keys])], names=["lang", "feature", "n"])

    # The sample is bounded, so a language meets in one task and each of its features is one row.
    given = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).repartition(docs.sparkSession.sparkContext.defaultParallelism, "lang")
    counted = map_arrow(given, run, "lang string, feature string, n long")
    by = materialize(counted.groupBy("feature", "lang").agg(F.sum("n").alias("n")), "features")
    langs = [r["lang"] for r in by.select("lang").distinct().orderBy("lang").collect()]
    each = [F.sum(F.when(F.col("lang") == l, F.col("n")).otherwise(0)).alias(f"n{i}") for i, l in enumerate(langs)]
    names = [f"n{i}" for i in range(len(langs))]
    kinds = by.groupBy(F.substring("feature", 1, 1).alias("kind")).agg(*each, F.count_distinct("feature").alias("features")).collect()
    known = by.groupBy("feature").agg(*each, F.sum("n").alias("n")).where(F.col("n") >= KNOWN).select("feature", *names).orderBy("feature").toArrow()
    counts = np.column_stack([known[c].to_numpy() for c in names]).astype(np.float64) if names else np.zeros((0, 0))
    return Model(known["feature"].to_pylist(), counts, langs, {r["kind"]: np.array(r[1:], np.float64) for r in kinds})


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Columns of ``df`` but the text, and ``lang_pred`` and ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in df.columns if c not in (text_col, "lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(len(rest))]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *cols], names=[*rest, "lang_pred", "score"])

    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_arrow(df.select(*rest, F.col(text_col).alias("__text")), run, schema)
