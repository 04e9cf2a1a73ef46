"""Quality rules under weak supervision, in DataFrame operations only.

Every rule votes good (1), bad (-1) or abstains (0). Expectation maximisation
over the counts of vote patterns (at most 3 to the number of rules, whatever
the corpus) estimates each rule's accuracy, and a document's posterior
probability of being good decides, in place of all-must-pass filtering.

Defined results: a null text counts as empty (no words, ``base_failed``);
repeated rows are judged each; an empty table gives an empty result; further
columns, whatever their names, pass through ``judge`` untouched unless named
as an output.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, let, materialize, once

#: EM ends when no accuracy moves by more than SETTLED; if ITERATIONS do not do, that is told by a warning.
ITERATIONS, SETTLED = 100, 1e-6
#: Votes (three in four right) that every rule has beforehand.
SMOOTH = 2.0


def repeated_words(words: Column, hash_bits: int = 64) -> Column:
    """Words in 3-word windows found twice or more, the first occurrence included.

    Windows are sorted as longs, hash above and position below (a position takes
    as few bits as the text needs), so equal ones are neighbours as a rule. The
    words decide, not the hash: where neighbours of equal hash differ, a few
    texts in a corpus, the windows of that text are sorted by their words.
    """
    n = F.size(words)
    bits = F.length(F.bin(n.cast("long")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1).cast("long")
    places = F.sequence(F.lit(0), n - 3)
    window = lambda i: [F.get(words, i + k) for k in range(3)]

    def by_words() -> Column:
        w = F.array_sort(F.transform(places, lambda i: F.struct(*[x.alias(f"w{k}") for k, x in enumerate(window(i))], i.cast("long").alias("at"))))

        def flagged(s: Column) -> Column:
            same = lambda a, b: F.coalesce((a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"]), F.lit(False))
            twice = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
            return F.array_sort(F.transform(twice, lambda x: x["at"]))

        return let(w, flagged)

    def found(mask: Column) -> Column:
        high = F.bitwise_not(mask)
        short = F.lit(-1 if hash_bits == 64 else -1 << (64 - hash_bits)).cast("long")
        packed = F.transform(places, lambda i: F.xxhash64(*window(i)).bitwiseAND(short).bitwiseAND(high).bitwiseOR(i.cast("long")))

        def flagged(s: Column) -> Column:
            def hashes(a: Column, b: Column) -> Column:
                return a.bitwiseXOR(b).bitwiseAND(high) == 0

            def same(a: Column, b: Column) -> Column:
                p, q = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
                equal = hashes(a, b)
                for k in range(3):
                    equal = equal & (F.get(words, p + k) == F.get(words, q + k))
                return F.coalesce(equal, F.lit(False))

            mixed = F.exists(F.sequence(F.lit(1), F.size(s)), lambda k: F.coalesce(hashes(F.get(s, k - 1), F.get(s, k)), F.lit(False)) & ~same(F.get(s, k - 1), F.get(s, k)))
            twice = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
            return F.when(mixed, by_words()).otherwise(F.array_sort(F.transform(twice, lambda x: x.bitwiseAND(mask))))

        start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("sum"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("sum"))
        return F.aggregate(let(F.array_sort(packed), flagged), start, step, lambda acc: acc["sum"])

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(mask, found))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a struct column ``measure`` of what the rules look at, without its text."""
    rest = [c for c in df.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = once(df, __words=F.regexp_extract_all(text, F.lit(f"({WORD})"), 1))
    words, n = F.col("__words"), F.size("__words").cast("long")
    left = lambda what: F.length(text) - F.length(F.regexp_replace(text, what, ""))
    m = F.struct(
        n.alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        left(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        left(r"\p{Lu}").alias("n_upper"),
        left(r"\p{L}").alias("n_letters"),
        left(r"[!?]").alias("n_marks"),
        F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))).alias("n_lines"),
    )
    return df.select(*rest, m.alias("measure"))


def default_rules(m: Column) -> dict[str, Column]:
    """Name to vote: 1 good, -1 bad, 0 abstains."""
    words = F.greatest(m["n_words"], F.lit(1))
    letters = F.greatest(m["n_letters"], F.lit(1))

    def vote(x: Column, good_to: float, bad_from: float) -> Column:
        return F.when(x <= good_to, 1).when(x >= bad_from, -1).otherwise(0)

    length = m["word_chars"] / words
    return {
        "symbols": vote(m["n_symbols"] / words, 0.05, 0.15),
        "upper_case": vote(m["n_upper"] / letters, 0.12, 0.4),
        "marks": vote(m["n_marks"] / words, 0.08, 0.3),
        "letters": vote(1 - letters / F.greatest(m["word_chars"], F.lit(1)), 0.12, 0.22),
        "repeats": vote(m["n_repeat_words"] / words, 0.25, 0.45),
        "lines": vote(m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)), 0.2, 0.4),
        "word_length": F.when((length >= 3) & (length <= 9), 1).when((length < 2) | (length > 15), -1).otherwise(0),
    }


def _posterior(votes: dict[str, Column], accuracy: dict[str, float], prior: float) -> Column:
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, v in votes.items():
        odds = odds + v * F.lit(math.log(accuracy[name] / (1 - accuracy[name])))
    return 1 / (1 + F.exp(-odds))


def fit_accuracies(votes: DataFrame, names: list[str], iterations: int = ITERATIONS) -> tuple[dict[str, float], float]:
    """EM on a frame of vote columns: each rule's accuracy when it votes, and the share of good documents.

    The frame is first reduced to counts by pattern. Each iteration is one
    aggregate of that table, and the driver gets one row of sums from it.
    Accuracies are held between 0.5 (a rule that is wrong more often than not
    would turn what "good" means around) and 0.999 (no rule is beyond doubt),
    the share between 0.05 and 0.95, so that no posterior is 0 or 1 whatever the
    votes.
    """
    patterns = materialize(votes.groupBy(*names).agg(F.count("*").alias("n")), "patterns")
    accuracy, prior, moved = dict.fromkeys(names, 0.75), 0.5, 0.0
    for _ in range(iterations):
        p = _posterior({k: F.col(k) for k in names}, accuracy, prior)
        sums = [F.sum(F.col("n")).alias("n"), F.sum(F.col("n") * p).alias("good")]
        for k in names:
            right = F.when(F.col(k) == 1, p).when(F.col(k) == -1, 1 - p).otherwise(0.0)
            sums += [F.sum(F.col("n") * right).alias(f"{k}_right"), F.sum(F.when(F.col(k) != 0, F.col("n"))).alias(f"{k}_n")]
        row = patterns.agg(*sums).first()
        if not row["n"]:
            break
        new = {k: min(0.999, max(0.5, (row[f"{k}_right"] + 0.75 * SMOOTH) / ((row[f"{k}_n"] or 0) + SMOOTH))) for k in names}
        moved = max(abs(new[k] - accuracy[k]) for k in names)
        accuracy, prior = new, min(0.95, max(0.05, row["good"] / row["n"]))
        if moved < SETTLED:
            break
    else:
        warnings.warn(f"accuracies still move by {moved:.2g} after {iterations} iterations", stacklevel=2)
    return accuracy, prior


def judge(df: DataFrame, text_col: str = "text", rules=default_rules, min_words: int = 50) -> DataFrame:
    """Each row of ``df`` without its text, with the measures, one ``vote_*`` a rule, ``base_failed``, ``posterior`` and ``kept``.

    A document that fails a base condition is not kept and, as its measures
    say little, has no part in the estimates.
    """
    rest = [c for c in df.columns if c != text_col]
    taken = [F.col(c).alias(f"__in{i}") for i, c in enumerate(rest)]
    m = F.col("measure")
    seen = measures(df.select(*taken, F.col(text_col).alias("__text")), "__text")
    votes = rules(m)
    base = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    voted = materialize(seen.select("*", base.alias("base_failed"), *[v.cast("int").alias(f"vote_{k}") for k, v in votes.items()]), "votes")
    names = [f"vote_{k}" for k in votes]
    accuracy, prior = fit_accuracies(voted.where(~F.col("base_failed")), names)
    p = _posterior({k: F.col(k) for k in names}, accuracy, prior)
    return voted.select(
        *[F.col(f"__in{i}").alias(c) for i, c in enumerate(rest)],
        *[m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        *names,
        "base_failed",
        p.alias("posterior"),
        (~F.col("base_failed") & (p >= 0.5)).alias("kept"),
    )
