"""One query opN_<name> for each corpus operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, knn, langid, mixing, rules, samples, simhash, sstable, suffix, toxicity
from ._common import crc_mod, read_table


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_neighbours(_documents(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.fit(langid.sample(docs.where(~held_out)))
    return langid.identify(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.components(_documents(spark, sf_dir))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(_documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), read_table(spark, sf_dir, "labels")
    sample = samples.labelled(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0), "toxic", toxicity.BOUND)
    return _scored(toxicity.classify(docs, toxicity.fit(sample)), crc_mod(F.col("doc_id"), 5) == 0)


def _scored(df: DataFrame, held_out) -> DataFrame:
    return df.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.encoded(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(_documents(spark, sf_dir, "source"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), read_table(spark, sf_dir, "labels")
    sample = samples.labelled(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1), "quality", knn.BOUND)
    return _scored(knn.classify(docs, knn.fit(sample)), crc_mod(F.col("doc_id"), 3) == 1)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1 that SQL expresses."""
    return op1_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def rule_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL expresses."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_language": op2_language,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_suffix_array": op5_suffix_array,
    "op6_toxicity": op6_toxicity,
    "op7_sstable": op7_sstable,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "edited_texts": edited_texts,
    "rule_measures": rule_measures,
}

ORACLE_SQL: dict[str, str] = {
    "op8_mixing": mixing.ORACLE,
    "edited_texts": """
with d as (select doc_id, coalesce(text, '') as t, row_number() over (order by doc_id) as k, count(*) over () as n from documents)
select a.doc_id, length(a.t)::bigint as n_chars, sha256(substr(a.t, 1, length(a.t) - length(a.t) // 4) || substr(b.t, 1, length(a.t) // 4)) as edited_sha256
from d a join d b on b.k = a.k % a.n + 1
""",
    "rule_measures": r"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as x from w, lateral (select unnest(range(1, len(ws) - 1)) as i)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, x) as n from windows) where n > 1),
repeats as (select doc_id, count(distinct i + k) as n from twice, range(3) r(k) group by doc_id),
m as (
  select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, coalesce(n, 0)::bigint as n_repeat_words
  from w left join repeats using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
from m
""",
}
