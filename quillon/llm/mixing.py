"""Mixing sources to target weights, in DataFrame operations only.

1. Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating;
   a target stops at ``cap`` times its source's size and the excess goes to the
   others by weight (water filling, in closed form over the sources).
2. Blocks: a document's place in its source's permutation is the MD5 of seed
   and id; the first bits number its block. A source gives its whole
   permutation as often as its target holds it, then a prefix, cut within one
   block at the document whose middle passes the target. Prefix sums are
   taken over blocks and inside blocks, never over a whole source.
3. Shards: a binary tree over the output shards. Each node deals its block
   quotas, source by source, to its two halves by a multivariate
   hypergeometric draw (the first units of a seeded permutation of all units
   at the node); a leaf's shares are runs of each source's permuted blocks,
   disjoint from all other shards'. Rows are shuffled within a shard by hash.

The tree works on blocks: at most ``units`` of them and ``cap`` draws each,
whatever the corpus. Defined results: a null text has size 0; a source whose
texts are all empty has target 0; repeated rows are drawn each; rows of one id
are ordered by size; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, let, materialize, part_count

SEED = 17
#: Bound on the blocks of all sources together (four at least, and 1024 at most, for each source).
UNITS = 65_536
SHARDS = 16


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """(skey, source, source_size, target, repeats, rest) from (skey, source, size) rows."""
    per = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("w", ((rank - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * cap)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    per = per.select("*", F.sum("source_size").over(every).alias("total"), F.sum("w").over(every).alias("weights"), zero(F.sum("cap").over(before)).alias("caps"), zero(F.sum("w").over(before)).alias("ws"))
    capped = F.col("cap") * (F.col("weights") - F.col("ws")) <= F.col("w") * (F.col("total") - F.col("caps"))
    per = per.withColumn("capped", capped)
    held = lambda c: zero(F.sum(F.when(F.col("capped"), F.col(c))).over(every))
    per = per.select("*", held("cap").alias("c"), held("w").alias("cw"))
    share = F.col("w") * ((F.col("total") - F.col("c")) / F.nullif(F.col("weights") - F.col("cw"), F.lit(0)))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)
    per = per.withColumn("target", target)
    whole = F.when(F.col("capped"), F.lit(cap)).otherwise(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))).cast("int")
    per = per.withColumn("repeats", F.coalesce(whole, F.lit(0)))
    return per.select("skey", "source", "source_size", "target", "repeats", (F.col("target") - F.col("repeats") * F.col("source_size")).alias("rest"))


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(skey, upto): by source, the running sums of its units over the shards, from (skey, n) rows."""
    node = quotas.agg(F.collect_list(F.struct("skey", "n")).alias("q")).select(F.lit(0).alias("first"), F.lit(shards).alias("k"), F.array_sort("q").alias("q"))
    level = 0
    while (1 << level) < shards:
        units = F.flatten(F.transform("q", lambda s: F.when(s["n"] > 0, F.transform(F.sequence(F.lit(1).cast("long"), s["n"]), lambda o: F.struct(F.xxhash64(F.lit(seed), F.lit(level), F.col("first"), s["skey"], o).alias("r"), s["skey"].alias("s")))).otherwise(F.array())))
        half = F.ceil(F.col("k") / 2).cast("int")

        def split(u: Column) -> Column:
            cut = F.round(F.size(u) * half / F.col("k")).cast("int")
            drawn = F.slice(F.array_sort(u), F.lit(1), cut)
            return let(drawn, lambda d: F.transform("q", lambda s: F.size(F.filter(d, lambda x: x["s"] == s["skey"])).cast("long")))

        node = node.select("*", F.explode(F.array(F.when(F.col("k") > 1, let(units, split)))).alias("left"))
        minus = F.transform("q", lambda s, i: F.struct(s["skey"].alias("skey"), (s["n"] - F.get("left", i)).alias("n")))
        taken = F.transform("q", lambda s, i: F.struct(s["skey"].alias("skey"), F.get("left", i).alias("n")))
        child = lambda first, k, q: F.struct(first.cast("int").alias("first"), k.cast("int").alias("k"), q.alias("q"))
        kids = F.when(F.col("k") > 1, F.array(child(F.col("first"), half, taken), child(F.col("first") + half, F.col("k") - half, minus))).otherwise(F.array(child(F.col("first"), F.col("k"), F.col("q"))))
        node = node.select(F.explode(kids).alias("c")).select("c.*")
        level += 1
    flat = node.select("first", F.explode("q").alias("s")).groupBy("s.skey").agg(F.array_sort(F.collect_list(F.struct("first", F.col("s.n").alias("n")))).alias("by"))
    upto = F.transform(F.sequence(F.lit(1), F.size("by")), lambda k: F.aggregate(F.slice("by", F.lit(1), k), F.lit(0).cast("long"), lambda acc, x: acc + x["n"]))
    return flat.select("skey", upto.alias("upto"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED, cap: int = 3, units: int = UNITS) -> DataFrame:
    """(id, size, source_size, target, shards) for each row of ``df``: the output shard of each time that the mix takes it."""
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"))
    return _mix(docs, shards, seed, cap, units).withColumnRenamed("id", id_col)


def _mix(docs: DataFrame, shards: int, seed: int, cap: int, units: int, *more_cols: str) -> DataFrame:
    n_sources = docs.select(F.count_distinct("source") + F.max(F.col("source").isNull().cast("int"))).first()[0] or 1
    blocks = max(4, min(1024, 1 << ((units // n_sources).bit_length() - 1 if units >= n_sources else 0)))
    # Broadcast only what ``units`` bounds; with more sources than that Spark picks the join by size.
    small = F.broadcast if n_sources * blocks <= units else (lambda table: table)
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    docs = docs.select("id", "source", "size", *more_cols, skey.alias("skey"), key.alias("key"))
    docs = docs.withColumn("blk", F.floor(F.conv(F.substring("key", 1, 3), 16, 10).cast("int") * F.lit(blocks) / 4096).cast("int"))
    per_block = docs.groupBy("skey", "blk", "source").agg(F.sum("size").alias("size"))
    plan = targets(per_block, cap)

    in_order = Window.partitionBy("skey").orderBy("blk")
    own = Window.partitionBy("skey")
    b = per_block.drop("source").join(plan.drop("source"), "skey")
    b = b.select("*", (F.sum("size").over(in_order) - F.col("size")).alias("start"), (F.row_number().over(in_order) - 1).alias("rank"), F.count("*").over(own).alias("nb"))
    b = b.withColumn("times", F.col("repeats") + (F.col("start") < F.col("rest")).cast("int"))
    quotas = b.groupBy("skey").agg(F.sum("times").cast("long").alias("n"))
    b = b.join(shard_quotas(quotas, shards, seed), "skey")
    shard = lambda c: F.size(F.filter("upto", lambda x: x <= c * F.col("nb") + F.col("rank")))
    at = F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(0), F.col("times") - 1), shard)).otherwise(F.array().cast("array<int>"))
    b = materialize(b.select("skey", "blk", "size", "source_size", "target", "repeats", "rest", "start", at.alias("at")), "blocks")

    # The one block of a source that the rest ends in: its last document that is taken.
    inside = Window.partitionBy("skey", "blk").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ends = b.where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("size") > F.col("rest"))).select("skey", "blk", "start", "rest")
    own = docs.select("skey", "blk", "key", "size").join(small(ends), ["skey", "blk"])
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))
    taken = own.select("skey", "blk", "key", "size", (2 * before + F.col("size") <= 2 * F.col("rest")).alias("in")).where("in")
    cuts = taken.groupBy("skey", "blk").agg(F.max(F.struct("key", "size")).alias("cut"))
    ended = ends.select("skey", "blk", F.lit(True).alias("ends"))
    b = b.drop("size").join(ended, ["skey", "blk"], "left").join(cuts, ["skey", "blk"], "left")

    got = docs.join(small(b), ["skey", "blk"])
    upto_cut = F.coalesce(F.struct("key", "size") <= F.col("cut"), F.lit(False))
    more = F.when(F.col("ends"), upto_cut).otherwise((F.col("start") < F.col("rest")) & (F.col("size") > 0)).cast("int")
    return got.select("id", *more_cols, "size", "source_size", "target", F.slice("at", F.lit(1), F.col("repeats") + more).alias("shards"), "key")


def mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``df``: shard after shard, each in its order.

    A shard fills as many partitions, by ranges of its order, as the size of
    the input asks for, so that no task holds a whole shard.
    """
    rows = mixed_rows(df, id_col, text_col, source_col, shards, seed)
    bits = max(0, (-(-part_count(df) // shards) - 1).bit_length())
    part = F.shiftright("__place", 64 - bits) + (1 << bits - 1) if bits else F.lit(0)
    to = (F.col("__shard") * (1 << bits) + part).cast("int")
    return rows.repartitionById(shards << bits, to).sortWithinPartitions("__shard", "__place").select(*df.columns)


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it is taken, with the columns __shard and __place (its order within the shard)."""
    taken = [F.col(c).alias(f"__c{i}") for i, c in enumerate(df.columns)]
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"), F.struct(*taken).alias("row"))
    got = _mix(docs, shards, seed, 3, UNITS, "row")
    rows = got.select("row", "key", F.posexplode("shards").alias("copy", "__shard"))
    place = F.xxhash64(F.lit(seed), "__shard", "key", "copy")
    return rows.select(*[F.col(f"row.__c{i}").alias(c) for i, c in enumerate(df.columns)], "__shard", place.alias("__place"))


ORACLE = rf"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('{SEED}:' || doc_id) as key
  from documents
), p as (
  select source, sum(size)::bigint as source_size, 3 * sum(size)::bigint as cap,
         ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as w
  from d group by source
), q as (
  select *, (sum(source_size) over ())::bigint as total, (sum(w) over ())::bigint as weights,
         coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as caps,
         coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as ws
  from p
), r as (
  select *, cap * (weights - ws) <= w * (total - caps) as capped from q
), t as (
  select source, source_size, capped, cap,
         case when capped then cap::double else w * ((total - coalesce(sum(case when capped then cap end) over (), 0)::bigint)::double
              / nullif(weights - coalesce(sum(case when capped then w end) over (), 0)::bigint, 0)::double) end as target
  from r
), u as (
  select *, coalesce(case when capped then 3 else floor(target / nullif(source_size, 0)::double) end, 0)::bigint as repeats from t
), v as (
  select d.doc_id, d.size, u.source_size, u.target, u.repeats, u.target - u.repeats * u.source_size as rest,
         coalesce(sum(d.size) over (partition by d.source order by d.key, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join u on d.source is not distinct from u.source
)
select doc_id, size, source_size, target,
       (size * (repeats + (case when 2 * start + size <= 2 * rest then 1 else 0 end)))::bigint as taken
from v
"""
