"""Queries, one an operator, and the SQL that an independent engine checks them with."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import DISK, RAW_MEMORY, Dataset, PairDataset
from ..functions import variants
from ..functions.callables import Function
from ..functions.registry import register
from ..session import Session
from ..shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns) -> Dataset:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Dataset(df.select(*columns) if columns else df, Session.of(spark))


def pairs(spark: SparkSession, sf_dir: str, name: str, key: str, value: str) -> PairDataset:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return PairDataset(df.select(F.expr(key).alias("key"), F.expr(value).alias("value")), Session.of(spark))


def one_row(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


def folder(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share."""
    return new_folder(spark, "io")


MONEY = "cast({} as decimal(18,2))"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten customers of most revenue: reduced by key, joined, top-k."""
    revenue = pairs(spark, sf_dir, "orders", "o_custkey", MONEY.format("o_totalprice")).reduce_by_key("sum")
    customers = pairs(spark, sf_dir, "customer", "c_custkey", "c_name")
    joined = customers.join(revenue, null_safe=False)
    rows = joined.map(["key AS c_custkey", "value.left AS c_name", "cast(value.right as decimal(28,2)) AS rev"])
    return rows.top_frame(10, [F.col("rev"), -F.col("c_custkey")])


query("""select c_custkey, c_name, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(28,2)) as rev
from orders join customer on o_custkey = c_custkey group by 1, 2 order by rev desc, c_custkey limit 10""")(flagship)


# -- row by row


@query("select l_orderkey, l_linenumber, cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(18,4)) as rev from lineitem")
def map_project(spark, d):
    rev = "cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(18,4)) as rev"
    return table(spark, d, "lineitem").map(["l_orderkey", "l_linenumber", rev]).df


@query("select o_orderkey, upper(o_orderstatus) || ':' || o_orderpriority as tag from orders")
def map_callable(spark, d):
    rows = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return rows.map(lambda r: (r.o_orderkey, f"{r.o_orderstatus.upper()}:{r.o_orderpriority}"), "o_orderkey long, tag string").df


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45")
def filter_quantity(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity > 45").map(["l_orderkey", "l_linenumber", "l_quantity"]).df


@query("select s_suppkey from supplier where s_suppkey % 7 = 3")
def filter_callable(spark, d):
    return table(spark, d, "supplier", "s_suppkey").filter(lambda k: k % 7 == 3).df


@query("select unnest(string_split(o_orderpriority, '-')) as value from orders")
def flatmap_words(spark, d):
    return table(spark, d, "orders").flatmap("split(o_orderpriority, '-')").df


@query("select n_nationkey * 10 + i as value from nation, range(3) t(i)")
def flatmap_callable(spark, d):
    return table(spark, d, "nation", "n_nationkey").flatmap(lambda k: [k * 10 + i for i in range(3)], "long").df


@query("select cast(length(p_name) as int) as key, p_partkey, p_name from part")
def key_by_len(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name").key_by("length(p_name)").map(["key", "value.p_partkey", "value.p_name"]).df


@query("select row_number() over (order by o_orderkey) - 1 as idx, o_orderkey from orders")
def map_with_index(spark, d):
    return table(spark, d, "orders", "o_orderkey").sort().map_with_index(["idx", "o_orderkey"]).df


@query("select row_number() over (order by l_orderkey, l_linenumber) - 1 as idx, l_orderkey, l_linenumber from lineitem")
def map_with_index_large(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    return rows.sort(partitions=64).map_with_index(["idx", "l_orderkey", "l_linenumber"]).df


@query("select row_number() over (order by c_custkey) - 1 + c_custkey as value from customer")
def map_with_index_callable(spark, d):
    return table(spark, d, "customer", "c_custkey").sort().map_with_index(lambda i, k: i + k, "long").df


@query("select upper(c_name) as value from customer")
def map_partitions(spark, d):
    return table(spark, d, "customer", "c_name").map_partitions(lambda names: (n.upper() for n in names), "string").df


@query("select cast(s_suppkey % 4 as int) as partition, count(*) as n from supplier group by 1")
def map_partitions_with_index(spark, d):
    placed = table(spark, d, "supplier", "s_suppkey").partition_by("s_suppkey", 4)
    return placed.map_partitions_with_index(lambda p, items: [(p, sum(1 for _ in items))], "partition int, n long").filter("n > 0").df


@query("select s_suppkey + 1 as value from supplier")
def map_executor(spark, d):
    def add(parts):
        for p in parts:
            p[:] = [x + 1 for x in p]

    return table(spark, d, "supplier", "s_suppkey").map_executor(add, "long").df


@query("select count(*) as value from supplier")
def map_executor_to(spark, d):
    return table(spark, d, "supplier", "s_suppkey").map_executor_to(lambda parts: [[sum(map(len, parts))]], "value long").aggregate_frame("sum(value) as value")


@query("select o_custkey as key, o_orderkey * 2 as value from orders")
def map_values(spark, d):
    return pairs(spark, d, "orders", "o_custkey", "o_orderkey").map_values("value * 2").df


@query("select o_custkey as key, o_orderkey + 1 as value from orders")
def map_values_callable(spark, d):
    return pairs(spark, d, "orders", "o_custkey", "o_orderkey").map_values(lambda v: v + 1, "long").df


@query("select o_custkey as key, unnest(string_split(o_orderpriority, '-')) as value from orders")
def flat_map_values(spark, d):
    return pairs(spark, d, "orders", "o_custkey", "o_orderpriority").flat_map_values("split(value, '-')").df


@query("select n_regionkey as value from nation")
def keys(spark, d):
    return pairs(spark, d, "nation", "n_regionkey", "n_name").keys_dataset().df


@query("select n_name as value from nation")
def values(spark, d):
    return pairs(spark, d, "nation", "n_regionkey", "n_name").values_dataset().df


@query("select r_regionkey as key, r_name as value from region")
def to_pair(spark, d):
    return table(spark, d, "region", "r_regionkey", "r_name").to_pair().df


# -- joins


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def join_orders_customer(spark, d):
    joined = pairs(spark, d, "orders", "o_custkey", "o_orderkey").join(pairs(spark, d, "customer", "c_custkey", "c_name"))
    return joined.map(["value.left as o_orderkey", "value.right as c_name"]).df


@query("select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def join_three_way(spark, d):
    customers = pairs(spark, d, "customer", "c_custkey", "struct(c_name, c_nationkey)")
    first = pairs(spark, d, "orders", "o_custkey", "o_orderkey").join(customers)
    by_nation = first.map(["value.right.c_nationkey as key", "struct(value.left as o_orderkey, value.right.c_name as c_name) as value"])
    return by_nation.join(pairs(spark, d, "nation", "n_nationkey", "n_name")).map(["value.left.o_orderkey", "value.left.c_name", "value.right as n_name"]).df


@query("""select a.o_orderkey, b.c_custkey from (select o_orderkey, case when o_orderkey % 1000 < 3 then null else o_custkey end as k from orders) a
join (select c_custkey, case when c_custkey <= 2 then null else c_custkey end as k from customer) b on a.k is not distinct from b.k""")
def join_null_safe(spark, d):
    a = pairs(spark, d, "orders", "case when o_orderkey % 1000 < 3 then null else o_custkey end", "o_orderkey")
    b = pairs(spark, d, "customer", "case when c_custkey <= 2 then null else c_custkey end", "c_custkey")
    return a.join(b).map(["value.left as o_orderkey", "value.right as c_custkey"]).df


@query("select c_custkey as key, c_name as value from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def join_anti(spark, d):
    failed = table(spark, d, "orders").filter("o_orderstatus = 'F'").map(["o_custkey as key", "o_orderkey as value"])
    return pairs(spark, d, "customer", "c_custkey", "c_name").join(failed, how="left_anti", null_safe=False).df


# -- whole-collection aggregates

TOTAL = "select cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(28,2)) as total from orders"


def prices(spark, d) -> Dataset:
    return table(spark, d, "orders", F.expr("cast(o_totalprice as decimal(18,2)) as value"))


def _plus(a, b):
    return a + b


@query(TOTAL)
def reduce_total(spark, d):
    return one_row(spark, "total decimal(28,2)", prices(spark, d).reduce("sum"))


@query(TOTAL)
def reduce_callable(spark, d):
    return one_row(spark, "total decimal(28,2)", prices(spark, d).reduce(_plus))


@query(TOTAL)
def tree_reduce_total(spark, d):
    return one_row(spark, "total decimal(28,2)", prices(spark, d).repartition(20).tree_reduce(_plus))


@query("select cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(28,2)) as total, count(*) as n from orders")
def aggregate_total(spark, d):
    total, n = prices(spark, d).aggregate((Decimal(0), 0), lambda a, x: (a[0] + x, a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return one_row(spark, "total decimal(28,2), n long", total, n)


@query("select max(o_totalprice) as most, count(*) as n from orders")
def tree_aggregate_total(spark, d):
    rows = table(spark, d, "orders", "o_totalprice").repartition(12)
    most, n = rows.tree_aggregate((0.0, 0), lambda a, x: (max(a[0], x), a[1] + 1), lambda a, b: (max(a[0], b[0]), a[1] + b[1]))
    return one_row(spark, "most double, n long", most, n)


@query(TOTAL)
def fold_total(spark, d):
    return one_row(spark, "total decimal(28,2)", prices(spark, d).fold(Decimal(0), _plus))


@query(TOTAL)
def tree_fold_total(spark, d):
    return one_row(spark, "total decimal(28,2)", prices(spark, d).repartition(10).tree_fold(Decimal(0), _plus))


@query("select count(*) as n from lineitem")
def count_all(spark, d):
    return one_row(spark, "n long", table(spark, d, "lineitem").count())


@query("select max(o_totalprice) as value from orders")
def max_price(spark, d):
    return one_row(spark, "value double", table(spark, d, "orders", "o_totalprice").max())


@query("select min(o_totalprice) as value from orders")
def min_price(spark, d):
    return one_row(spark, "value double", table(spark, d, "orders", "o_totalprice").min())


@query("select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 1")
def max_by(spark, d):
    rows = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    return one_row(spark, "o_orderkey long", rows.max([F.col("o_totalprice"), -F.col("o_orderkey")]).o_orderkey)


@query("select o_orderkey from orders order by o_totalprice, o_orderkey limit 1")
def min_by_comparator(spark, d):
    rows = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    return one_row(spark, "o_orderkey long", rows.min(lambda a, b: (a.o_totalprice, a.o_orderkey) < (b.o_totalprice, b.o_orderkey)).o_orderkey)


@query("select o_orderstatus as key, count(*) as n from orders group by 1")
def count_by_key(spark, d):
    found = pairs(spark, d, "orders", "o_orderstatus", "o_orderkey").count_by_key()
    return spark.createDataFrame(sorted(found.items()), "key string, n long")


@query("select o_custkey as key, count(*) as value from orders group by 1")
def key_counts(spark, d):
    return pairs(spark, d, "orders", "o_custkey", "o_orderkey").key_counts().df


@query("select event_type as key, count(*) as value from events group by 1")
def value_counts(spark, d):
    return pairs(spark, d, "events", "user_id", "event_type").value_counts().df


@query("select event_type as value, count(*) as n from events group by 1")
def count_by_value(spark, d):
    found = pairs(spark, d, "events", "user_id", "event_type").count_by_value()
    return spark.createDataFrame(sorted(found.items()), "value string, n long")


# -- keyed aggregates


@query("select o_orderstatus as key, count(*) as n, sum(o_orderkey)::bigint as s from orders group by 1")
def group_by_status(spark, d):
    grouped = table(spark, d, "orders", "o_orderkey", "o_orderstatus").group_by("o_orderstatus")
    return grouped.map(["key", "cast(size(value) as bigint) as n", "aggregate(value, 0L, (a, x) -> a + x.o_orderkey) as s"]).df


@query("select o_custkey as key, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as value from orders group by 1")
def group_by_key_list(spark, d):
    return pairs(spark, d, "orders", "o_custkey", "o_orderkey").group_by_key().map_values("array_join(transform(array_sort(value), x -> cast(x as string)), ',')").df


@query("select l_suppkey as key, cast(sum(cast(l_quantity as decimal(18,2))) as decimal(28,2)) as value from lineitem group by 1")
def reduce_by_key_sum(spark, d):
    return pairs(spark, d, "lineitem", "l_suppkey", MONEY.format("l_quantity")).reduce_by_key("sum").df


@query("select l_suppkey as key, max(l_extendedprice) as value from lineitem group by 1")
def reduce_by_key_max(spark, d):
    return pairs(spark, d, "lineitem", "l_suppkey", "l_extendedprice").reduce_by_key("max").df


@query("select o_custkey as key, sum(o_orderkey)::bigint as value from orders group by 1")
def reduce_by_key_callable(spark, d):
    return pairs(spark, d, "orders", "o_custkey", "o_orderkey").reduce_by_key(_plus).df


@query("select l_suppkey as key, sum(l_linenumber)::bigint as s, count(*) as n from lineitem group by 1")
def aggregate_by_key(spark, d):
    got = pairs(spark, d, "lineitem", "l_suppkey", "l_linenumber").aggregate_by_key(F.struct(F.sum("value").alias("s"), F.count("value").alias("n")))
    return got.map(["key", "value.s", "value.n"]).df


@query("select l_suppkey as key, max(l_linenumber) * 1000 + count(*) as value from lineitem group by 1")
def aggregate_by_key_callable(spark, d):
    got = pairs(spark, d, "lineitem", "l_suppkey", "l_linenumber").aggregate_by_key(
        [0, 0], lambda a, v: [max(a[0], v), a[1] + 1], lambda a, b: [max(a[0], b[0]), a[1] + b[1]], "array<long>")
    return got.map_values("value[0] * 1000 + value[1]").df


@query("select o_orderstatus as s, o_orderpriority as p, sum(o_orderkey)::bigint as value from orders group by 1, 2")
def reduce_by_key_array_keys(spark, d):
    got = pairs(spark, d, "orders", "array(o_orderstatus, o_orderpriority)", "o_orderkey").reduce_by_key(_plus)
    return got.map(["key[0] as s", "key[1] as p", "value"]).df


@query("select o_orderstatus as s, o_orderpriority as p, count(*) as value from orders group by 1, 2")
def aggregate_by_key_struct_keys(spark, d):
    rows = pairs(spark, d, "orders", "struct(o_orderstatus as s, o_orderpriority as p)", "o_orderkey")
    return rows.aggregate_by_key(0, lambda n, _: n + 1, _plus, "long").map(["key.s", "key.p", "value"]).df


@query("select case when o_orderkey % 5 = 0 then -1 else o_custkey % 3 end::double as key, sum(o_orderkey)::bigint as value from orders group by 1")
def fold_by_key_nan_keys(spark, d):
    rows = pairs(spark, d, "orders", "case when o_orderkey % 5 = 0 then double('NaN') else double(o_custkey % 3) end", "o_orderkey")
    return rows.fold_by_key(0, _plus).map(["nanvl(key, -1D) as key", "value"]).df


def _plus_mod(a, b, context):
    return (a + b) % context.variables["by"]


@query("select sum(o_orderkey)::bigint % 1000003 as value from orders")
def reduce_with_variables(spark, d):
    return one_row(spark, "value long", table(spark, d, "orders", "o_orderkey").repartition(5).with_variables(by=1000003).reduce(_plus_mod))


@query("select o_custkey as key, sum(o_orderkey)::bigint % 1009 as value from orders group by 1 having count(*) > 1")
def reduce_by_key_with_variables(spark, d):
    many = table(spark, d, "orders", "o_custkey", "o_orderkey").with_variables(by=1009).to_pair()
    return many.join(many.key_counts().filter("value > 1")).map_values("value.left").reduce_by_key(_plus_mod).df


@query("select l_returnflag as key, sum(l_linenumber)::bigint as value from lineitem group by 1")
def fold_by_key(spark, d):
    return pairs(spark, d, "lineitem", "l_returnflag", "cast(l_linenumber as long)").fold_by_key(0, _plus).df


@query("select l_linestatus as key, sum(l_linenumber)::bigint as value from lineitem group by 1")
def fold_by_key_shuffled(spark, d):
    return pairs(spark, d, "lineitem", "l_linestatus", "cast(l_linenumber as long)").fold_by_key(0, _plus, local=False).df


@query("select w as key, count(*) as value from (select unnest(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0b]+')) as w from documents) where w <> '' group by 1")
def word_count(spark, d):
    words = table(spark, d, "documents", "text").flatmap("split(lower(text), '[ \\\\t\\\\n\\\\r\\\\f\\\\x0b]+')").filter("value <> ''")
    return words.map(["value as key", "1L as value"]).reduce_by_key("sum").df


@query("select distinct user_id, event_type from events")
def distinct_user_event(spark, d):
    return table(spark, d, "events", "user_id", "event_type").distinct().df


# -- sets, order, top


@query("select c_nationkey as value from customer union all select s_nationkey from supplier")
def union_bag(spark, d):
    return table(spark, d, "customer", F.col("c_nationkey").alias("value")).union(table(spark, d, "supplier", F.col("s_nationkey").alias("value"))).df


@query("""select row_number() over (order by side, k) - 1 as idx, k as value from
(select 0 as side, s_suppkey as k from supplier union all select 1, c_custkey from customer)""")
def union_ordered(spark, d):
    a = table(spark, d, "supplier", F.col("s_suppkey").alias("value")).sort()
    b = table(spark, d, "customer", F.col("c_custkey").alias("value")).sort()
    return a.union(b, preserve_order=True).map_with_index(["idx", "value"]).df


@query("select row_number() over (order by o_totalprice, o_orderkey) - 1 as idx, o_orderkey from orders")
def sort_orders(spark, d):
    return table(spark, d, "orders", "o_totalprice", "o_orderkey").sort().map_with_index(["idx", "o_orderkey"]).df


@query("select row_number() over (order by c_custkey desc) - 1 as idx, c_custkey from customer")
def sort_desc(spark, d):
    return table(spark, d, "customer", "c_custkey").sort(False, partitions=5).map_with_index(["idx", "c_custkey"]).df


@query("select row_number() over (order by o_orderdate, o_orderkey) - 1 as idx, o_orderkey from orders")
def sort_by_two_keys(spark, d):
    return table(spark, d, "orders", "o_orderdate", "o_orderkey").sort_by(["o_orderdate", "o_orderkey"]).map_with_index(["idx", "o_orderkey"]).df


@query("select row_number() over (order by length(p_name) desc, p_partkey) - 1 as idx, p_partkey from part")
def sort_by_comparator(spark, d):
    less = lambda a, b: (-len(a.p_name), a.p_partkey) < (-len(b.p_name), b.p_partkey)
    return table(spark, d, "part", "p_partkey", "p_name").sort_by(less, partitions=4).map_with_index(["idx", "p_partkey"]).df


@query("select row_number() over (order by n_name) - 1 as idx, n_name as key from nation")
def sort_by_key(spark, d):
    return pairs(spark, d, "nation", "n_name", "n_nationkey").sort_by_key().map_with_index(["idx", "key"]).df


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def top_k(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").top_frame(10, [F.col("o_totalprice"), -F.col("o_orderkey")])


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 10")
def take_ordered(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").top_frame(10, ["o_totalprice", "o_orderkey"], largest=False)


@query("select p_partkey from part order by p_retailprice desc, p_partkey limit 7")
def top_comparator(spark, d):
    rows = table(spark, d, "part", "p_partkey", "p_retailprice").top(7, lambda a, b: (a.p_retailprice, -a.p_partkey) < (b.p_retailprice, -b.p_partkey))
    return spark.createDataFrame([(r.p_partkey,) for r in rows], "p_partkey long")


@query("select o_orderkey as value from orders order by o_orderkey limit 12")
def take_n(spark, d):
    return spark.createDataFrame([(x,) for x in table(spark, d, "orders", "o_orderkey").sort().take(12)], "value long")


# -- samples

MD5_RANK = "row_number() over ({}order by md5('7:' || cast(o_orderkey as varchar)))"


@query(f"select o_orderkey from (select o_orderkey, {MD5_RANK.format('')} as rn, count(*) over () as n from orders) where rn <= floor(n * 0.1)")
def sample_exact(spark, d):
    return table(spark, d, "orders", "o_orderkey").sample(0.1, 7, key="o_orderkey").df


DRAW = "cast(least(floor(('0x' || substr(md5('7:' || cast({first} as varchar) || ':' || cast(i as varchar)), 1, 12))::bigint / 281474976710656.0 * n), n - 1) as bigint)"


@query(f"""select o_orderkey as value from (select {DRAW.format(first=0)} as pos from (select count(*) as n from orders) c, range((select count(*) // 10 from orders)) t(i))
join (select o_orderkey, row_number() over (order by o_orderkey) - 1 as idx from orders) on pos = idx""")
def sample_replacement(spark, d):
    return table(spark, d, "orders", F.col("o_orderkey").alias("value")).sort().sample(0.1, 7, replacement=True).df


@query(f"""select o_orderstatus as key, o_orderkey as value from (
select first, first + {DRAW.format(first='first')} as pos from (
  select o_orderstatus as g, count(*) as n, min(idx) as first, case o_orderstatus when 'F' then count(*) // 2 else count(*) // 5 end as take
  from (select o_orderstatus, row_number() over (order by o_orderstatus, o_orderkey) - 1 as idx from orders) group by 1 having o_orderstatus in ('F', 'O')) k, lateral (select unnest(range(take)) as i))
join (select o_orderkey, o_orderstatus, row_number() over (order by o_orderstatus, o_orderkey) - 1 as idx from orders where o_orderstatus in ('F', 'O')) on pos = idx""")
def sample_by_key_replacement(spark, d):
    rows = pairs(spark, d, "orders", "o_orderstatus", "o_orderkey").sort()
    return rows.sample_by_key({"F": 0.5, "O": 0.2}, 7, replacement=True).df


@query("select 1500 as fraction, 1500 as num, true as apart".replace("1500", "(select count(*) // 10 from orders)::bigint"))
def sample_without_key(spark, d):
    """Random places without a key over a shuffled input: counts are exact and rows differ."""
    rows = table(spark, d, "orders", "o_orderkey").repartition(7)
    n = rows.count() // 10
    some, more = rows.sample(0.1, 3).collect(), rows.take_sample(n, 4)
    return one_row(spark, "fraction long, num long, apart boolean", len(some), len(more), len(set(some)) == len(some) and len(set(more)) == len(more))


@query(f"select o_orderkey from (select o_orderkey, {MD5_RANK.format('')} as rn from orders) where rn <= 25")
def take_sample(spark, d):
    return spark.createDataFrame([(x,) for x in table(spark, d, "orders", "o_orderkey").take_sample(25, 7, key="o_orderkey")], "o_orderkey long")


@query(f"""select o_orderstatus as key, o_orderkey as value from (select o_orderstatus, o_orderkey, {MD5_RANK.format('partition by o_orderstatus ')} as rn,
count(*) over (partition by o_orderstatus) as n from orders) where rn <= floor(n * case o_orderstatus when 'F' then 0.5 when 'O' then 0.25 end)""")
def sample_by_key_exact(spark, d):
    return pairs(spark, d, "orders", "o_orderstatus", "o_orderkey").sample_by_key({"F": 0.5, "O": 0.25}, 7, order="value").df


# -- placement


@query("select cast(('0x' || substr(md5(cast(o_custkey as varchar)), 1, 8))::bigint % 8 as int) as partition, count(*) as n from orders group by 1")
def partition_by_expression(spark, d):
    number = "cast(conv(substr(md5(cast(o_custkey as string)), 1, 8), 16, 10) as bigint)"
    return table(spark, d, "orders", "o_custkey").partition_by(number, 8).map_partitions_with_index(lambda p, rows: [(p, sum(1 for _ in rows))], "partition int, n long").filter("n > 0").df


@query("select count(distinct o_custkey) as keys, count(distinct o_custkey) as places from orders")
def partition_by_hash(spark, d):
    placed = table(spark, d, "orders", "o_custkey").partition_by_hash(8, "o_custkey").df
    seen = placed.select("o_custkey", F.spark_partition_id().alias("p")).distinct()
    return seen.agg(F.count_distinct("o_custkey").alias("keys"), F.count("*").alias("places"))


@query("select cast(s_suppkey % 4 as int) as partition, count(*) as n from supplier group by 1")
def partition_by_fn(spark, d):
    placed = table(spark, d, "supplier", "s_suppkey").partition_by(lambda k: k, 4)
    return spark.createDataFrame(sorted(placed.count_by_partition().items()), "partition int, n long")


@query("select o_orderkey, true as near_even from orders")
def partition_by_random(spark, d):
    placed = table(spark, d, "orders", "o_orderkey").partition_by_random(6, 3)
    n = placed.count_by_partition()
    even = len(n) == 6 and max(n.values()) < 1.5 * min(n.values())
    return placed.df.withColumn("near_even", F.lit(even))


@query("select 0 as parts, count(*) as n, max(c_custkey) as last from customer".replace("select 0", "select 3"))
def repartition_local(spark, d):
    rows = table(spark, d, "customer", "c_custkey").repartition(2).repartition(3, everywhere=False)
    return one_row(spark, "parts int, n long, last long", rows.partitions(), rows.count(), rows.max())


@query("select true as positive")
def approx_size(spark, d):
    return one_row(spark, "positive boolean", table(spark, d, "orders").approx_size() > 1000)


@query("select cast((row_number() over (order by o_orderkey) - 1) * 7 // (select count(*) from orders) as int) as partition, o_orderkey from orders")
def repartition_ordered(spark, d):
    placed = table(spark, d, "orders", "o_orderkey").sort().repartition(7, preserve_ordering=True)
    return placed.map_partitions_with_index(lambda p, rows: ((p, k) for k in rows), "partition int, o_orderkey long").df


@query("select 9 as global, 3 as local, count(*) as n from customer")
def repartition_counts(spark, d):
    rows = table(spark, d, "customer", "c_custkey").repartition(9)
    return one_row(spark, "global int, local int, n long", rows.partitions(), rows.repartition(3, everywhere=False).partitions(), rows.count())


# -- input and output


@query("select p_name as value from part")
def text_roundtrip(spark, d):
    path = folder(spark)
    table(spark, d, "part", "p_name").save_as_text_file(path)
    return Session.of(spark).text_file(path, 4).df


@query("select row_number() over (order by p_partkey) - 1 as idx, cast(p_partkey as varchar) as value, true as split from part")
def text_order_in_splits(spark, d):
    """One file, read in several splits, keeps its order."""
    path = folder(spark)
    table(spark, d, "part", "p_partkey").sort(partitions=1).save_as_text_file(path)
    lines = Session.of(spark).text_file(path, 4)
    return lines.map_with_index(["idx", "value"]).df.withColumn("split", F.lit(lines.partitions() >= 4))


@query("select count(*) as first, 2 * count(*) as appended, count(*) as overwritten from supplier")
def overwrite_and_append(spark, d):
    path, rows, lines = folder(spark), table(spark, d, "supplier", "s_name"), lambda: Session.of(spark).text_file(path).count()
    rows.save_as_text_file(path)
    seen = [lines()]
    rows.save_as_text_file(path, append=True)
    seen.append(lines())
    rows.save_as_text_file(path, overwrite=True)
    return one_row(spark, "first long, appended long, overwritten long", *seen, lines())


@query("select 4 as parts, row_number() over (order by p_partkey) - 1 as idx, p_partkey as value from part")
def partition_json_order(spark, d):
    path = folder(spark)
    table(spark, d, "part", "p_partkey").sort(partitions=4).save_as_json_file(path)
    got = Session.of(spark).partition_json_file(path, "bigint")
    return got.map_with_index([F.lit(got.partitions()).alias("parts"), "idx", "value"]).df


@query("select row_number() over (order by p_partkey) - 1 as idx, cast(p_partkey as varchar) as value from part")
def partition_text_order(spark, d):
    path = folder(spark)
    table(spark, d, "part", "p_partkey").sort(partitions=4).save_as_text_file(path)
    return Session.of(spark).partition_text_file(path).map_with_index(["idx", "value"]).df


@query("select unnest(string_split(p_name || '@@' || p_brand, '@@')) as value from part")
def plain_file_delim(spark, d):
    path = folder(spark)
    table(spark, d, "part").map("concat(p_name, '@@', p_brand)").df.coalesce(2).write.option("lineSep", "@@").text(path)
    return Session.of(spark).plain_file(path, 4, "@@").df


@query("select p_name || '!@@' || p_brand as value from part")
def plain_file_exceptions(spark, d):
    path = folder(spark)
    table(spark, d, "part").map("concat(p_name, '!@@', p_brand)").df.coalesce(2).write.option("lineSep", "@@").text(path)
    return Session.of(spark).plain_file(path, 1, "@@!\\!").df


@query("select s_suppkey, s_name from supplier")
def json_array_roundtrip(spark, d):
    path = folder(spark)
    table(spark, d, "supplier", "s_suppkey", "s_name").save_as_json_file(path)
    got = Session.of(spark).partition_json_file(path, "struct<s_suppkey: bigint, s_name: string>")
    return got.map(["value.s_suppkey", "value.s_name"]).df


@query("select n_nationkey as value from nation")
def json_array_scalars(spark, d):
    path = folder(spark)
    table(spark, d, "nation", "n_nationkey").save_as_json_file(path, pretty=False)
    return Session.of(spark).partition_json_file(path).map(["cast(value as int) as value"]).df


@query("select c_custkey as key, c_name as value from customer")
def object_roundtrip(spark, d):
    path = folder(spark)
    pairs(spark, d, "customer", "c_custkey", "c_name").save_as_object_file(path, 9)
    return Session.of(spark).partition_object_file(path).df


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k, true as whole from events")
def json_dynamic(spark, d):
    v = variants.parse(F.col("props"))
    return table(spark, d, "events").map([F.col("event_id"), variants.get(v, "$.k", "int").alias("k"), variants.is_integer(F.try_variant_get(v, "$.k", "variant")).alias("whole")]).df


@query("select i as value from range(100) t(i)")
def parallelize_range(spark, d):
    return Session.of(spark).parallelize(range(100), 6).df


@query("select p * 25 + i as value from range(4) a(p), range(25) b(i)")
def execute_to_sequence(spark, d):
    return Session.of(spark).execute_to(lambda p: range(p * 25, p * 25 + 25), 4, "long").df


@query("select c_custkey, c_name from customer")
def import_dataset(spark, d):
    return Session.of(spark).import_dataset(table(spark, d, "customer", "c_custkey", "c_name")).df


# -- cache and functions


@query("select o_orderstatus as key, count(*) as value from orders group by 1")
def cache_reuse(spark, d):
    rows = pairs(spark, d, "orders", "o_orderstatus", "1L").persist(RAW_MEMORY)
    rows.count()
    rows.unpersist().persist(DISK)  # the result reads the copy on disk
    return rows.reduce_by_key("sum").df


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 150000")
def named_function_call(spark, d):
    register("orders_over", lambda data, least: data.filter(F.col("o_totalprice") > least).map(["o_orderkey", "o_totalprice"]))
    return Session.of(spark).call("orders_over", table(spark, d, "orders"), least=150000).df


class _Shifted(Function):
    def before(self, context):
        self.by = context.variables["by"]

    def call(self, x):
        return x + self.by


@query("select s_suppkey + 100 as value from supplier")
def function_life_cycle(spark, d):
    return table(spark, d, "supplier", "s_suppkey").with_variables(by=100).map(_Shifted(), "long").df


# -- actions for their effects


@query("select count(*) as rows, sum(s_suppkey)::bigint as total, count(*) as in_partitions, count(*) as in_executors from supplier")
def foreach_effects(spark, d):
    """foreach, foreach_partition and foreach_executor, seen through accumulators."""
    rows, zero = table(spark, d, "supplier", "s_suppkey").repartition(3), spark.sparkContext.accumulator
    n, total, inside, held = zero(0), zero(0), zero(0), zero(0)

    def each(x):
        n.add(1)
        total.add(x)

    rows.foreach(each)
    rows.foreach_partition(lambda items: inside.add(sum(1 for _ in items)))
    rows.foreach_executor(lambda parts: held.add(sum(map(len, parts))))
    return one_row(spark, "rows long, total long, in_partitions long, in_executors long", n.value, total.value, inside.value, held.value)


@query("select 2 as tasks, 6 as gathered")
def execute_gathers(spark, d):
    """Two tasks at the same time, which meet at a barrier and tell each other their numbers."""
    tasks, gathered = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def work(i, context):
        context.barrier()
        tasks.add(1)
        gathered.add(sum(map(int, context.all_gather(str(i + 1)))))

    Session.of(spark).execute(work, 2)
    return one_row(spark, "tasks int, gathered int", tasks.value, gathered.value)


@query("select s_name as value from supplier")
def void_function_call(spark, d):
    path = folder(spark)
    register("write_names", lambda data, to: data.save_as_text_file(to))
    Session.of(spark).void_call("write_names", table(spark, d, "supplier", "s_name"), to=path)
    return Session.of(spark).text_file(path).df


class _Counted(Function):
    def __init__(self, seen):
        self.seen = seen

    def before(self, context):
        self.seen.add(1)

    def call(self, x):
        return x


@query("select c_nationkey as value, true as prepared from customer union all select s_nationkey, true from supplier")
def union_prepared(spark, d):
    """A set-up function runs in the tasks that read the two sides."""
    seen = spark.sparkContext.accumulator(0)
    a, b = (table(spark, d, t, F.col(c).alias("value")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    both = a.union(b, src=_Counted(seen))
    both.count()
    return both.df.withColumn("prepared", F.lit(seen.value >= 2))


@query("select s_suppkey * 2 as value from supplier")
def function_by_path(spark, d):
    """A function named as path:Name in a Python file."""
    session = Session.of(spark)
    return table(spark, d, "supplier", "s_suppkey").map(session.load_function(f"{Path(__file__).with_name('sample_functions.py')}:Doubled"), "long").df
