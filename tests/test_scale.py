"""Order, indices, keys and parameters where they are easily lost: many rows, many partitions, odd keys."""

import math
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillon.dataset import Dataset
from quillon.functions.callables import Function
from quillon.operators import keyed, sampling
from quillon.session import Session
from quillon.shared import shared_dir

ROWS = 1_500_000
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test


def scattered(spark):
    """Distinct numbers in no order, over several partitions."""
    return spark.range(ROWS).select(((F.col("id") * 7919) % ROWS).alias("x"), F.lit("payload").alias("p"))


@pytest.mark.parametrize("partitions", [None, 3, 64])
def test_index_of_a_sorted_dataset_is_dense_and_in_order(spark, partitions):
    indexed = Dataset(scattered(spark), Session.of(spark)).sort_by("x", partitions=partitions).map_with_index(["idx", "x"]).df
    r = indexed.agg(F.count("*"), F.count_distinct("idx"), F.min("idx"), F.max("idx"), F.sum((F.col("idx") != F.col("x")).cast("int"))).first()
    assert tuple(r) == (ROWS, ROWS, 0, ROWS - 1, 0)


def test_ordered_repartition_is_even_and_ordered(spark):
    placed = Dataset(scattered(spark).select("x"), Session.of(spark)).sort().repartition(7, preserve_ordering=True)
    parts = placed.df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("p").collect()
    assert len(parts) == 7 and max(r["n"] for r in parts) - min(r["n"] for r in parts) <= 1
    assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:]))
    assert placed.take(3) == [0, 1, 2]


def test_ordered_union_of_many_rows(spark):
    a = Dataset(scattered(spark).select("x"), Session.of(spark)).sort()
    b = Dataset(spark.range(0, 200_000, 1, 9).select(F.col("id").alias("y")), Session.of(spark)).sort(False)
    both = a.union(b, preserve_order=True).map_with_index(["idx", "x"]).df
    want = F.when(F.col("idx") < ROWS, F.col("idx")).otherwise(ROWS + 199_999 - F.col("idx"))
    assert both.where(F.col("x") != want).count() == 0 and both.count() == ROWS + 200_000


def test_samples_are_exact_over_shuffled_rows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CHUNK", 1000)
    rows = Dataset(scattered(spark).select("x").repartition(9), Session.of(spark))
    some = rows.sample(0.01, 5)
    assert some.count() == some.df.distinct().count() == ROWS // 100
    assert rows.take_sample(20_000, 6).__len__() == 20_000
    drawn = rows.sample(0.02, 5, replacement=True)
    assert drawn.count() == ROWS // 50 and 29_000 < drawn.df.distinct().count() < ROWS // 50
    keyed = Dataset(rows.df.select((F.col("x") % 3).alias("key"), F.col("x").alias("value")), rows.session).to_pair()
    got = keyed.sample_by_key({0: 0.01, 2: 0.5, 9: 1.0}, 4, replacement=True).df.groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in got} == {0: 5000, 2: 250_000}


def test_keys_that_python_cannot_hash(session):
    nan = float("nan")
    rows = session.parallelize([(nan, 1), (1.0, 2), (nan, 3), (-0.0, 4), (0.0, 5), (None, 6), (None, 7)], 3, "key double, value long")
    for local in (True, False):
        got = sorted(rows.reduce_by_key(lambda a, b: a + b, local=local).collect(), key=repr)
        assert [v for k, v in got if k is not None and math.isnan(k)] == [4] and {k: v for k, v in got if k is None or not math.isnan(k)} == {1.0: 2, 0.0: 9, None: 13}
    arrays = session.parallelize([([1, None], 1), ([1, None], 2), ([], 3), (None, 4)], 2, "key array<long>, value long")
    assert sorted(arrays.fold_by_key(0, lambda a, b: a + b).collect(), key=repr) == sorted([([1, None], 3), ([], 3), (None, 4)], key=repr)
    structs = Dataset(arrays.df.selectExpr("struct(key as a, 1.5 as b) as key", "value"), session).to_pair()
    assert sorted(v for _, v in structs.aggregate_by_key(0, lambda n, _: n + 1, lambda a, b: a + b, "long").collect()) == [1, 1, 2]
    assert arrays.count_by_key() == {(1, None): 2, (): 1, None: 1} and dict(rows.value_counts().collect())[1] == 1


class _Mod(Function):
    """Needs its set-up: fails where a context or its variables are not passed on."""

    def before(self, context):
        self.by = context.variables["by"]

    def call(self, a, b):
        return (a + b) % self.by


class _Less(_Mod):
    def call(self, a, b):
        return a % self.by < b % self.by


def test_variables_reach_every_kind_of_function(session):
    data = session.parallelize(range(100), 6).with_variables(by=7)
    want = sum(range(100)) % 7
    assert data.reduce(_Mod()) == data.tree_reduce(_Mod()) == data.fold(0, _Mod()) == data.tree_fold(0, _Mod()) == want
    assert data.aggregate(0, _Mod(), _Mod()) == data.tree_aggregate(0, _Mod(), _Mod()) == want
    pairs = data.key_by("value % 2").map_values("value")
    by_key = {k: sum(range(k, 100, 2)) % 7 for k in (0, 1)}
    assert dict(pairs.reduce_by_key(_Mod()).collect()) == dict(pairs.fold_by_key(0, _Mod()).collect()) == by_key
    assert dict(pairs.aggregate_by_key(0, _Mod(), _Mod(), "long").collect()) == by_key
    assert [x % 7 for x in data.sort_by(_Less()).collect()] == sorted(x % 7 for x in range(100))
    assert [x % 7 for x in data.top(3, _Less())] == [6, 6, 6] and data.min(_Less()) % 7 == 0
    assert [k % 7 for k, _ in data.key_by("value").sort_by_key(less=_Less()).collect()] == sorted(x % 7 for x in range(100))
    assert len(data.partition_by(lambda x, context: x % context.variables["by"], 7).count_by_partition()) == 7


@pytest.fixture()
def all_tasks(spark):
    """Small partitions are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_frequent_key_is_folded_by_many_tasks_after_the_shuffle(spark, all_tasks):
    rows = spark.range(0, 40_000, 1, 8).select(F.lit("hot").alias("key"), F.expr("cast(array() as array<int>)").alias("value"))
    pairs = Dataset(rows, Session.of(spark)).to_pair()
    seen = lambda a, b, context: sorted({*a, *b, context.partition})
    for got in (pairs.fold_by_key([], seen, local=False), pairs.reduce_by_key(seen, local=False)):
        [(key, tasks)] = got.collect()
        assert key == "hot" and len(tasks) > 2


def test_folds_after_the_shuffle_send_on_what_they_hold(spark, all_tasks, monkeypatch):
    monkeypatch.setattr(keyed, "HELD", 50)
    monkeypatch.setattr(keyed, "FOLDED", 300)
    rows = spark.range(0, 20_000, 1, 5).selectExpr("if(id % 2 = 0, null, id % 997) as key", "id as value")
    want = {r["key"]: r["v"] for r in rows.groupBy("key").agg(F.sum("value").alias("v")).collect()}
    pairs = Dataset(rows, Session.of(spark)).to_pair()
    for got in (pairs.fold_by_key(0, lambda a, b: a + b, local=False), pairs.reduce_by_key(lambda a, b: a + b, local=False, partitions=3)):
        found = got.collect()
        assert len(found) == len(want) and dict(found) == want
    assert dict(Dataset(rows.limit(0), Session.of(spark)).to_pair().fold_by_key(0, lambda a, b: a + b, local=False).collect()) == {}


def test_a_shuffled_fold_to_another_type_joins_no_accumulators(session):
    words = session.parallelize([("a", "xy"), ("b", "z"), ("a", "xyz"), ("a", None)], 3, "key string, value string")
    length = lambda n, s: n + len(s or "")
    assert dict(words.fold_by_key(0, length, "long", local=False).collect()) == {"a": 5, "b": 1}
    assert dict(words.aggregate_by_key(0, length, schema="value long").collect()) == {"a": 5, "b": 1}


class _Once(Function):
    """Fails where it is set up twice."""

    ready = False

    def before(self, context):
        assert not self.ready
        self.ready = True

    def call(self, a, b):
        return a + b

    def after(self, context):
        self.ready = False


@pytest.mark.parametrize("local", [True, False])
def test_the_function_of_a_fold_is_set_up_once_a_task(session, local):
    pairs = session.parallelize([(i % 3, i) for i in range(30)], 4, "key long, value long")
    assert dict(pairs.fold_by_key(0, _Once(), local=local).collect()) == {k: sum(range(k, 30, 3)) for k in range(3)}


def test_a_file_keeps_its_order_in_splits(session, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(50_000)))
    lines = session.text_file(str(tmp_path / "a.txt"), 8)
    assert lines.partitions() >= 8 and lines.collect() == [str(i) for i in range(50_000)]
    records = session.plain_file(str(tmp_path / "a.txt"), 5, "9\n")
    assert records.partitions() >= 5 and "9\n".join(records.collect()) == (tmp_path / "a.txt").read_text()[:-2]


def test_a_partition_for_each_part_file(session, tmp_path):
    path = str(tmp_path / "t")
    data = session.parallelize(range(1000), 5)
    data.save_as_text_file(path)
    data.save_as_json_file(path + "j")
    text, json = session.partition_text_file(path), session.partition_json_file(path + "j", "bigint")
    assert text.partitions() == json.partitions() == 5
    assert text.collect() == [str(i) for i in range(1000)] and json.collect() == list(range(1000))
    assert list(text.count_by_partition().values()) == [200] * 5


def test_odd_file_names_and_empty_files(session, tmp_path):
    for i, n in enumerate(["a b", "c%20d", "é+x", "p#q", "zz"]):
        (tmp_path / f"{n}.txt").write_text(f"{n}1\n{n}2\n" if i < 4 else "")
    got = session.partition_text_file(str(tmp_path))
    names = sorted(["a b", "c%20d", "é+x", "p#q"], key=lambda n: n.replace("%", "%25").replace(" ", "%20").replace("#", "%23"))
    assert got.partitions() == 5 and got.collect() == [f"{n}{k}" for n in names for k in (1, 2)]


def test_tasks_meet_and_tell_each_other(session, tmp_path):
    def work(i, context):
        context.barrier()
        (tmp_path / f"t{i}").write_text(",".join(context.all_gather(f"m{i}")))

    session.execute(work, 3)
    assert {p.read_text() for p in tmp_path.iterdir()} == {"m0,m1,m2"}


def test_commands_run_in_tasks(session, tmp_path):
    session.run_command("sh", "-c", f"mktemp {tmp_path}/ran.XXXXXX", tasks=2)
    assert len(list(tmp_path.iterdir())) == 2
    with pytest.raises(Exception, match="CalledProcessError"):
        session.run_command("false", tasks=1)


def test_files_and_libraries_reach_tasks(session, tmp_path):
    from pyspark import SparkFiles

    (tmp_path / "sent.txt").write_text("seven")
    (tmp_path / "lib_of_mine.py").write_text("def times(x):\n    return 7 * x\n")
    session.send_file(str(tmp_path / "sent.txt"))
    session.load_library(str(tmp_path / "lib_of_mine.py"))

    def read(x):
        import lib_of_mine

        with open(SparkFiles.get("sent.txt")) as f:
            return f"{f.read()} {lib_of_mine.times(x)}"

    assert session.parallelize([1, 2], 2).map(read, "string").collect() == ["seven 7", "seven 14"] and session.executors() == 1


def test_names_caches_and_checkpoints(session, spark):
    from quillon.dataset import DISK, MEMORY, NO_CACHE, RAW_MEMORY

    data = session.parallelize([3, 1, 2], 2)
    assert data.set_name("numbers").df.select("numbers.value").count() == 3
    for level in (MEMORY, RAW_MEMORY, DISK):
        assert data.persist(level).count() == 3 and data.df.storageLevel.useDisk == (level != RAW_MEMORY)
        assert not data.persist(NO_CACHE).df.is_cached
    kept = data.sort().checkpoint()
    assert kept.collect() == [1, 2, 3] and "LogicalRDD" in kept.df._jdf.queryExecution().optimizedPlan().toString()


def test_functions_by_path(session, tmp_path):
    (tmp_path / "some_functions_of_mine.py").write_text("__all__ = ['plus', 'only']\ndef plus(data, n):\n    return data.map(f'value + {n}')\ndef only(x):\n    return x > 3\n")
    where = str(tmp_path / "some_functions_of_mine.py")
    data = session.parallelize(range(5), 2)
    assert data.filter(session.load_function(f"{where}:only")).collect() == [4]
    assert session.load_functions(where) == ["plus", "only"] and session.call("plus", data, n=2).collect() == [2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        session.load_function(str(tmp_path / "none.py") + ":x")


class _Seen(Function):
    def __init__(self, log):
        self.log = log

    def before(self, context):
        with open(self.log, "a") as f:
            f.write("x")

    def call(self, x):
        return x


def test_set_up_functions_of_joins_and_sets(session, tmp_path):
    log = tmp_path / "log"
    a, b = (session.parallelize([("k", i), ("l", i)], 2) for i in (1, 2))
    for make in (lambda: a.join(b, src=_Seen(log)), lambda: a.union(b, src=_Seen(log)), lambda: a.distinct(src=_Seen(log)), lambda: a.group_by_key(src=_Seen(log)), lambda: session.parallelize(range(3), 2, src=_Seen(log))):
        log.write_text("")
        assert make().collect() and "x" in log.read_text()


def test_local_repartition_grows_too(session):
    data = session.parallelize(range(100), 2)
    assert data.repartition(5, everywhere=False).partitions() == 5 and sorted(data.repartition(5, everywhere=False).collect()) == list(range(100))
    assert data.approx_size() > 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Spark:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Spark)
