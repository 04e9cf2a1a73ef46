"""Semantics that the oracles do not show."""

import pytest
from pyspark.sql import functions as F

from quillon.dataset import Dataset, PairDataset
from quillon.functions import variants
from quillon.functions.callables import Function
from quillon.session import Properties, parse_bool, parse_size


def test_null_keys_join_group_and_count(session):
    left = session.parallelize([(None, 1), ("a", 2)], 2, "key string, value int")
    right = session.parallelize([(None, 10), (None, 11), ("b", 12)], 2, "key string, value int")
    assert sorted((k, tuple(v.values())) for k, v in left.join(right).collect()) == [(None, (1, 10)), (None, (1, 11))]
    assert left.join(right, null_safe=False).collect() == []
    assert dict(right.group_by_key().map_values(lambda v: sorted(v), "array<int>").collect()) == {None: [10, 11], "b": [12]}
    assert right.count_by_key() == {None: 2, "b": 1}


def test_group_keeps_null_values(session):
    data = session.parallelize([("a", None), ("a", 1)], 2, "key string, value int")
    (key, values), = data.group_by_key().collect()
    assert key == "a" and sorted(values, key=str) == [1, None]


def test_falsy_accumulators_and_empty_partitions(session):
    data = session.parallelize([0, 0, 5], 8)
    assert data.reduce(lambda a, b: a * b) == 0
    assert session.parallelize(["", "x"], 6).reduce(lambda a, b: a + b) == "x"
    assert session.parallelize(["b", "a", "c"], 3).reduce(lambda a, b: a + b) == "bac"


def test_empty_collections(session):
    empty = session.parallelize([], 2, "long")
    with pytest.raises(ValueError):
        empty.reduce(lambda a, b: a + b)
    with pytest.raises(ValueError):
        empty.max()
    assert empty.fold(0, lambda a, b: a + b) == 0
    assert empty.count() == 0 and empty.collect() == [] and empty.distinct().collect() == []
    assert empty.sort_by(lambda a, b: a < b).collect() == []


def test_zero_is_copied_and_partitions_do_not_matter(session):
    data = session.parallelize([("a", 1), ("b", 2), ("a", 3)], 3)

    def add(acc, v):
        acc.append(v)
        return acc

    got = data.aggregate_by_key([], add, lambda a, b: a + b, "array<long>")
    assert {k: sorted(v) for k, v in got.collect()} == {"a": [1, 3], "b": [2]}
    for n in (1, 2, 5):
        assert session.parallelize(range(10), n).aggregate([], add, lambda a, b: a + b) == list(range(10))
        assert session.parallelize(range(100), n).tree_aggregate(0, lambda a, x: a + x, lambda a, b: a + b) == 4950


def test_key_held_by_many_tasks(session):
    data = session.parallelize([("hot" if i % 3 else f"k{i}", 1) for i in range(999)], 7)
    assert dict(data.reduce_by_key(lambda a, b: a + b).collect())["hot"] == 666
    assert dict(data.reduce_by_key(lambda a, b: a + b, local=False).collect())["hot"] == 666


def test_heterogeneous_input_is_an_error(session):
    with pytest.raises(TypeError):
        session.parallelize([1, "a"])


def test_parallelize_kinds(session):
    import numpy as np

    assert session.parallelize(b"\x00\xff", 2).collect() == [0, 255]
    assert session.parallelize(np.arange(5.0), 2).collect() == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert [len(list(x)) for x in session.parallelize(range(10), 3).df.rdd.glom().collect()] == [3, 3, 4]


def test_context_and_life_cycle(session, tmp_path):
    log = tmp_path / "log"

    class Logged(Function):
        def before(self, context):
            self.context = context
            log.open("a").write("before\n")

        def call(self, x):
            return x + self.context.variables["by"]

        def after(self, context):
            log.open("a").write("after\n")

    data = session.parallelize(range(4), 2).with_variables(by=10)
    assert data.map(Logged(), "long").collect() == [10, 11, 12, 13]
    assert sorted(log.read_text().split()) == ["after", "after", "before", "before"]
    assert data.map(lambda x, context: x * context.variables["by"], "long").collect() == [0, 10, 20, 30]


def test_foreach(session, tmp_path):
    seen = tmp_path / "seen"
    data = session.parallelize(range(6), 3)
    data.foreach(lambda x: seen.open("a").write(f"{x}\n"))
    assert sorted(map(int, seen.read_text().split())) == list(range(6))
    data.foreach_partition(lambda items: seen.open("a").write(f"p{sum(items)}\n"))
    data.foreach_executor(lambda parts: seen.open("a").write(f"e{len(parts)}\n"))
    assert seen.read_text().count("p") == 3 and "e3" in seen.read_text()


def test_execute_runs_every_task(session, tmp_path):
    session.execute(lambda i: (tmp_path / f"t{i}").write_text("x"), 2)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t0", "t1"]


def test_sort_nulls_and_comparator_ties(session):
    data = session.parallelize([3, None, 1], 2, "long")
    assert data.sort().collect() == [None, 1, 3] and data.sort(False).collect() == [3, 1, None]
    words = session.parallelize(["bb", "a", "cc", "ddd"], 3)
    assert [len(w) for w in words.sort_by(lambda a, b: len(a) < len(b), False, 2).collect()] == [3, 2, 2, 1]
    pairs = session.parallelize([("b", 1), ("a", 2), ("c", 3)], 2)
    assert [k for k, _ in pairs.sort_by_key(less=lambda a, b: a > b).collect()] == ["c", "b", "a"]


def test_samples(session):
    data = session.parallelize(range(100), 4)
    assert len(set(data.sample(0.25, 3).collect())) == 25
    assert len(data.take_sample(30, 3, replacement=True)) == 30
    pairs = session.parallelize([("a" if i % 4 else "b", i) for i in range(100)], 3)
    got = pairs.sample_by_key({"a": 0.5}, 1).collect()
    assert len(got) == 37 and {k for k, _ in got} == {"a"}
    assert len(pairs.sample_by_key({"a": 0.2, "b": 1.0}, 1, replacement=True).collect()) == 15 + 25


def test_repartition(session):
    data = session.parallelize(range(103), 5)
    ordered = data.repartition(4, preserve_ordering=True)
    assert ordered.collect() == list(range(103))
    assert sorted(ordered.count_by_partition().values()) == [25, 26, 26, 26]
    assert data.repartition(2, everywhere=False).partitions() == 2
    assert data.partition_by(lambda x: x, 3).count_by_partition() == {0: 35, 1: 34, 2: 34}


def test_ordered_union(session):
    a, b = session.parallelize([3, 1], 2), session.parallelize([2, 1], 1)
    assert a.union(b, preserve_order=True).collect() == [3, 1, 2, 1]
    assert sorted(a.union(b).collect()) == [1, 1, 2, 3]


def test_text_ends_and_carriage_returns(session, tmp_path):
    (tmp_path / "a.txt").write_bytes("x\r\ny\nz".encode())
    assert sorted(session.text_file(str(tmp_path)).collect()) == ["x\r", "y", "z"]


def test_plain_file_exceptions(session, tmp_path):
    (tmp_path / "a.txt").write_text("one@@two!@@still@@@@last")
    assert session.plain_file(str(tmp_path), 1, "@@!\\!").collect() == ["one", "two!@@still", "", "last"]
    assert session.plain_file(str(tmp_path), 1, "@@").collect() == ["one", "two!", "still", "", "last"]


def test_overwrite_policy(session, tmp_path):
    data, path = session.parallelize(range(3), 2), str(tmp_path / "out")
    data.save_as_text_file(path)
    with pytest.raises(Exception, match="(?i)exist"):
        data.save_as_text_file(path)
    data.save_as_text_file(path, overwrite=True)
    assert sorted(session.text_file(path).collect()) == ["0", "1", "2"]
    data.save_as_text_file(path, append=True)
    assert session.text_file(path).count() == 6


def test_json_arrays(session, tmp_path):
    import glob
    import json

    path = str(tmp_path / "j")
    session.parallelize([("a", 1), (None, 2)], 2).save_as_json_file(path)
    found = [x for f in sorted(glob.glob(path + "/part*")) for x in json.load(open(f))]
    assert found == [{"key": "a", "value": 1}, {"key": None, "value": 2}]
    empty = str(tmp_path / "e")
    session.parallelize([], 1, "long").save_as_json_file(empty)
    assert session.partition_json_file(empty).collect() == []


def test_object_file_levels(session, tmp_path):
    pairs = session.parallelize([("a", [1, 2]), ("b", [])], 2, "key string, value array<long>")
    for level in (0, 9):
        path = str(tmp_path / str(level))
        pairs.save_as_object_file(path, level)
        assert sorted(session.partition_object_file(path).collect()) == [("a", [1, 2]), ("b", [])]
    with pytest.raises(ValueError):
        pairs.save_as_object_file(str(tmp_path / "x"), 10)


def test_variants(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("[1.5]",), ("null",), ('"s"',), ("true",)], "t string")
    v = variants.parse(F.col("t"))
    rows = df.select("t", variants.is_dict(v), variants.is_array(v), variants.is_null(v), variants.is_string(v), variants.is_boolean(v)).collect()
    assert [list(r[1:]).index(True) for r in rows] == [0, 1, 2, 3, 4]


def test_pairs_and_equality(session):
    data = session.parallelize([(1, "a")], 1)
    assert isinstance(data, PairDataset) and data.keys() == [1] and data.values() == ["a"]
    assert Dataset(data.df) == Dataset(data.df)
    with pytest.raises(ValueError):
        session.parallelize([1, 2], 1).to_pair()


def test_expressions_are_pushed_down(spark):
    rows = Dataset(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")).filter("l_quantity > 45").map(["l_orderkey"])
    plan = rows.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "l_comment" not in plan


def test_properties(tmp_path):
    p = Properties({"a": 1})
    p["size"] = "10MB"
    p.store(str(tmp_path / "p"))
    q = Properties()
    q.load(str(tmp_path / "p"))
    assert q.to_map() == p.to_map() and q.size("size") == 10_000_000 and "a" in q and len(q) == 2
    assert parse_size("1GiB") == 1 << 30 and parse_size("8Kb") == 1000 and parse_size("1,5K") == 1500
    assert parse_bool("yes") and not parse_bool("False")
    with pytest.raises(ValueError):
        parse_size("ten")


def test_streaming_counts(spark, tmp_path):
    from quillon.streaming import windowed_counts

    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").write_bytes(open("/root/testdata/sf0.001/events.parquet", "rb").read())
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = windowed_counts(stream, "ts", "1 day", "2 days", "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counts").first()[0] == 1000


def test_samples_by_cut_points(session, monkeypatch):
    from quillon.operators import sampling

    monkeypatch.setattr(sampling, "FEW", 1)
    rows = session.parallelize([(None if i % 5 == 0 else "hot" if i % 5 < 4 else "b", i % 150) for i in range(600)], 4, "key string, value long")
    got = rows.sample_by_key({"hot": 0.33, "b": 1.0, None: 0.5, "none": 0.5}, 2, order="value").collect()
    assert {k: sum(1 for x, _ in got if x == k) for k in ("hot", "b", None)} == {"hot": 118, "b": 120, None: 60} and len(got) == 298
    numbers = session.parallelize(range(500), 3)
    for n in (0, 1, 77, 499, 500, 900):
        found = numbers.take_sample(n, 4, key="value")
        assert len(found) == len(set(found)) == min(n, 500)
    assert set(numbers.take_sample(77, 4, key="value")) < set(numbers.take_sample(300, 4, key="value"))
    same = session.parallelize([7] * 90, 3)
    assert same.sample(0.5, 1, key="value").collect() == [7] * 45
