import random

import pytest
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import bloom, dictionary, ordinals, scalars
from tidelog.metrics import Profiler, summary
from tidelog.operators import merge, predicates, scan
from tidelog.plans import levels
from tidelog.sources import runs


def log(spark, *rows):
    """Rows (k, c1, epoch) with c1 None for a tombstone; the place in the list is the sequence."""
    full = [(k, c1, epoch, i, c1 is None) for i, (k, c1, epoch) in enumerate(rows)]
    return spark.createDataFrame(full, model.log_schema(["c1"]))


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_last_write_wins(spark):
    rows = [(str(i % 200), str(i), i) for i in range(2048)]
    got = dict(pairs(model.state(log(spark, *rows))))
    assert got == {str(k): str(2000 + k if k < 48 else 1800 + k) for k in range(200)}


def test_tombstones_hide_older_versions(spark):
    df = log(spark, ("a", "1", 1), ("b", "1", 1), ("a", None, 2), ("a", "2", 4))
    assert [pairs(model.state(df, e)) for e in (1, 2, 3, 4)] == [[("a", "1"), ("b", "1")], [("b", "1")], [("b", "1")], [("a", "2"), ("b", "1")]]


def test_a_filter_sees_the_newest_version_only(spark):
    df = log(spark, ("a", "x", 1), ("a", "z", 2))
    assert pairs(predicates.value_range(model.state(df), "c1", "w", "y")) == []


@pytest.mark.parametrize(("lo", "hi", "n"), [("a", "b", 0), ("x", "z", 0), ("f", "f", 1), ("g", "e", 0), ("a", "z", 3)])
def test_range_edges_on_strings_and_codes(spark, lo, hi, n):
    state = model.state(log(spark, ("1", "d", 1), ("2", "f", 1), ("3", "h", 1), ("4", "", 1)))
    d = dictionary.build(state, "c1")
    assert predicates.value_range(state, "c1", lo, hi).count() == n
    assert predicates.code_range(dictionary.encode(state, "c1", d), "code", d, lo, hi).count() == n


def test_lexicographic_ranges(spark):
    rows = [(str(j), str(j % 100), 1) for j in range(10_005)]
    state = model.state(log(spark, *rows))
    assert predicates.value_range(state, "c1", "9", "10").count() == 0
    assert {r["c1"] for r in predicates.value_range(state, "c1", "10", "11").collect()} == {"10", "11"}
    assert predicates.value_range(state, "c1", "3", "3").count() == 101


def test_byte_order_of_keys(spark):
    state = model.state(log(spark, *[(k, "v", 1) for k in ("a", "é", "B", "z", "aa")]))
    assert [r["k"] for r in scan.scan_k(state, 9, "").collect()] == ["B", "a", "aa", "z", "é"]
    assert [r["k"] for r in scan.iterate(state, "a").orderBy("position").collect()] == ["a", "aa", "z", "é"]


def test_bad_keys_are_refused(spark):
    for key in ("x" * 17, "é" * 9, "a\0"):
        with pytest.raises(Exception, match="bad key"):
            model.checked(log(spark, (key, "1", 1))).collect()
    assert model.checked(log(spark, ("x" * 16, "1", 1))).count() == 1


def test_same_epoch_goes_by_sequence(spark):
    assert pairs(model.state(log(spark, ("k", "1", 5), ("k", "2", 5)))) == [("k", "2")]


def test_first_k(spark):
    state = model.state(log(spark, ("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("b", None, 2)))
    assert [[r["k"] for r in scan.scan_k(state, k, "a").collect()] for k in (0, 1, 2, 9)] == [[], ["a"], ["a", "c"], ["a", "c"]]


def test_dictionary(spark):
    df = spark.createDataFrame([("b",), ("a",), ("",), ("b",), ("c",), (None,)], "v string")
    d = dictionary.build(df, "v")
    assert pairs(d) == [("a", 0), ("b", 1), ("c", 2)]
    coded = dictionary.encode(df, "v", d)
    assert sorted(r["code"] for r in coded.collect()) == [-1, -1, 0, 1, 1, 2]
    back = dictionary.decode(coded, "code", d, "w").collect()
    assert all((r["v"] or "") == r["w"] for r in back)
    more = dictionary.build(spark.createDataFrame([("aa",), ("c",)], "v string"), "v")
    assert pairs(dictionary.merge(d, more)) == [("a", 0), ("aa", 1), ("b", 2), ("c", 3)]


def test_ranks_do_not_depend_on_the_cuts(spark):
    values = [f"{random.Random(i).random():.9f}" for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for pieces in (1, 2, 7, 64):
        got = {r["v"]: r["n"] for r in ordinals.with_rank(df, "v", "n", pieces).collect()}
        assert got == {v: i for i, v in enumerate(sorted(values))}
    assert ordinals.with_rank(df.limit(0), "v", "n").collect() == []


def test_two_columns_survive_a_merge(spark):
    schema = model.log_schema(["c1", "c2"])
    a = spark.createDataFrame([("a", "x", "p", 1, 0, False), ("b", "y", "q", 1, 0, False)], schema)
    b = spark.createDataFrame([("a", "z", "r", 2, 0, False)], schema)
    assert pairs(model.state(merge.compact(a, b, bottom=True))) == [("a", "z", "r"), ("b", "y", "q")]


def test_compaction_keeps_what_an_open_snapshot_sees(spark):
    df = log(spark, ("a", "1", 1), ("b", "1", 1), ("a", None, 3))
    merged = merge.compact(df, bottom=True, oldest_open=2)
    assert pairs(model.state(merged, 2)) == pairs(model.state(df, 2)) == [("a", "1"), ("b", "1")]
    assert pairs(model.state(merged)) == [("b", "1")]
    assert merge.compact(df, bottom=True).count() == 1


def test_random_operations_match_a_dict(spark):
    rng = random.Random(4)
    rows, at = [], {}
    now: dict = {}
    for epoch in range(1, 400):
        k = str(rng.randrange(30))
        v = None if rng.random() < 0.3 else str(rng.randrange(50))
        rows.append((k, v, epoch))
        now = {**now, k: v} if v is not None else {a: b for a, b in now.items() if a != k}
        at[epoch] = now
    df = log(spark, *rows).cache()
    for epoch in (1, 57, 200, 399):
        assert dict(pairs(model.state(df, epoch))) == at[epoch]
    cut = [df.where((F.col("epoch") > lo) & (F.col("epoch") <= lo + 100)) for lo in range(0, 400, 100)]
    runs_ = [merge.compact(c, bottom=False) for c in cut]
    assert dict(pairs(model.state(merge.union_runs(*runs_)))) == at[399]
    assert dict(pairs(merge.compact(*runs_, bottom=True).select("k", "c1"))) == at[399]


def test_scalars(spark):
    row = spark.createDataFrame([("abc", 12)], "k string, n int").select(scalars.fixed(F.col("k"), 5).alias("f"), scalars.unfixed(scalars.fixed(F.col("k"))).alias("u"), scalars.highest_bit(F.col("n")).alias("h"), scalars.power(F.col("n"), F.lit(3)).alias("p")).first()
    assert tuple(row) == ("abc\0\0", "abc", 3, 1728)


def test_bloom_filters_miss_nothing_and_rule_out_most(spark):
    keys = spark.range(2000).select(F.lit("r").alias("run"), F.col("id").cast("string").alias("k"))
    filters = bloom.build(keys, "run")
    assert bloom.may_hold(filters, "run", keys).count() == 2000
    others = spark.range(5000, 9000).select(F.lit("r").alias("run"), F.col("id").cast("string").alias("k"))
    assert bloom.may_hold(filters, "run", others).count() < 4000 * 0.03


def test_exact_percentile_place(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 1.0)] * 3, "op string, v double")
    assert pairs(summary(df, F.col("op"), F.col("v"))) == [("a", 100, 4950.0, 99.0), ("b", 3, 3.0, 1.0)]
    p = Profiler()
    with p.timed("x"):
        pass
    assert p.summary(spark).first()["n"] == 1


def test_level_policy(spark):
    files = [(0, "a", "1", "3", 1, 1), (0, "b", "2", "9", 1, 1)] + [(1, f"r{i}", f"{i}", f"{i}5", 1, 1) for i in range(1, 6)] + [(2, "t", "1", "3", 1, 1)]
    m = spark.createDataFrame(files, "level int, run_id string, key_min string, key_max string, key_num long, bytes long")
    assert pairs(levels.pick(m, 0)) == [("source", 0, "a"), ("source", 0, "b")] + [("target", 1, f"r{i}") for i in range(1, 6)]
    assert pairs(levels.pick(m, 1)) == [("source", 1, "r4")]  # the first that meets nothing below
    assert pairs(levels.pick(m, 2)) == []
    assert {r["level"]: r["stalled"] for r in levels.level_sizes(m).collect()} == {0: False, 1: False, 2: False}


def test_runs_are_sorted_and_pruned(spark, tmp_path):
    df = model.log_of(spark.range(5000), F.col("id"), {"c1": F.col("id") % 7}, F.col("id"))
    path = f"{tmp_path}/run"
    runs.write_run(df, path, partitions=3)
    key_min, key_max, key_num, versions, size, epoch = runs.describe(spark, path)
    assert (key_min, key_max, key_num, versions, epoch) == ("0", "999", 5000, 5000, 4999) and size > 0
    back = runs.read_run(spark, path)
    assert "EqualTo(k,77)" in back.where("k = '77'")._jdf.queryExecution().toString()
    assert pairs(back.select("k")) == pairs(df.select("k"))
