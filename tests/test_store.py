import pytest
from pyspark.sql import functions as F

from tidelog import model
from tidelog.plans import levels
from tidelog.sources import runs
from tidelog.sources.store import Store
from tidelog.streaming.ingest import ingest


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def put(store, rows):
    with store.begin() as txn:
        txn.put(store.spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["k", *store.columns])))


def test_transactions(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", ["c1"])
    put(store, [("a", "1"), ("b", "2"), ("c", "3")])
    old = store.begin_read_only()
    writer = store.begin()
    writer.put_one("a", "9")
    assert writer.get("a")["c1"] == "1"  # its own writes are not visible
    reader = store.begin_read_only()
    writer.close()
    assert reader.get("a")["c1"] == "1" and store.begin_read_only().get("a")["c1"] == "9"
    with store.begin() as txn:
        txn.delete_one("b")
    assert store.flush() and not store.flush()
    put(store, [("d", "4")])
    store.flush()
    assert store.compact(0) and not store.compact(1)
    now = [("a", "9"), ("c", "3"), ("d", "4")]
    assert pairs(store.snapshot()) == now and pairs(old.scan()) == [("a", "1"), ("b", "2"), ("c", "3")]
    assert [r["k"] for r in store.begin_read_only().iterate("b")] == ["c", "d"]
    assert pairs(store.begin_read_only().value_range("c1", "3", "4")) == [("c", "3"), ("d", "4")]
    store.vacuum()
    again = Store(spark, f"{tmp_path}/s", ["c1"])
    assert pairs(again.snapshot()) == now and again.epoch >= store.epoch - 1
    with pytest.raises(PermissionError):
        again.begin_read_only().put_one("z", "1")
    assert {r["op"] for r in store.profiler.summary(spark).collect()} >= {"flush", "compact", "get"}


def test_an_open_writer_hides_everything_after_it(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", ["c1"])
    first = store.begin()
    first.put_one("a", "1")
    assert store.begin().get("a") is None
    put(store, [("b", "1")])
    assert store.begin_read_only().get("b") is None
    store.flush()
    first.close()
    assert Store(spark, f"{tmp_path}/s", ["c1"]).snapshot().count() == 2


def test_stream_ingest(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", ["c1"])
    source = f"{tmp_path}/in"
    for rows in ([("a", "1", False), ("b", "1", False)], [("a", "2", False), ("b", None, True)]):
        spark.createDataFrame(rows, "k string, c1 string, deleted boolean").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, c1 string, deleted boolean").parquet(source)
        done = ingest(stream, store, flush_every=1).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
        done.awaitTermination()
    assert pairs(store.snapshot()) == [("a", "2")]
    assert store.log().where(F.col("deleted")).count() <= 1


def reader(store):
    return store.begin_read_only()


@pytest.mark.parametrize("step", ["none", "flush", "compact"])
def test_interleaved_writers_read_alike_whatever_is_merged_between(spark, tmp_path, step):
    """A merge may drop no version that becomes readable when a writer ends."""
    store = Store(spark, f"{tmp_path}/s", ["c1"])
    put(store, [("a", "old"), ("z", "old")])

    def merge_now():
        if step != "none":
            store.flush()
        if step == "compact":
            store.compact(0)

    merge_now()
    first, second, third = store.begin(), store.begin(), store.begin()
    first.put_one("a", "first")
    second.put_one("a", "second")
    third.delete_one("a")
    merge_now()
    third.close()
    merge_now()
    assert reader(store).get("a")["c1"] == "old"
    first.close()
    merge_now()
    assert reader(store).get("a")["c1"] == "first"
    second.close()
    merge_now()
    assert reader(store).get("a") is None and pairs(store.snapshot()) == [("z", "old")]
    merge_now()
    assert pairs(Store(spark, f"{tmp_path}/s", ["c1"]).snapshot()) == [("z", "old")]


def test_a_late_older_write_does_not_come_back_over_a_dropped_tombstone(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", ["c1"])
    early = store.begin()
    early.put_one("a", "1")
    with store.begin() as late:
        late.delete_one("a")
    store.flush()
    store.compact(0)
    early.close()
    store.flush()
    store.compact(0)
    assert store.snapshot().count() == 0


def test_an_exception_takes_all_writes_of_a_transaction_back(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", ["c1"])
    put(store, [("a", "1")])
    with pytest.raises(RuntimeError), store.begin() as txn:
        txn.put_one("a", "2")
        txn.put_one("b", "2")
        store.flush()
        raise RuntimeError
    assert pairs(store.snapshot()) == [("a", "1")] and not store.active
    with pytest.raises(PermissionError):
        txn.put_one("c", "1")
    assert pairs(Store(spark, f"{tmp_path}/s", ["c1"]).snapshot()) == [("a", "1")]


def small(rows, **more):
    return model.Options(rows_per_run=rows, **more)


def keys(lo, hi, value="v"):
    return [(f"{i:04d}", f"{value}{i % 7}") for i in range(lo, hi)]


def test_compaction_rewrites_only_the_ranges_it_meets(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", ["c1"], small(100, maintain=False))
    put(store, keys(0, 1000))
    store.flush()
    assert sum(f["level"] == 0 for f in store.files) >= 8
    store.compact(0)
    before = {f["path"] for f in store.files if f["level"] == 1}
    order = sorted((f["key_min"], f["key_max"]) for f in store.files)
    assert all(a[1] < b[0] for a, b in zip(order, order[1:], strict=False)) and sum(f["key_num"] for f in store.files) == 1000
    put(store, keys(410, 415, "w"))
    store.flush()
    store.compact(0)
    after = {f["path"] for f in store.files if f["level"] == 1}
    assert len(before - after) <= 2 and len(before & after) >= len(before) - 2 and not any(f["level"] == 0 for f in store.files)
    got = dict(pairs(store.snapshot()))
    assert len(got) == 1000 and got["0412"] == "w6" and got["0415"] == "v2"


def test_reads_open_only_files_that_may_hold_their_keys(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", ["c1"], small(100, maintain=False))
    put(store, keys(0, 1000))
    store.flush()
    read, every = reader(store), len(store.files)
    assert every >= 8 and len(read.scan().inputFiles()) == every
    assert len(read.state("0500", "0500").inputFiles()) == 1 and read.get("0500")["c1"] == "v3"
    assert len(read.key_range("0300", "0310").inputFiles()) <= 2 and read.key_range("0300", "0310").count() == 11
    assert len(read.state("0900").inputFiles()) <= 3 and [r["k"] for r in read.scan_k(3, "0950").collect()] == ["0950", "0951", "0952"]
    assert read.get("nope") is None


def test_ranges_of_codes_give_the_rows_of_ranges_of_values(spark, tmp_path):
    """On runs, overlapping runs, slices, tombstones, stale matches and absent values."""
    store = Store(spark, f"{tmp_path}/s", ["c1", "c2"], small(60, maintain=False))
    put(store, [(f"{i:03d}", f"x{i % 9}", "" if i % 5 == 0 else f"y{i % 4}") for i in range(200)])
    store.flush()
    store.compact(0)
    put(store, [(f"{i:03d}", f"x{i % 3}", None) for i in range(20, 60)])
    store.flush()
    with store.begin() as txn:
        txn.put(spark.createDataFrame([("100", "x1", "zz"), ("999", "x4", "y1")], ["k", "c1", "c2"]))
        txn.delete(spark.createDataFrame([("010",), ("130",)], "k string"))
    read = reader(store)
    for column, lo, hi in (("c1", "x1", "x3"), ("c1", "x", "x0"), ("c1", "x5", "x2"), ("c2", "y1", "y1"), ("c2", "", "zzz"), ("c1", "a", "b")):
        want = pairs(read.where((F.col(column) != "") & F.col(column).between(lo, hi)))
        assert pairs(read.value_range(column, lo, hi)) == want
    both = read.select({"c1": lambda v: v.between("x1", "x4"), "c2": lambda v: v >= "y2"})
    assert pairs(both) == pairs(read.where("c1 BETWEEN 'x1' AND 'x4' AND c2 >= 'y2'"))


def test_code_ranges_reach_the_scan_as_numbers(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", ["c1"])
    put(store, keys(0, 300))
    store.flush()
    plan = reader(store).value_range("c1", "v2", "v3")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(c1#,1)" in plan.replace(" ", "") or "GreaterThanOrEqual(`c1#`,1)" in plan or "`c1#`,2)" in plan
    assert "Exchange" not in plan  # one run without any other in its key range decides alone
    assert len(reader(store).value_range("c1", "w", "x").inputFiles()) == 0  # a run without a match is not opened


def test_dictionaries_of_runs_keep_the_order_of_values(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", ["c1"], small(50, maintain=False))
    put(store, [(f"{i:03d}", ["b", "a", "", None, "\u00e9", "Z"][i % 6]) for i in range(120)])
    store.flush()
    for f in store.files:
        rows = runs.read_run(spark, f["path"]).select("c1", F.col("`c1#`").alias("code")).distinct().collect()
        codes = sorted(((r["c1"] or ""), r["code"]) for r in rows)
        assert {c for v, c in codes if not v} == {-1} and [c for v, c in sorted(((v, c) for v, c in codes if v), key=lambda x: x[0].encode())] == list(range(len([v for v, _ in codes if v])))


def test_ending_a_writer_flushes_and_compacts_what_is_due(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", ["c1"], model.Options(memtable_rows=10, rows_per_run=30))
    for i in range(5):
        put(store, keys(i * 10, i * 10 + 12, f"t{i}"))
    assert sum(f["level"] == 0 for f in store.files) <= store.options.zero_level_files and not levels.due(store.files, store.options)
    assert any(f["level"] == 1 for f in store.files) and not any(f["level"] == -1 for f in store.files)
    assert store.snapshot().count() == 52


def test_vacuum_keeps_the_files_of_open_transactions(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", ["c1"], small(20, maintain=False))
    put(store, keys(0, 50))
    store.flush()
    old = reader(store)
    rows = old.scan()
    put(store, keys(0, 50, "n"))
    store.flush()
    store.compact(0)
    store.vacuum()
    assert rows.count() == 50 and {r["c1"][0] for r in rows.collect()} == {"v"} and old.value_range("c1", "v0", "v1").count() == 15
    old.close()
    store.vacuum()
    assert {r["c1"][0] for r in store.snapshot().collect()} == {"n"} and reader(store).value_range("c1", "n0", "n1").count() == 15


def test_samples_hold_the_time_and_bytes_of_actions(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", ["c1"])
    put(store, keys(0, 100))
    store.flush()
    read = reader(store)
    assert len(read.fetch("value_range", read.value_range("c1", "v0", "v1"))) == 30 and read.get("0001")
    totals = {r["op"]: r for r in store.profiler.bytes(spark).collect()}
    assert set(totals) == {"put", "flush", "value_range", "get"} and totals["flush"]["bytes_written"] > 0 and totals["put"]["bytes_written"] > 0 and totals["get"]["bytes_read"] > 0
    assert all(seconds > 0.001 for op, seconds, _, _ in store.profiler.samples)
