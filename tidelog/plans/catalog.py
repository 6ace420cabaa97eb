"""The query catalogue: each query on the star-schema tables, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import bloom, dictionary, scalars
from tidelog.metrics import summary
from tidelog.operators import merge, predicates, scan
from tidelog.plans import levels
from tidelog.sources import runs

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

LOG = "log AS (SELECT CAST(user_id AS VARCHAR) AS k, event_type AS c1, props AS c2, event_id AS epoch, event_type = 'error' AS deleted FROM events)"
ORDERS = "o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS c1, o_orderstatus AS c2 FROM orders)"
RUNS = "CASE WHEN epoch % 3 = 0 THEN 'a' WHEN epoch % 3 = 1 THEN 'b' ELSE 'm' END"
META = """files AS (
  SELECT level, run_id, min(k) AS key_min, max(k) AS key_max, count(DISTINCT k) AS key_num FROM (
    SELECT CAST(o_orderkey AS VARCHAR) AS k,
      CASE WHEN o_orderkey % 10 < 1 THEN 0 WHEN o_orderkey % 10 < 4 THEN 1 ELSE 2 END AS level,
      CASE WHEN o_orderkey % 10 < 1 THEN concat('r', CAST(o_orderkey % 3 AS VARCHAR))
        WHEN o_orderkey % 10 < 4 THEN substr(CAST(o_orderkey AS VARCHAR), 1, 1) ELSE substr(CAST(o_orderkey AS VARCHAR), 1, 2) END AS run_id
    FROM orders) x GROUP BY level, run_id)"""


def newest_sql(where: str = "TRUE", source: str = "log") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY epoch DESC) AS rn FROM {source} WHERE {where}) z WHERE rn = 1)"


def query(name: str, sql: str | None) -> Callable[[QueryFn], QueryFn]:
    def add(f: QueryFn) -> QueryFn:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return model.log_of(e, F.col("user_id"), {"c1": F.col("event_type"), "c2": F.col("props")}, F.col("event_id"), F.col("event_type") == "error")


def order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderpriority").alias("c1"), F.col("o_orderstatus").alias("c2"))


def run_of(epoch: Column) -> Column:
    return F.when(epoch % 3 == 0, "a").when(epoch % 3 == 1, "b").otherwise("m")


def at_epoch(log: DataFrame, epochs: DataFrame) -> DataFrame:
    """The state at the one epoch that `epochs` (read_epoch) holds."""
    return model.state(log.join(F.broadcast(epochs), F.col("epoch") <= F.col("read_epoch")).drop("read_epoch"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metadata of a synthetic tree of three levels over the orders."""
    key, digit = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 10
    level = F.when(digit < 1, 0).when(digit < 4, 1).otherwise(2)
    run = F.when(digit < 1, F.concat(F.lit("r"), (F.col("o_orderkey") % 3).cast("string"))).when(digit < 4, F.substring(key, 1, 1)).otherwise(F.substring(key, 1, 2))
    rows = read(spark, sf_dir, "orders").select(key.alias("k"), level.alias("level"), run.alias("run_id"))
    return levels.run_metadata(rows, "level", "run_id").withColumn("bytes", F.col("key_num") * 24)


# Points and snapshots


@query("point_get", f"WITH {ORDERS} SELECT * FROM o WHERE k = '1234'")
def point_get(spark, sf_dir):
    return scan.get(order_state(spark, sf_dir), "1234")


@query("point_get_versioned", f"WITH {LOG} SELECT k, c1, c2 FROM {newest_sql('epoch <= 700')} s WHERE NOT deleted AND k = '7'")
def point_get_versioned(spark, sf_dir):
    log = event_log(spark, sf_dir).where(F.col("k") == "7")  # a key filter may go below newest-per-key
    return model.state(log, 700)


@query("multi_get", f"WITH {LOG} SELECT k, c1, c2 FROM {newest_sql()} s WHERE NOT deleted AND k IN ('1','2','3','5','8','13','21','34','55','89','144','999999')")
def multi_get(spark, sf_dir):
    asked = ("1", "2", "3", "5", "8", "13", "21", "34", "55", "89", "144", "999999")
    keys = spark.range(1).select(F.explode(F.array(*map(F.lit, asked))).alias("k"))
    return model.state(scan.multi_get(event_log(spark, sf_dir), keys))


@query("latest_state", f"WITH {LOG} SELECT k, c1, c2 FROM {newest_sql()} s WHERE NOT deleted")
def latest_state(spark, sf_dir):
    return model.state(event_log(spark, sf_dir))


@query("snapshot_as_of", f"WITH {LOG} SELECT k, c1, c2 FROM {newest_sql('epoch <= (SELECT max(epoch) // 2 FROM log)')} s WHERE NOT deleted")
def snapshot_as_of(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return at_epoch(log, log.agg(F.floor(F.max("epoch") / 2).alias("read_epoch")))


@query("own_writes_invisible", f"WITH {LOG} SELECT k, c1, c2 FROM {newest_sql('epoch <= (SELECT max(epoch) - 10 FROM log)')} s WHERE NOT deleted")
def own_writes_invisible(spark, sf_dir):
    log = event_log(spark, sf_dir)
    active = log.select("epoch").orderBy(F.desc("epoch")).limit(10)  # the last ten mutations play open writers
    return at_epoch(log, model.read_epoch(active, F.lit(None).cast("long")))


@query("deleted_keys", f"WITH {LOG} SELECT k, epoch FROM {newest_sql()} s WHERE deleted")
def deleted_keys(spark, sf_dir):
    return model.newest(event_log(spark, sf_dir)).where("deleted").select("k", "epoch")


@query("upsert_state", f"WITH log AS (SELECT CAST(o_custkey AS VARCHAR) AS k, o_orderpriority AS c1, o_orderstatus AS c2, o_orderkey AS epoch FROM orders) SELECT k, c1, c2 FROM {newest_sql()} s")
def upsert_state(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return model.state(model.log_of(o, F.col("o_custkey"), {"c1": F.col("o_orderpriority"), "c2": F.col("o_orderstatus")}, F.col("o_orderkey")))


@query("first_wins_merge", f"""WITH {LOG}, n AS (SELECT k, c1 FROM {newest_sql("epoch % 3 = 2")} s), m AS (SELECT k, c1 FROM {newest_sql("epoch % 3 <> 2")} s)
SELECT k, c1 FROM n UNION ALL SELECT k, c1 FROM m WHERE k NOT IN (SELECT k FROM n)""")
def first_wins_merge(spark, sf_dir):
    log = event_log(spark, sf_dir)
    newer, older = (model.newest(log.where(c)).select("k", "c1") for c in (F.col("epoch") % 3 == 2, F.col("epoch") % 3 != 2))
    return merge.first_wins(newer, older)


# Ranges on values


@query("value_range", f"WITH {ORDERS} SELECT * FROM o WHERE c1 BETWEEN '2' AND '3-MEDIUM'")
def value_range(spark, sf_dir):
    return predicates.value_range(order_state(spark, sf_dir), "c1", "2", "3-MEDIUM")


@query("value_range_versioned", f"WITH {LOG} SELECT k, c1, c2 FROM {newest_sql()} s WHERE NOT deleted AND c1 BETWEEN 'c' AND 'p'")
def value_range_versioned(spark, sf_dir):
    return predicates.value_range(model.state(event_log(spark, sf_dir)), "c1", "c", "p")


@query("value_range_numeric_text", "SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS c1 FROM part WHERE CAST(p_size AS VARCHAR) BETWEEN '10' AND '25'")
def value_range_numeric_text(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return predicates.value_range(p.select(F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("c1")), "c1", "10", "25")


def encoded_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = order_state(spark, sf_dir)
    d = dictionary.build(o, "c1")
    return dictionary.encode(o, "c1", d), d


@query("code_range", f"WITH {ORDERS} SELECT k, c2, c1 FROM o WHERE c1 BETWEEN '2' AND '3-MEDIUM'")
def code_range(spark, sf_dir):
    coded, d = encoded_orders(spark, sf_dir)
    return predicates.late_values(predicates.code_range(coded.drop("c1"), "code", d, "2", "3-MEDIUM"), "code", d, "c1")


@query("code_range_below_all", f"WITH {ORDERS} SELECT k, c2, c1 FROM o WHERE c1 BETWEEN '!' AND '0'")
def code_range_below_all(spark, sf_dir):
    coded, d = encoded_orders(spark, sf_dir)
    return predicates.late_values(predicates.code_range(coded.drop("c1"), "code", d, "!", "0"), "code", d, "c1")


@query("one_sided_range", """SELECT 'below' AS side, CAST(p_partkey AS VARCHAR) AS k, p_type AS c1 FROM part WHERE p_type < 'M'
UNION ALL SELECT 'from', CAST(p_partkey AS VARCHAR), p_type FROM part WHERE p_type >= 'M'""")
def one_sided_range(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_type").alias("c1"))
    d = dictionary.build(p, "c1")
    coded = dictionary.encode(p, "c1", d)
    below, from_ = predicates.monotone(coded, "code", d, lambda v: v < "M"), predicates.monotone(coded, "code", d, lambda v: v >= "M")
    return below.select(F.lit("below").alias("side"), "k", "c1").union(from_.select(F.lit("from"), "k", "c1"))


@query("conjunctive_range", f"WITH {ORDERS} SELECT * FROM o WHERE c1 BETWEEN '2' AND '4' AND c2 BETWEEN 'G' AND 'P'")
def conjunctive_range(spark, sf_dir):
    return predicates.value_range(predicates.value_range(order_state(spark, sf_dir), "c1", "2", "4"), "c2", "G", "P")


@query("batch_selection", f"""WITH {ORDERS} SELECT CAST((rn - 1) // 2048 AS INTEGER) AS batch, count(*) AS n_rows, count(*) FILTER (WHERE c1 BETWEEN '2' AND '3-MEDIUM') AS n_selected
FROM (SELECT *, row_number() OVER (ORDER BY k) AS rn FROM o) x GROUP BY 1""")
def batch_selection(spark, sf_dir):
    return predicates.batches(order_state(spark, sf_dir), F.col("c1").between("2", "3-MEDIUM"))


# Scans


@query("full_scan", f"WITH {LOG} SELECT k, c1, c2 FROM {newest_sql()} s WHERE NOT deleted")
def full_scan(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return model.state(merge.union_runs(*[log.where(run_of(F.col("epoch")) == r) for r in "abm"]))


@query("key_range_scan", f"WITH {ORDERS} SELECT * FROM o WHERE k BETWEEN '10' AND '12'")
def key_range_scan(spark, sf_dir):
    return scan.key_range(order_state(spark, sf_dir), "10", "12")


@query("scan_k", f"WITH {ORDERS} SELECT * FROM o WHERE k >= '3' ORDER BY k LIMIT 100")
def scan_k(spark, sf_dir):
    return scan.scan_k(order_state(spark, sf_dir), 100, "3")


@query("scan_k_versioned", f"WITH {LOG} SELECT k, c1, c2 FROM {newest_sql('epoch <= 9000')} s WHERE NOT deleted AND k >= '2' ORDER BY k LIMIT 25")
def scan_k_versioned(spark, sf_dir):
    return scan.scan_k(model.state(event_log(spark, sf_dir), 9000), 25, "2")


@query("iterate_from", f"WITH {LOG} SELECT k, c1, c2, row_number() OVER (ORDER BY k) - 1 AS position FROM {newest_sql()} s WHERE NOT deleted AND k >= '3'")
def iterate_from(spark, sf_dir):
    return scan.iterate(model.state(event_log(spark, sf_dir)), "3")


@query("iterate_count", f"WITH {ORDERS} SELECT count(*) AS n, count(*) FILTER (WHERE c1 = '1-URGENT') AS n_urgent, min(k) AS first_key, max(k) AS last_key FROM o")
def iterate_count(spark, sf_dir):
    return order_state(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("c1") == "1-URGENT").alias("n_urgent"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))


@query("project_key_col", f"WITH {ORDERS} SELECT k, c2 FROM o")
def project_key_col(spark, sf_dir):
    return scan.project(order_state(spark, sf_dir), "c2")


# Dictionaries

DICT = "d AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c1 AS value FROM o WHERE c1 <> '') x)"


@query("dict_build", f"WITH {ORDERS}, {DICT} SELECT value, code FROM d")
def dict_build(spark, sf_dir):
    return dictionary.build(order_state(spark, sf_dir), "c1")


@query("dict_merge", "SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (SELECT c_name AS value FROM customer UNION SELECT s_name FROM supplier) x")
def dict_merge(spark, sf_dir):
    return dictionary.merge(dictionary.build(read(spark, sf_dir, "customer"), "c_name"), dictionary.build(read(spark, sf_dir, "supplier"), "s_name"))


@query("dict_encode", f"""WITH {ORDERS}, d AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c1 AS value FROM o WHERE c1 < '4') x)
SELECT k, c1, coalesce(code, -1) AS code FROM o LEFT JOIN d ON c1 = value""")
def dict_encode(spark, sf_dir):
    o = order_state(spark, sf_dir)
    return dictionary.encode(o.select("k", "c1"), "c1", dictionary.build(o.where("c1 < '4'"), "c1"))


@query("dict_decode", f"WITH {ORDERS} SELECT k, CASE WHEN c1 < '4' THEN c1 ELSE '' END AS value FROM o")
def dict_decode(spark, sf_dir):
    o = order_state(spark, sf_dir)
    d = dictionary.build(o.where("c1 < '4'"), "c1")
    return dictionary.decode(dictionary.encode(o.select("k", "c1"), "c1", d).drop("c1"), "code", d).drop("code")


@query("dict_remap", """WITH v AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'y' END AS run, p_brand AS value FROM part WHERE (p_partkey % 2 = 0 AND p_brand < 'Brand#4') OR (p_partkey % 2 = 1 AND p_brand > 'Brand#2')),
o AS (SELECT run, value, CAST(row_number() OVER (PARTITION BY run ORDER BY value) - 1 AS INTEGER) AS old_code FROM v),
n AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS new_code FROM (SELECT DISTINCT value FROM v) x)
SELECT run, old_code, new_code FROM o JOIN n USING (value)""")
def dict_remap(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    x = dictionary.build(p.where("p_partkey % 2 = 0 AND p_brand < 'Brand#4'"), "p_brand")
    y = dictionary.build(p.where("p_partkey % 2 = 1 AND p_brand > 'Brand#2'"), "p_brand")
    both = x.select(F.lit("x").alias("run"), "value", "code").union(y.select(F.lit("y"), "value", "code"))
    return dictionary.remap(both, dictionary.merge(x, y))


# Runs, levels and compaction


@query("flush_run_meta", f"WITH {LOG} SELECT {RUNS} AS run_id, min(k) AS key_min, max(k) AS key_max, count(DISTINCT k) AS key_num, count(*) AS n_versions FROM log GROUP BY 1")
def flush_run_meta(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return levels.run_metadata(log.withColumn("run_id", run_of(F.col("epoch"))), "run_id")


@query("flush_run", f"""WITH {LOG} SELECT run_id, k, c1, c2, epoch, deleted FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, k ORDER BY epoch DESC) AS rn FROM (SELECT *, {RUNS} AS run_id FROM log) r) z WHERE rn = 1""")
def flush_run(spark, sf_dir):
    """Every run by itself: its newest version of each key, tombstones too."""
    log = event_log(spark, sf_dir)
    flushed = [merge.compact(log.where(run_of(F.col("epoch")) == r), bottom=False).select(F.lit(r).alias("run_id"), "k", "c1", "c2", "epoch", "deleted") for r in "abm"]
    return merge.union_runs(*flushed)


@query("block_index", f"WITH {ORDERS} SELECT CAST((rn - 1) // 3276 AS INTEGER) AS block, min(k) AS key_min, count(*) AS n_rows FROM (SELECT k, row_number() OVER (ORDER BY k) AS rn FROM o) x GROUP BY 1")
def block_index(spark, sf_dir):
    return runs.block_index(order_state(spark, sf_dir), 3276)


@query("bloom_sizing", f"""WITH {LOG}, r AS (SELECT {RUNS} AS run_id, count(DISTINCT k) AS n FROM log GROUP BY 1),
b AS (SELECT run_id, n, CAST(floor(-ln(0.01) * n / (ln(2) * ln(2))) AS BIGINT) AS bits FROM r)
SELECT run_id, bits, (bits + 7) // 8 AS bytes, ((bits + 7) // 8 * 8) // n AS bits_per_key, CAST(least(32, greatest(1, floor(0.693 * (((bits + 7) // 8 * 8) // n)))) AS INTEGER) AS hashes FROM b""")
def bloom_sizing(spark, sf_dir):
    log = event_log(spark, sf_dir)
    n = levels.run_metadata(log.withColumn("run_id", run_of(F.col("epoch"))), "run_id")
    return n.select("run_id", *[c.alias(name) for name, c in levels.bloom_size(F.col("key_num")).items()])


@query("bloom_probe", f"WITH {LOG} SELECT {RUNS} AS run_id, count(DISTINCT k) AS n_there, 1000 AS n_absent, TRUE AS few_false FROM log GROUP BY 1")
def bloom_probe(spark, sf_dir):
    """Each run's filter is asked for all its keys, of which none may be missing, and for 1,000 keys that are nowhere, of which it
    may let a few through (a share of 0.01 is aimed at, five times as many are allowed)."""
    pairs = event_log(spark, sf_dir).select(run_of(F.col("epoch")).alias("run_id"), "k")
    absent = spark.range(1000).select(F.explode(F.array(*map(F.lit, "abm"))).alias("run_id"), F.concat(F.lit("absent"), F.col("id").cast("string")).alias("k"))
    passed = bloom.may_hold(bloom.build(pairs, "run_id"), "run_id", pairs.union(absent))
    there = ~F.col("k").startswith("absent")
    return passed.groupBy("run_id").agg(F.count_if(there).alias("n_there"), F.lit(1000).alias("n_absent"), (F.count_if(~there) <= 50).alias("few_false"))


@query("run_pruning", f"WITH {META} SELECT level, run_id, key_min, key_max FROM files WHERE key_min <= '35' AND key_max >= '2'")
def run_pruning(spark, sf_dir):
    return levels.prune(order_files(spark, sf_dir), "2", "35").select("level", "run_id", "key_min", "key_max")


@query("compact_merge", f"WITH {LOG} SELECT k, c1, c2, epoch FROM {newest_sql('epoch % 3 <> 2')} s WHERE NOT deleted")
def compact_merge(spark, sf_dir):
    log = event_log(spark, sf_dir)
    inputs = [log.where(run_of(F.col("epoch")) == r) for r in "ab"]
    return merge.compact(*inputs, bottom=True).select("k", "c1", "c2", "epoch")


@query("compact_keep_tombstones", f"WITH {LOG} SELECT k, epoch, deleted FROM {newest_sql('epoch % 3 <> 2')} s")
def compact_keep_tombstones(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return merge.compact(*[log.where(run_of(F.col("epoch")) == r) for r in "ab"], bottom=False).select("k", "epoch", "deleted")


@query("compaction_pick", f"""WITH {META}, src AS (
  SELECT f.* FROM files f WHERE level = 1 AND (SELECT count(*) FROM files WHERE level = 1) > 4
  ORDER BY (SELECT count(*) FROM files n WHERE n.level = 2 AND n.key_min <= f.key_max AND n.key_max >= f.key_min) > 0, key_min, run_id LIMIT 1)
SELECT 'source' AS role, level, run_id FROM src
UNION ALL SELECT 'target', f.level, f.run_id FROM files f, src WHERE f.level = 2 AND f.key_min <= src.key_max AND f.key_max >= src.key_min""")
def compaction_pick(spark, sf_dir):
    return levels.pick(order_files(spark, sf_dir), 1)


@query("compaction_pick_zero", f"""WITH {META}, src AS (SELECT min(key_min) AS lo, max(key_max) AS hi FROM files WHERE level = 0)
SELECT 'source' AS role, level, run_id FROM files WHERE level = 0
UNION ALL SELECT 'target', f.level, f.run_id FROM files f, src WHERE f.level = 1 AND f.key_min <= src.hi AND f.key_max >= src.lo""")
def compaction_pick_zero(spark, sf_dir):
    return levels.pick(order_files(spark, sf_dir), 0)


@query("level_overlap", f"""WITH {META} SELECT f.level, f.run_id, NOT EXISTS (SELECT 1 FROM files n WHERE n.level = f.level + 1 AND n.key_min <= f.key_max AND n.key_max >= f.key_min) AS no_overlap_in_next_level FROM files f""")
def level_overlap(spark, sf_dir):
    return levels.overlap(order_files(spark, sf_dir))


@query("level_sizes", f"WITH {META} SELECT level, count(*) AS files, CAST(sum(key_num) AS BIGINT) AS n_keys, CAST(sum(key_num * 24) AS BIGINT) AS bytes, level = 0 AND count(*) > 2 AS stalled FROM files GROUP BY level")
def level_sizes(spark, sf_dir):
    return levels.level_sizes(order_files(spark, sf_dir))


# Scalars and metrics


@query("key_fixed", "SELECT c_custkey, substr(c_name, 1, 16) AS stored, CAST(length(c_name) > 16 AS BOOLEAN) AS too_long FROM customer")
def key_fixed(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", scalars.unfixed(scalars.fixed(F.col("c_name"))).alias("stored"), (F.octet_length("c_name") > model.KEY_SIZE).alias("too_long"))


@query("scalar_functions", "SELECT p_partkey, CAST(pow(3, p_size % 20) AS BIGINT) AS power, CAST(floor(log2(p_size)) AS INTEGER) AS high_bit FROM part")
def scalar_functions(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", scalars.power(F.lit(3), F.col("p_size") % 20).alias("power"), scalars.highest_bit(F.col("p_size")).alias("high_bit"))


@query("profiler_summary", """WITH s AS (SELECT l_returnflag AS op, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT op, n, round(sum(v), 2) AS total, max(CASE WHEN rn = CAST(floor(0.99 * n) AS BIGINT) + 1 THEN v END) AS p99 FROM s GROUP BY op, n""")
def profiler_summary(spark, sf_dir):
    return summary(read(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_extendedprice"))
