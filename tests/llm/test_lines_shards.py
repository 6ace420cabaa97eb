import collections
import random
import zlib

import pytest

from tests.llm.helpers import CLASH, SF, docs, empty, hard
from tests.oracle import same
from tidelog.llm import catalog, line_dedup, sharding, url_filter


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def plain_lines(rows, ratio=0.1):
    seen, pages = collections.Counter(), collections.Counter(s for _, _, s in rows)
    for _, t, s in rows:
        seen.update((s, x) for x in {x.strip(" ") for x in (t or "").split("\n")} if x)
    bad = {k for k, n in seen.items() if n > 1 and n / pages[k[0]] > ratio}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if not x.strip(" ") or (s, x.strip(" ")) not in bad), s) for i, t, s in rows]


def test_line_dedup_against_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["menu ", " footer", f"own {i}", f"r{rng.randrange(40)}", ""]) for _ in range(rng.randrange(8))), rng.choice(["a", "a", "b", None])) for i in range(300)]
    rows += [(9, "own line", "d"), (9, "shared\nodd", "e"), (10, "shared", "e")]  # hosts of one and two pages
    rows += [(7, None, "a"), (7, "menu", "c"), (8, "footer\nmenu", "a"), (8, "footer\nmenu", "a")]
    key = lambda r: tuple((x is None, x) for x in r)
    for sent in (line_dedup.SENT, 0):  # both ways of meeting the lines to drop
        got = [(r["doc_id"], r["text"], r["source"]) for r in line_dedup.line_dedup(docs(spark, rows), sent=sent).collect()]
        assert sorted(got, key=key) == sorted(plain_lines(rows), key=key)


def test_line_dedup_on_hard_rows(spark):
    df = hard(spark)
    out = line_dedup.line_dedup(df)
    assert out.count() == df.count() and set(out.columns) == set(df.columns)
    assert {r["doc_id"]: r["n_lines"] for r in out.collect()}[9] == 3
    assert line_dedup.line_dedup(empty(spark)).count() == 0
    assert line_dedup.line_dedup(df, counts=None).columns == df.columns


def test_line_dedup_runs_no_python(spark):
    assert "Python" not in line_dedup.line_dedup(hard(spark))._jdf.queryExecution().toString()


def test_shards(spark):
    rows = catalog.op6_shard(spark, SF).collect()
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(want)
    assert all(r["size"] == len(want[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(want[r["doc_id"]].encode()) for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shuffle_is_seeded_mixed_and_whole(spark):
    df = docs(spark, [(i, f"text {i}") for i in range(3000)]).repartition(3, "doc_id")
    order = lambda seed, size: [r["doc_id"] for r in sharding.external_shuffle(df, 4, seed, bucket_bytes=size).orderBy("shard", "slot").collect()]
    first = order(1, 20_000)
    assert first == order(1, 20_000) and first != order(2, 20_000) and sorted(first) == list(range(3000))
    mean = sum(first[:750]) / 750
    assert 1350 < mean < 1650  # a shard is a fair sample
    same_row = sharding.external_shuffle(docs(spark, [(1, "same")] * 500), 3, bucket_bytes=4000)
    assert sorted(r["count"] for r in same_row.groupBy("shard").count().collect()) == [166, 167, 167]


def test_shuffle_on_hard_rows(spark, tmp_path):
    df = hard(spark)
    out = sharding.external_shuffle(df, 5)
    assert out.count() == df.count() and set(out.columns) == set(df.columns) | {"shard", "slot"}
    assert set(CLASH) <= set(out.columns)
    sharding.write_shards(out, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == df.count()
    assert sharding.external_shuffle(empty(spark), 5).count() == 0


def day(text):
    return f"date'{text}'"


def judge(spark, captures, entries):
    c = spark.createDataFrame(captures, "id int, url string, at string").selectExpr("id", "url", "to_date(at) AS fetched_on", "'x' AS key", "'y' AS verdict", "0 AS row", "'a' AS `__row`", "'b' AS `__best`", "7 AS month")
    e = spark.createDataFrame(entries, "key string, at string, action string").selectExpr("key", "to_date(at) AS listed_on", "action")
    return {r["id"]: (r["verdict"], r["matched_key"], str(r["listed_since"]) if r["listed_since"] else None) for r in url_filter.url_filter(c, e).collect()}


def test_url_filter_judges_at_fetch_time(spark):
    entries = [("bad.com", "2024-01-10", "block"), ("bad.com", "2024-02-10", "remove"), ("ok.bad.com", "2024-01-15", "allow"), ("x.org/a/b", "2024-01-01", "block"), ("x.org", "2024-01-05", "allow"),
               ("tie.net", "2024-01-01", "remove"), ("tie.net", "2024-01-01", "block"), (None, "2024-01-01", "block"), ("n.com", None, "block"), ("bad.com", "2024-01-10", "block")]
    captures = [(1, "http://bad.com/x", "2024-01-09"), (2, "http://WWW.Bad.com:80/x", "2024-01-10"), (3, "http://bad.com/", "2024-02-09"), (4, "http://bad.com/", "2024-02-10"), (5, "https://u@ok.bad.com./p?q#r", "2024-01-20"),
                (6, "https://ok.bad.com/", "2024-01-12"), (7, "http://x.org/a/b/c?d", "2024-01-03"), (8, "http://x.org/a/bc", "2024-01-06"), (9, "http://notbad.com/", "2024-01-20"), (10, "http://tie.net", "2024-01-02"),
                (11, None, "2024-01-20"), (12, "", "2024-01-20"), (13, "http://bad.com/", None), (14, "bad.com/x", "2024-01-20"), (15, "http://n.com/", "2024-01-20")]
    keep = ("keep", None, None)
    assert judge(spark, captures, entries) == {
        1: keep, 2: ("block", "bad.com", "2024-01-10"), 3: ("block", "bad.com", "2024-01-10"), 4: keep, 5: ("allow", "ok.bad.com", "2024-01-15"), 6: ("block", "bad.com", "2024-01-10"),
        7: ("block", "x.org/a/b", "2024-01-01"), 8: ("allow", "x.org", "2024-01-05"), 9: keep, 10: ("block", "tie.net", "2024-01-01"), 11: keep, 12: keep, 13: keep, 14: keep, 15: keep,
    }
    assert judge(spark, captures[:2], [entries[7]]) == {1: keep, 2: keep}
