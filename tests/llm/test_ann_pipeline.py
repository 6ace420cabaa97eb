import numpy as np
import pytest

import corpus_pipeline
from tests.llm.helpers import SF, empty, hard
from tests.llm.test_text_operators import plain_classes
from tidelog.llm import ann, catalog, decontaminate, line_dedup


def brute(ids, points, every=100, k=10):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((points - points[i]) ** 2).sum(1))
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], d[others]))][:k]
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in best]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_on_embeddings(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, points = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want, got = brute(ids, points), found(catalog.op9_nearest(spark, sf).collect())
    assert set(got) == set(want)
    recall = np.mean([len({v for v, _ in want[q]} & {v for v, _ in got[q]}) / len(want[q]) for q in want])
    assert recall >= 0.9
    place = {v: i for i, v in enumerate(ids)}
    for q, near in got.items():
        exact = [np.sqrt(((points[place[v]] - points[place[q]]) ** 2).sum()) for v, _ in near]
        assert np.allclose(exact, [s for _, s in near], rtol=1e-12) and near == sorted(near, key=lambda x: (x[1], x[0]))


def test_all_cells_visited_is_exact_and_ties_go_to_small_ids(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 6)]) for i in range(1, 700)] + [(i, [1.0] * 6) for i in range(700, 1100)]
    rows = [r for r in rows if any(r[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = found(ann.search(df, visit=1.0, centroids=4, chunk=100).collect())
    want = brute(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    assert {q: [v for v, _ in n] for q, n in got.items()} == {q: [v for v, _ in n] for q, n in want.items()}
    assert [v for v, _ in got[1000]][:3] == [700, 701, 702] or got[1000][0][0] < 700


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, None), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (600, []), (None, [1.0, 1.0]), (7, [1.0, 2.5]), (8, [1.0, 1.0, 1.0]), (9, [5.0, 5.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, cell string, id string")
    assert found(ann.search(df).collect()) == {0: [(7, 0.5), (9, 5.0)]}
    assert ann.search(df.limit(0)).collect() == [] and ann.search(df.where("vec_id = 100")).collect() == []


def test_repeated_rows(spark):
    """An id that repeats is one query, by its smallest vector; as candidates its rows count each."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(1, 60)]
    rows += [(100, [1.0, 0.0, 0.0, 2.0]), (100, [1.0, 0.0, 0.0, 2.0]), (200, [3.0, 0.0, 0.0, 0.0]), (200, [0.0, 5.0, 0.0, 0.0]), (7, rows[6][1]), (8, rows[7][1])]
    got = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), visit=1.0).collect())
    ids, points = np.array([r[0] for r in rows]), np.array([np.float32(r[1]) for r in rows], float)
    for q, v in ((100, [1.0, 0.0, 0.0, 2.0]), (200, [0.0, 5.0, 0.0, 0.0])):
        d, others = np.sqrt(((points - v) ** 2).sum(1)), np.flatnonzero(ids != q)
        want = others[np.lexsort((ids[others], d[others]))][:10]
        assert [x for x, _ in got[q]] == ids[want].tolist() and np.allclose([s for _, s in got[q]], d[want])
    assert set(got) == {100, 200}


def test_the_share_to_visit_follows_how_well_vectors_cluster():
    rng = np.random.default_rng(3)
    tight = rng.normal(size=(20, 8))[rng.integers(0, 20, 2000)] * 10 + rng.normal(size=(2000, 8)) * 0.1
    shares = [ann.share_to_visit(p, (ann.kmeans(p[:, :4], 20), ann.kmeans(p[:, 4:], 20)), 10, 0.95) for p in (tight, rng.normal(size=(2000, 8)))]
    assert shares[0] < 0.1 < shares[1] <= 1


def test_traversal_visits_pairs_by_summed_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(7), rng.random(5)
    counts = {i: (1, 1) for i in range(35)}
    cells = ann.traverse(a, b, counts, 35)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums) and len(ann.traverse(a, b, counts, 4)) == 4


# Pipeline


def test_stages_in_order_with_their_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if i < 4:
            assert kept[-1].columns == docs.columns
    rows = [[tuple(r) for r in k.select("doc_id", "text", "source", "lang").collect()] if "text" in k.columns else k.collect() for k in kept]
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r[0] for r in rows[1]}
    assert all(k in left for k, q in truth.items() if q == 1) and sum(k in left for k, q in truth.items() if q == 0) <= 3
    # Lines: as the operator does on what the classifier kept; every document stays.
    again = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(kept[1]).collect()}
    assert {r[0]: r[1] for r in rows[2]} == again and {r[0] for r in rows[2]} == left
    # Copies: one of each class by a plain version, unless a similarity is close to the limit.
    pairs = sorted((r[0], r[1]) for r in rows[2])
    classes, sims = plain_classes(pairs)
    unsure = {i for p, s in sims.items() if 0.79 < s < 0.81 for i in p}
    spoiled = {classes[i] for i in unsure}
    sure = {pairs[c][0] for c in set(classes) - spoiled}
    assert sure <= {r[0] for r in rows[3]} <= sure | {pairs[i][0] for i, c in enumerate(classes) if c in spoiled} and len(spoiled) <= 0.05 * len(sure)
    # Leaks: none is left, and only leaks went.
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(kept[3], bench).collect()}
    assert {r[0] for r in rows[4]} == {r[0] for r in rows[3]} - leaks
    # Packing: the pieces of what is left.
    assert {r["doc_id"] for r in rows[5]} == {r[0] for r in rows[4]}
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in run) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows[5])


def test_stages_on_hard_and_empty_tables(spark, tmp_path):
    for n, df in enumerate((hard(spark), empty(spark))):
        rows = df.count()
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, df, SF).write.parquet(f"{tmp_path}/{n}-{i}")
            df = spark.read.parquet(f"{tmp_path}/{n}-{i}")
            now = df.count()
            assert now <= (rows if i < 4 else 10_000) and (rows or not now), name
            if name == "line_dedup":
                assert now == rows  # lines go, documents stay
            rows = now if i < 4 else rows

