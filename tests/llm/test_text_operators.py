import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.helpers import SF, docs, empty, hard, texts, words
from tidelog.llm import catalog, decontaminate, license_scan, near_dedup, packing, quality, substring_dedup

BLANKS = r"[\x20\x09-\x0D]+"


def split(text):
    return [w for w in re.split(BLANKS, text or "") if w]


# Licence scan


def plain_scan(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(found) - len(p) + 1) if found[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licence_phrases_against_a_plain_version(spark):
    for r in catalog.op3_license_scan(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_scan(r["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_licence_phrases_at_random(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([" ", "-", "\n"]).join(rng.choice("under the mit license apache version 2 cc by nc The MIT x".split()) for _ in range(rng.randrange(60)))) for i in range(400)]
    got = {r["doc_id"]: tuple(r)[1:6] for r in license_scan.license_scan(docs(spark, rows)).collect()}
    assert got == {i: plain_scan(t) for i, t in rows}


def test_licence_templates_with_gaps(spark):
    body = license_scan.TEMPLATES["mit"][0].split()
    rows = [(1, " ".join(body[:40] + ["odd", "words"] + body[43:])), (2, " ".join(body[:12])), (3, " ".join(words(200, 3)))]
    got = {r["doc_id"]: (r["labels"], r["n_base"], round(r["score"], 1)) for r in license_scan.license_scan(docs(spark, rows)).collect()}
    assert got[1][:2] == ("mit", 0) and got[1][2] >= 0.9 and got[2][0] == "" and got[3] == ("", 0, 0.0)
    out = license_scan.license_scan(hard(spark))
    assert out.count() == 12 and license_scan.license_scan(empty(spark)).count() == 0


def test_licence_templates_that_repeat_a_run():
    """A run that stands often in a template has as many places; a chain through an early one is still found."""
    run, ends = words(6, 1), [words(1, 10 + i) for i in range(12)]
    template = " ".join(w for e in ends for w in run + e)
    scanner = license_scan.Scanner({}, {"own": [template]}, 6, 0.1, 12)
    text = [w.encode() for w in run + ["odd"] + run + ["odd"] + run]
    assert scanner.scan(text)[5] == pytest.approx(18 / 84)
    text = [w.encode() for w in run + ends[0] + ["odd"] + run + ends[1] + ["odd"] + run + ends[2]]
    assert scanner.scan(text)[5] == pytest.approx(21 / 84)


def plain_cover(text, templates, least, cover, gap):
    """Labels and best share by all maximal matches of all pairs of places, chained by dynamic programming over all of them."""
    labels, best = set(), 0.0
    for label, bodies in templates.items():
        for body in (b.split() for b in bodies):
            hits = []
            for i in range(len(text)):
                for j in range(len(body)):
                    if text[i] == body[j] and not (i and j and text[i - 1] == body[j - 1]):
                        k = 0
                        while i + k < len(text) and j + k < len(body) and text[i + k] == body[j + k]:
                            k += 1
                        if k >= least:
                            hits.append((i, j, k))
            done = []
            for i, j, k in sorted(hits):
                before = [c for a, b, c in done if a <= i and b <= j and i - a <= gap]
                done.append((i + k, j + k, k + max(before, default=0)))
            share = max((c for _, _, c in done), default=0) / len(body)
            best = max(best, min(1.0, share))
            labels |= {label} if share >= cover else set()
    return labels, best


@pytest.mark.parametrize("seed", range(6))
def test_licence_labels_and_scores_against_all_matches(seed):
    rng = random.Random(seed)
    pool = [words(rng.randrange(3, 9), 40 + i) for i in range(7)]  # pieces that templates share
    templates = {f"l{i}": [" ".join(w for _ in range(rng.randrange(2, 6)) for w in rng.choice(pool)) for _ in range(2)] for i in range(5)}
    scanner = license_scan.Scanner({}, templates, 6, 0.5, 12)
    for _ in range(150):
        text = [w for _ in range(rng.randrange(1, 9)) for w in rng.choice([*pool, ["odd"] * rng.randrange(1, 14)])]
        _, _, _, _, labels, score = scanner.scan([w.encode() for w in text])
        assert (labels, pytest.approx(score)) == plain_cover(text, templates, 6, 0.5, 12)


def test_a_template_that_joins_late_in_a_match_is_seen():
    a, b, c = words(6, 1), words(8, 2), words(8, 3)
    scanner = license_scan.Scanner({}, {"A": [" ".join(a + b)], "B": [" ".join(b + c)]}, 6, 0.5, 12)
    for text in (a + b, ["odd", *b]):
        assert scanner.scan([w.encode() for w in text])[4] == {"A", "B"}


# Packing


def encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check_packed(rows, want, limit):
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    encode = encoder()
    for key, copies in want.items():
        pieces = []
        for text in copies:
            ids = encode(text)
            pieces += [(k, k * limit, len(ids[k * limit : (k + 1) * limit]), zlib.crc32(ids[k * limit : (k + 1) * limit].tobytes())) for k in range(-(-len(ids) // limit))]
        assert sorted(got[key]) == sorted(pieces)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(by), sum(r["length"] for r in rows)


def test_packing_is_whole_and_tight(spark):
    rows = catalog.op2_pack(spark, SF).collect()
    n, total = check_packed(rows, {k: [t] for k, t in texts(spark).items()}, 4096)
    assert n <= 1.02 * total / 4096 + 1


def test_packing_hard_rows_in_small_groups(spark):
    df = hard(spark)
    want = collections.defaultdict(list)
    for r in df.collect():
        want[r["doc_id"]].append(r["text"])
    check_packed(packing.pack(df, limit=512, most_bins=3).collect(), want, 512)
    assert packing.pack(empty(spark)).count() == 0


def test_words_of_every_kind_are_tokenised_alike():
    import public_tokenizers

    chunks, encode = packing.token_bytes(public_tokenizers.path("word_bpe_49k.json")), encoder()
    for text in ["Ünï ÀÉ ßtraße. İstanbul ΣΑΣ, naïve,, x.. don't I'M <|endoftext|> a<|startoftext|>b 123 4.5 foo_bar ªº µm, ½\tx\x0b\x1cz", "", "日本語 한국어 🙂👍🏽 áb É", "é. A.B,"]:
        assert packing.document_ids(text, chunks) == encode(text).tobytes()


def test_best_fit():
    assert sorted(sorted([5, 3, 7, 2, 1][i] for i in b) for b in packing.best_fit([5, 3, 7, 2, 1], 9)) == [[1, 3, 5], [2, 7]]
    assert packing.best_fit([], 9) == []


# Substring dedup


def plain_removal(rows, width):
    all_words = [split(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + width]) for w in all_words for i in range(len(w) - width + 1))
    out = []
    for (key, _), w in zip(rows, all_words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((key, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize(("width", "least"), [(35, 9), (12, 4), (5, 9), (1, 9)])
def test_substrings_against_a_plain_version(spark, width, least):
    rng = random.Random(width)
    shared = [words(n, 100 + n) for n in (width - 1, width, width + 1, 3 * width)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += words(rng.randrange(1, 40), rng.random()) + (rng.choice(shared) if rng.random() < 0.5 else [])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(500, "z " * (2 * width)), (501, " ".join(["p q"] * 40)), (502, None), (503, ""), rows[3], rows[3]]
    out = substring_dedup.substring_dedup(docs(spark, rows), width, block_bytes=3000, least=least)
    assert order(tuple(r) for r in out.collect()) == order(plain_removal(rows, width))


def test_substrings_of_documents(spark):
    rows = list(texts(spark).items())
    want = {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in plain_removal(rows, 35)}
    assert {r["doc_id"]: tuple(r)[1:] for r in catalog.op7_substring_dedup(spark, SF).collect()} == want


def test_substrings_of_hard_rows(spark):
    out = {}
    for r in substring_dedup.substring_dedup(hard(spark)).collect():
        out.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert out[4] == [(40000, 40000)] and out[8] == [(40000, 40000)] * 2 and out[7] == [(300, 300)] and out[1] == [(0, 0)]
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


# Near-duplicates


def plain_classes(rows):
    """Links by exact weighted Jaccard over all pairs that share a shingle, then their components."""
    import math

    def shingled(text):
        w = split((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])

    bags = [shingled(t) for _, t in rows]
    holders = collections.defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            holders[s].append(i)
    n = len(rows)
    idf = {s: 1 + near_dedup.SPREAD * math.log((1 + n) / (1 + len(h))) / math.log(2 + n) for s, h in holders.items()}
    weights = [{s: (1 + math.log(c)) * idf[s] for s, c in b.items()} for b in bags]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    for h in holders.values():
        links |= {(a, b) for a in h for b in h if a < b}
    sims = {}
    for a, b in links:
        x, y = weights[a], weights[b]
        low = sum(min(x.get(s, 0), y.get(s, 0)) for s in x)
        sims[a, b] = low / (sum(x.values()) + sum(y.values()) - low)
        if sims[a, b] >= 0.8:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    by_text = {}
    for i, (_, t) in enumerate(rows):
        j = by_text.setdefault(t or "", i)
        parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)], sims


def test_near_classes_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for g in range(25):
        base = words(rng.randrange(60, 300), g)
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "word", "here"])
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, rows[0][1]), (901, rows[5][1]), (902, None), (903, ""), (904, "one two"), (905, "One two")]
    want, sims = plain_classes(rows)
    sure = [i for i in range(len(rows)) if not any(0.78 < s < 0.82 for p, s in sims.items() if i in p)]
    got = {r["doc_id"]: r for r in near_dedup.near_classes(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and len(sure) > len(rows) // 2
    for i in sure:
        for j in sure:
            assert (got[rows[i][0]]["class_id"] == got[rows[j][0]]["class_id"]) == (want[i] == want[j])
    assert all(r["class_id"] <= k for k, r in got.items())
    assert collections.Counter(r["class_id"] for r in got.values() if r["kept"]) == dict.fromkeys({r["class_id"] for r in got.values()}, 1)


def test_a_chain_in_one_bucket_is_one_class(spark):
    """Nodes that meet no common leader are still compared."""
    base = words(100, 4)
    rows = [(i, " ".join(base[: 100 - 2 * i] + words(2 * i, 50 + i))) for i in range(8)]
    got = near_dedup.near_classes(docs(spark, rows)).collect()
    want, _ = plain_classes(rows)
    assert len({r["class_id"] for r in got}) == len(set(want))


def test_near_copies_of_a_text_that_a_third_of_all_rows_hold(spark):
    """How common a text is does not decide whether its near copies are found."""
    base = words(200, 70)
    rows = [(i, " ".join(base)) for i in range(40)] + [(40 + i, " ".join(base[:184] + words(16, 71 + i))) for i in range(8)]
    rows += [(100 + i, " ".join(words(40, 200 + i))) for i in range(72)]
    want, sims = plain_classes(rows)
    assert len({want[i] for i in range(48)}) == 1 and all(0.8 <= sims[0, i] < 0.84 for i in range(40, 48))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs(spark, rows)).collect()}
    assert {got[i] for i in range(48)} == {0} and len(set(got.values())) == 73


def check_classes(spark, rows, found):
    """Classes as by all pairs, but for texts in a pair whose similarity the hashed frequencies may move across the limit."""
    want, sims = plain_classes(rows)
    unsure = {i for p, s in sims.items() if 0.79 < s < 0.81 for i in p}
    spoiled = {want[i] for i in unsure}
    assert len(found) == len(rows)
    classes, plain = collections.defaultdict(set), collections.defaultdict(set)
    for i, (key, _) in enumerate(rows):
        classes[found[key]].add(i)
        plain[want[i]].add(i)
    for name, members in plain.items():
        if name not in spoiled:
            assert classes[found[rows[min(members)][0]]] - unsure == members
    return len(plain), len(spoiled)


def test_query_of_documents_against_all_pairs(spark):
    rows = sorted(texts(spark).items())
    found = {r["doc_id"]: r["class_id"] for r in catalog.op1_near_dedup(spark, SF).collect()}
    classes, spoiled = check_classes(spark, rows, found)
    assert classes < len(rows) and spoiled <= 0.05 * classes


def test_a_group_of_near_copies_many_of_which_are_not_alike_against_all_pairs(spark):
    """Variants from 0.4 to 1 alike, two families of them, beside texts that share a passage: nothing is lost, and few pairs are compared."""
    rng = random.Random(11)
    base = words(150, 900)
    other = base[:110] + words(40, 901)
    rows = []
    for i in range(260):
        copy = list(base if i % 3 else other)
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], [rng.choice(["new", "word", "here", "odd"])], [copy[at], "more"], [f"own{i}"]])
        rows.append((len(rows), " ".join(copy)))
    passage = words(60, 902)
    rows += [(len(rows) + i, " ".join(passage + words(rng.randrange(5, 60), 2000 + i))) for i in range(60)]
    compared = []
    pairs = near_dedup.Linker._pairs
    near_dedup.Linker._pairs = lambda self, held: compared.append((out := self.scratch.settle(pairs(self, held))).count()) or out
    try:
        found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs(spark, rows)).collect()}
    finally:
        near_dedup.Linker._pairs = pairs
    want, sims = plain_classes(rows)
    index = {i: r[0] for i, r in enumerate(rows)}
    # Every pair clearly above the limit is in one class, and no class holds what no chain of pairs near the limit joins.
    for (i, j), s in sims.items():
        if s >= 0.805:
            assert found[index[i]] == found[index[j]]
    parent = {i: i for i in index}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), s in sims.items():
        if s >= 0.795:
            parent[root(i)] = root(j)
    for i in index:
        for j in index:
            if found[index[i]] == found[index[j]]:
                assert root(i) == root(j)
    unlike = sum(1 for s in sims.values() if 0.3 < s < 0.8)
    assert sum(compared) < 0.02 * unlike


def test_long_lists_become_groups_with_pivots_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHORT", 2)
    rng = random.Random(3)
    base = words(100, 1)
    rows = []
    for i in range(36):
        copy = list(base)
        for at in rng.sample(range(0, 100, 8), rng.randrange(1, 5)):
            copy[at] = "edit"
        rows.append((i, " ".join(copy)))
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs(spark, rows)).collect()}
    _, sims = plain_classes(rows)
    assert all(found[i] == found[j] for (i, j), s in sims.items() if s >= 0.805)


def test_near_dedup_of_hard_rows(spark):
    df = hard(spark)
    found = near_dedup.near_classes(df).collect()
    assert len(found) == 12 and sum(r["kept"] for r in found) == len({r["class_id"] for r in found}) == 7
    left = near_dedup.near_dedup(df)
    assert left.columns == df.columns and left.count() == 7
    assert {r["doc_id"]: r["text"] for r in left.collect()}[4] == {r["doc_id"]: r["text"] for r in df.collect()}[4]
    assert near_dedup.near_classes(empty(spark)).count() == 0 and near_dedup.near_dedup(empty(spark)).count() == 0


def test_consistent_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    hashes = np.sort(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    x, y = rng.choice([1.0, 1.5, 3.0], 900), rng.choice([1.0, 1.5, 3.0], 900)
    x[600:], y[:300] = 0, 0
    exact = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    hits = []
    for seed in range(12):
        s = near_dedup.Sampler(seed)
        (_, a), (_, b) = (s.sample(np.zeros(int((w > 0).sum()), int), hashes[w > 0], w[w > 0]) for w in (x, y))
        hits.append((a == b).mean())
    assert abs(np.mean(hits) - exact) < 0.06


# Decontamination


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_myers_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(150):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        got = decontaminate.search(decontaminate.masks(a), len(a), b)
        assert got == [min(distance(a, b[i : e + 1]) for i in range(e + 2)) for e in range(len(b))]


def test_leaks_with_edits_are_found(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng.randrange(10, 60), 1000 + i))) for i in range(30)]
    rows, want = [], set()
    for i in range(240):
        w, item = words(rng.randrange(0, 200), i), items[i % 30][1].split()
        k = rng.choice([0, 1, len(item) // 5])
        leak = list(item)
        for _ in range(k):
            at = rng.randrange(len(leak))
            leak[at : at + 1] = rng.choice([[], ["odd"], [leak[at], "odd"]])
        if i % 2:
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", ",", "."]) for x in leak]
            want.add((i, items[i % 30][0]))
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " ".join(words(30_000, 5)))]
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (79, "too short")], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, rows), bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert not found - want and len(want - found) <= 0.01 * len(want)
    norm = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    for r in got:
        item = norm(dict(items)[r["item_id"]])
        assert distance(item, norm(dict(rows)[r["doc_id"]])[r["first_word"] : r["end_word"]]) == r["distance"] <= len(item) // 5
    sliced = decontaminate.find_leaks(docs(spark, rows), bench, slice_bytes=1500).collect()
    assert {(r["doc_id"], r["item_id"]) for r in sliced} == found
    clean = decontaminate.drop_leaks(docs(spark, rows), bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in found}


@pytest.mark.parametrize("kind", ["deletions", "insertions", "substitutions"])
def test_leaks_of_long_items_at_the_largest_distance_are_all_found(spark, kind):
    rng = random.Random(kind)
    items = [(size, " ".join(words(size, size))) for size in (59, 100, 200)]
    rows = []
    for i in range(90):
        leak = items[i % 3][1].split()
        for at in sorted(rng.sample(range(len(leak)), len(leak) // 5), reverse=True):
            leak[at : at + 1] = {"deletions": [], "insertions": ["odd1", leak[at]], "substitutions": ["odd1"]}[kind]
        rows.append((i, " ".join(words(20, 5000 + i) + leak + words(20, 6000 + i))))
    got = decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, items[i % 3][0]) for i in range(90)}


def test_query_finds_the_places_of_a_search_of_all_items_in_all_texts(spark):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = {r["item_id"]: norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {}
    for doc, text in texts(spark).items():
        body = norm(text)
        for item, query in items.items():
            if len(set(query) & set(body)) >= len(set(query)) - len(query) // 5 and body:
                best = min(decontaminate.search(decontaminate.masks(query), len(query), body))
                if best <= len(query) // 5:
                    want[doc, item] = best
    got = {}
    for r in catalog.op4_decontaminate(spark, SF).collect():
        got[r["doc_id"], r["item_id"]] = min(r["distance"], got.get((r["doc_id"], r["item_id"]), 1000))
    assert got == want


def test_exact_copies_of_short_items_are_found(spark):
    bench = spark.createDataFrame([(1, "Why is it so?"), (2, "two words"), (3, "why is it so"), (4, " ".join(words(20, 3)))], "item_id long, text string")
    rows = [(1, "he asked: why is it SO, then why is it so"), (2, "why is it"), (3, "so why is that so"), (4, "two"), (5, "words two"), (6, "two, words"), (7, None)]
    got = decontaminate.find_leaks(docs(spark, rows), bench).collect()
    assert sorted(tuple(r) for r in got) == [(1, i, a, a + 4, 0) for i in (1, 3) for a in (2, 7)] + [(6, 2, 0, 2, 0)]
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs(spark, rows), bench).collect()} == {2, 3, 4, 5, 7}


def test_leaks_on_hard_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    df = hard(spark)
    assert decontaminate.find_leaks(df, bench).count() == 0 and decontaminate.drop_leaks(df, bench).count() == 12
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.drop_leaks(df, bench.limit(0)).columns == df.columns
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0


# Quality


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    some = ["a b c", "", "Ünï x  y\n\nz", "word", " lead and trail ", "日本 語"]
    block = quality.features(some)
    for i, text in enumerate(some):
        for (at, first), (alone, _) in zip(block, quality.features([text]), strict=True):
            assert np.array_equal(at[first[i] : first[i + 1]], alone)
    assert [len(f) for f, _ in quality.features(["ab c"])] == [2, 1, 3, 1, 0]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = catalog.op8_quality(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 1000 and sum(a == b for a, b in held) >= 0.93 * len(held)
    assert sum(a == 1 and b == 0 for a, b in held) <= 0.02 * len(held)


def test_quality_scores_against_a_plain_version(spark):
    """A text's odds are the mean of its features' weights and the constant, counted feature by feature."""
    rng = np.random.default_rng(5)
    model = rng.normal(size=quality.BUCKETS).astype(np.float32), 0.25
    df = hard(spark)
    for r in quality.score(df, model).collect():
        found = [b for kind, _ in quality.features([r["text"] or ""]) for b in kind.tolist()]
        odds = (sum(float(model[0][b]) for b in found) / len(found) if found else 0.0) + 0.25
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-odds))) and r["predicted"] == (r["score"] >= 0.3)


def test_quality_learns_from_one_text_of_a_repeated_id(spark):
    rows = [(i, f"{'good fine' if i % 2 else 'bad poor'} text {i}") for i in range(60)]
    rows += [(1, "bad poor other"), (2, "good fine other")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    first, second = (quality.fit(docs(spark, rows).repartition(n), labels) for n in (1, 5))
    assert np.array_equal(first[0], second[0]) and first[1] == second[1]


def test_quality_on_hard_rows_and_without_labels(spark):
    df = hard(spark)
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (7, 0, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, fold=None)
    out = quality.score(df, model)
    assert out.count() == 12 and all(0 <= r["score"] <= 1 for r in out.collect())
    nothing = quality.fit(df, labels.limit(0))
    assert quality.score(empty(spark), nothing).count() == 0 and len({r["score"] for r in quality.score(df, nothing).collect()}) == 1
