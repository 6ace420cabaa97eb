"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import Scratch, free_names, keep, mix64, small_batches
from tidelog.llm.textblock import BLANKS, LOWER, Block, spans

WORDS = 5
#: Document frequencies are kept by hashed shingle, as in hashed TF-IDF features: a table of fixed size for any corpus.
FEATURES = 1 << 18
#: Inverse document frequencies run from 1 to 1 + SPREAD. Members of a large group of copies share shingles of high document
#: frequency and differ in unique ones, so a steep weight would part copies that are alike.
SPREAD = 0.25
BANDS, ROWS = 21, 3
SAMPLES = BANDS * ROWS
#: Random draws are shared by shingles of one class, so that they can be tabled.
CLASSES = 1 << 14
PART = 1 << 12


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text, hash, times), by text and hash. A text of one to four words is one shingle."""
    block = Block(texts, BLANKS, LOWER)
    inside = block.inside(WORDS)
    at = np.flatnonzero(inside)
    sizes = np.diff(block.first)
    of_word = np.repeat(np.arange(len(block)), sizes)
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    text = np.concatenate([of_word[at], short])
    hashes = np.concatenate([block.windows(WORDS)[at], spans(block.word, block.first[short], block.first[short + 1])])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    start = np.flatnonzero(new)
    return text[start], hashes[start], np.diff(np.append(start, len(text)))


def weights(hashes: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with sublinear term frequency."""
    return (1 + np.log(times)).astype(np.float32) * idf[(hashes % np.uint64(FEATURES)).astype(np.int64)]


def verifying(rare: np.ndarray) -> np.ndarray:
    """Inverse document frequencies for the similarity and for signatures alike, in steps of 1/32."""
    return (np.round(32 * (1 + SPREAD * rare)) / 32).astype(np.float32)


def _chunks(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t) > most:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this task for each feature, in parts; part -1 holds the number of documents."""
    keep("near_dedup")
    counts, n = np.zeros(FEATURES, np.int32), 0
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column(0)]
        n += len(texts)
        for lo, hi in _chunks(texts):
            text, hashes, _ = shingles(texts[lo:hi])
            pairs = np.unique(text.astype(np.int64) * FEATURES + (hashes % np.uint64(FEATURES)).astype(np.int64))
            counts += np.bincount(pairs % FEATURES, minlength=FEATURES).astype(np.int32)
    if n:
        rows = [(-1, np.array([n], np.int64).tobytes())] + [(i // PART, counts[i : i + PART].astype(np.int64).tobytes()) for i in range(0, FEATURES, PART)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "counts"])


def _summed(key, rows):
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("counts"))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def inverse_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """ln((1 + n) / (1 + documents with the feature)) / ln(2 + n), from 0 to 1: FEATURES numbers for any corpus."""
    found = docs.select(F.col(text)).mapInArrow(_frequencies, "part int, counts binary").groupBy("part").applyInArrow(_summed, "part int, counts binary")
    parts = {r["part"]: np.frombuffer(bytes(r["counts"]), np.int64) for r in found.toLocalIterator()}
    n = int(parts[-1][0]) if parts else 0
    counts = np.concatenate([parts[i] for i in range(FEATURES // PART)]) if n else np.zeros(FEATURES)
    return (np.log((1 + n) / (1 + counts)) / np.log(2 + n)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling: for each of SAMPLES draws, the shingle with the smallest ln a = ln c - r (t - b) - r,
    where t = floor(ln weight / r + b); r and c are gamma(2, 1), b is uniform."""

    def __init__(self, seed: int = 5, tables: int = 8):
        rng = np.random.default_rng(seed)
        shape = (CLASSES, SAMPLES)
        self.r = rng.gamma(2, 1, shape).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.b = rng.random(shape, np.float32)
        self.made: dict[float, np.ndarray] = {}
        self.tables = tables

    def keys(self, weight: np.ndarray | float, at) -> np.ndarray:
        """ln a as an unsigned integer of the same order, in the upper half of 64 bits."""
        r, b = self.r[at], self.b[at]
        t = np.floor(np.log(weight) / r + b)
        bits = (self.ln_c[at] - r * (t - b) - r).astype(np.float32).view(np.uint32)
        return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)

    def sample(self, text: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with shingles, and for each a row of SAMPLES sampled shingles (32 bits of their hashes)."""
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        out = np.full((len(starts), SAMPLES), np.uint64(0xFFFFFFFFFFFFFFFF))
        group = np.cumsum(np.concatenate([[True], text[1:] != text[:-1]])) - 1
        cls, low = (hashes >> np.uint64(40)).astype(np.int64) % CLASSES, hashes & np.uint64(0xFFFFFFFF)
        for lo in range(0, len(text), 8192):
            hi = min(len(text), lo + 8192)
            c, w, g = cls[lo:hi], weight[lo:hi], group[lo:hi]
            keys = np.empty((hi - lo, SAMPLES), np.uint64)
            values, where = np.unique(w, return_inverse=True)
            for i, v in enumerate(values):
                mine = np.flatnonzero(where == i)
                if v not in self.made and len(self.made) < self.tables and len(mine) > 2000:
                    self.made[v] = self.keys(v, slice(None))
                keys[mine] = self.made[v][c[mine]] if v in self.made else self.keys(v, c[mine])
            keys |= low[lo:hi, None]
            cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            least = np.minimum.reduceat(keys, cuts, axis=0)
            out[g[cuts]] = np.minimum(out[g[cuts]], least)
        return text[starts], out & np.uint64(0xFFFFFFFF)


def bands(samples: np.ndarray) -> np.ndarray:
    """A hash for each band of ROWS samples, different from band to band."""
    cut = samples.reshape(len(samples), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cut.shape[:2]).copy()
    for i in range(ROWS):
        out = mix64(out * np.uint64(0x100000001B3) + cut[:, :, i])
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], idf: np.ndarray, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Each row with a number, the hash of its text, the text compressed, its bands (none without words), how rare its
    shingles are on average (the less, the more of it stands in other documents as well), and their weight in all."""
    import xxhash
    from pyspark import TaskContext

    part, n, sampler = TaskContext.get().partitionId(), 0, keep("sampler", Sampler)
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column(text)]
        found: list = [[]] * len(texts)
        own_share, heavy = np.ones(len(texts)), np.zeros(len(texts))
        for lo, hi in _chunks(texts):
            of, hashes, times = shingles(texts[lo:hi])
            if len(of):
                weight = weights(hashes, times, idf)
                signed, samples = sampler.sample(of, hashes, weight)
                heavy[lo + signed] = np.bincount(of, weight)[signed]
                own_share[lo + signed] = np.round(heavy[lo + signed] / np.bincount(of, 1 + np.log(times))[signed], 6)
                for k, row in zip(signed, bands(samples), strict=True):
                    found[lo + k] = row
        node = np.array([xxhash.xxh3_64_intdigest(t if t.strip() else b"") for t in texts], np.uint64).view(np.int64)
        rest = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name != text]
        packed = [pack(t) if ok else None for ok, t in zip(batch.column(text).is_valid().to_pylist(), texts, strict=True)]
        own = [pa.array((part << 33) + np.arange(n, n + len(texts))), pa.array(node), pa.array(packed, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(own_share), pa.array(heavy)]
        more = list(zip(names, own, strict=True))
        n += len(texts)
        yield pa.RecordBatch.from_arrays([c for _, c in rest + more], names=[c for c, _ in rest + more])


def _pairs(batches: Iterator[pa.RecordBatch], idf: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """The batch in slices whose texts hold about `most` bytes, and for each pair the hashes and weights of both texts."""
    keep("near_dedup")
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        a, b, packed = batch.column("a").to_pylist(), batch.column("b").to_pylist(), (batch.column("pa"), batch.column("pb"))
        lo = 0
        while lo < len(a):
            hi, held = lo, 0
            place: dict[int, int] = {}
            texts: list[bytes] = []
            while hi < len(a) and (held < most or hi == lo):
                for node, column in ((a[hi], packed[0]), (b[hi], packed[1])):
                    if node not in place:
                        place[node] = len(texts)
                        texts.append(unpack(column[hi].as_py()))
                        held += len(texts[-1])
                hi += 1
            of, hashes, times = shingles(texts)
            weight = weights(hashes, times, idf).astype(np.float64)
            cuts = np.searchsorted(of, np.arange(len(texts) + 1))
            bags = [(hashes[i:j], weight[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield batch.slice(lo, hi - lo), [(*bags[place[x]], *bags[place[y]]) for x, y in zip(a[lo:hi], b[lo:hi], strict=True)]
            lo = hi


def _held(hx: np.ndarray, hy: np.ndarray, wy: np.ndarray) -> np.ndarray:
    """What each shingle of hx weighs in the other text."""
    if not len(hy):
        return np.zeros(len(hx))
    at = np.minimum(np.searchsorted(hy, hx), len(hy) - 1)
    return np.where(hy[at] == hx, wy[at], 0.0)


def _verify(batches: Iterator[pa.RecordBatch], idf: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs whose weighted Jaccard similarity reaches `least`."""
    for batch, bags in _pairs(batches, idf):
        good = []
        for hx, wx, hy, wy in bags:
            common = np.minimum(wx, _held(hx, hy, wy)).sum()
            good.append(bool(common >= (least - 1e-9) * (wx.sum() + wy.sum() - common)))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


DIFFERENCE = pa.list_(pa.struct([("hash", pa.int64()), ("more", pa.float64())]))
MET = "gid long, a long, b long, own double, common double, weight double, pivot double, over array<struct<hash:long,more:double>>, under array<struct<hash:long,more:double>>"


def _differences(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a text and its pivot have in common, what each weighs, and where the text has more of a shingle (over) or less (under)."""
    for batch, bags in _pairs(batches, idf):
        common, weight, pivot, over, under = [], [], [], [], []
        for hx, wx, hy, wy in bags:
            mine, theirs = wx - _held(hx, hy, wy), wy - _held(hy, hx, wx)
            weight.append(wx.sum())
            pivot.append(wy.sum())
            common.append(weight[-1] - mine[mine > 0].sum())
            for out, hashes, more in ((over, hx, mine), (under, hy, theirs)):
                at = np.flatnonzero(more > 1e-9)
                out.append((hashes[at].view(np.int64), more[at]))
        lists = []
        for found in (over, under):
            cuts = np.cumsum([0, *(len(h) for h, _ in found)]).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([h for h, _ in found])), pa.array(np.concatenate([m for _, m in found]))], fields=list(DIFFERENCE.value_type))
            lists.append(pa.ListArray.from_arrays(pa.array(cuts), flat, type=DIFFERENCE))
        columns = [*(batch.column(c) for c in ("gid", "a", "b", "own")), pa.array(common), pa.array(weight), pa.array(pivot), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MET.split(", ")])


def _may_link(common: Column, weights: Column, least: float) -> Column:
    """Whether two texts with at most `common` in common, of the weights `weights` together, can reach the similarity `least`."""
    return common * (1 + least) >= (least - 1e-6) * weights


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the smallest node reachable over `links` (a, b), by alternating large and small stars.

    Minima are taken by grouped aggregation and settled before they are joined back, so that the edges of a hub are dealt out
    by a plain exchange, which adaptive execution splits: the centre of a large star is never held in one task.
    """
    edges = scratch.settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = scratch.settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.settle(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        own = scratch.settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(own, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = scratch.settle(small)
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        scratch.drop(edges, least, large, own)
        edges = now
        if state == before:
            return scratch.named(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")), edges)
        before = state


def merged(comps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """`comps` after more links: components of components, so that only what the new links touch is looked at."""
    named = links
    for side in ("a", "b"):
        of = comps.select(F.col("node").alias(side), F.col("comp").alias("__c"))
        named = named.join(of, side, "left").withColumn(side, F.coalesce("__c", side)).drop("__c")
    fresh = components(named, scratch)
    of = fresh.select(F.col("node").alias("comp"), F.col("comp").alias("now"))
    moved = comps.join(of, "comp", "left").select("node", F.coalesce("now", "comp").alias("comp"))
    out = scratch.settle(moved.union(fresh.join(comps, "node", "left_anti")))
    scratch.drop(comps, fresh)
    return out


def _side_by_side(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """`pairs` (a, b and more) with both texts. A text b with many partners is dealt out over copies, one for 500 partners."""
    pairs = scratch.settle(pairs)
    busy = scratch.settle(pairs.groupBy("b").agg(F.ceil(F.count("*") / 500).cast("int").alias("copies")))
    dealt = pairs.join(busy, "b").withColumn("salt", F.pmod(F.hash("a"), F.col("copies")))
    copied = busy.join(texts, busy.b == texts.node).select("b", F.col("packed").alias("pb"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    return dealt.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a").join(copied, ["b", "salt"])


#: Texts of a list of so many are paired at once; longer lists become groups with a pivot of their own.
SHORT = 64


class Linker:
    """Links of nodes that may be alike, without comparing all pairs of a group.

    A group is a set of nodes of which any two may be alike. All are compared with one of them, which gives, for each text x and
    shingle, by how much x differs from it. Where most texts of the group differ in the same way, the difference is taken for
    the pivot's own: what is left are differences d(x) from the group's centre, a bag of shingles that need not be a text. Then
    the weights in which x and y differ are exactly  |d(x)| + |d(y)| - 2 s,  s being the weight of the differences they share (in
    the same shingle, to the same side), and they are alike if that is at most  k (W_x + W_y),  k = (1 - least) / (1 + least).
    Let c be the text with the least |d(c)| - k W_c. Two texts that share no difference and are alike are both alike c, by that
    formula. So, once all are held against c, every pair that is still to be looked at stands in a list: of the texts with one
    and the same difference. Short lists give pairs, which are dropped by exact bounds or else compared as texts; a long list is
    a smaller group with a centre of its own, and lists of one group with the same most typical text are one. A list whose texts
    are in one component already is done. c leaves its group, so every line of groups ends.
    """

    def __init__(self, texts: DataFrame, comps: DataFrame, idf: np.ndarray, least: float, scratch: Scratch):
        self.texts, self.comps, self.idf, self.least, self.scratch = texts, comps, idf, least, scratch

    def add(self, links: DataFrame) -> None:
        if not links.isEmpty():
            self.comps = merged(self.comps, links, self.scratch)

    def verified(self, pairs: DataFrame) -> DataFrame:
        both = _side_by_side(pairs.select("a", "b").distinct(), self.texts, self.scratch)
        return self.scratch.settle(both.select("a", "b", "pa", "pb").mapInArrow(partial(_verify, idf=self.idf, least=self.least), "a long, b long"))

    def placed(self, df: DataFrame, node: str) -> DataFrame:
        return df.join(self.comps.select(F.col("node").alias(node), "comp"), node, "left").withColumn("comp", F.coalesce("comp", node))

    def run(self, groups: DataFrame) -> None:
        """Find the links inside `groups` (gid, node, own); texts are compared with the node with the least `own`."""
        scratch = self.scratch
        groups = scratch.settle(groups)
        while not groups.isEmpty():
            first = scratch.settle(groups.groupBy("gid").agg(F.min(F.struct("own", "node")).alias("first")).select("gid", F.col("first.node").alias("b")))
            pairs = groups.join(first, "gid").select("gid", F.col("node").alias("a"), "b", "own").where("a <> b")
            both = _side_by_side(pairs, self.texts, scratch)
            met = scratch.settle(both.select("gid", "a", "b", "own", "pa", "pb").mapInArrow(partial(_differences, idf=self.idf), MET))
            alike = F.col("common") >= (self.least - 1e-9) * (F.col("weight") + F.col("pivot") - F.col("common"))
            self.add(met.where(alike).select("a", "b"))
            held = self._lists(met)
            self.add(self.verified(self._pairs(held)))
            far = held.where(F.col("n") > SHORT)
            heads = scratch.settle(far.groupBy("gid", "side", "hash").agg(F.min(F.struct("own", "a")).alias("first")).select("gid", "side", "hash", F.xxhash64("gid", "first.a").alias("child")))
            below = scratch.settle(far.join(heads, ["gid", "side", "hash"]).groupBy(F.col("child").alias("gid"), F.col("a").alias("node")).agg(F.min("own").alias("own")))
            scratch.drop(groups, first, met, held, heads)
            groups = below

    def _centred(self, met: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The nodes of groups that are not in one component (gid, a, own, weight, d) and their differences from the centre
        (gid, hash, a, more, signed); d is what these weigh."""
        scratch = self.scratch
        node = met.select("gid", "a", "own", "weight", "over", "under")
        none = F.array().cast(met.schema["over"].dataType)
        pivots = met.groupBy("gid", "b").agg(F.first("pivot").alias("weight")).select("gid", F.col("b").alias("a"), F.lit(9.0).alias("own"), "weight", none.alias("over"), none.alias("under"))
        placed = self.placed(node.unionByName(pivots), "a")
        live = scratch.settle(placed.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("all")).where("lo <> hi AND all > 2").select("gid", "all"))
        nodes = scratch.settle(placed.join(live, "gid").drop("comp"))
        each = F.concat("over", F.transform("under", lambda x: F.struct(x["hash"].alias("hash"), (-x["more"]).alias("more"))))
        rows = scratch.settle(nodes.withColumn("d", F.explode(each)).select("gid", "all", "d.hash", "a", F.round("d.more", 9).alias("more")))
        # A difference that more than half of the group has is the pivot's own.
        values = rows.groupBy("gid", "hash", "more", "all").agg(F.count("*").alias("n")).where(F.col("n") * 2 > F.col("all"))
        moved = scratch.settle(values.select("gid", "hash", F.col("more").alias("shift")))
        every = nodes.select("gid", "a").join(moved, "gid").join(rows.select("gid", "hash", "a", "more"), ["gid", "hash", "a"], "left")
        shifted = every.select("gid", "hash", "a", (F.coalesce("more", F.lit(0.0)) - F.col("shift")).alias("more"))
        others = rows.join(moved, ["gid", "hash"], "left_anti").select("gid", "hash", "a", "more")
        left = scratch.settle(shifted.unionByName(others).where(F.abs("more") > 1e-7))
        sums = left.groupBy("gid", "a").agg(F.sum(F.abs("more")).alias("d"), F.sum(F.greatest("more", F.lit(0.0))).alias("over"))
        facts = nodes.select("gid", "a", "own", "weight").join(sums, ["gid", "a"], "left").na.fill(0.0, ["d", "over"])
        facts = scratch.settle(facts.select("gid", "a", "own", "weight", "d", (F.col("weight") - F.col("over")).alias("common")))
        scratch.drop(live, nodes, rows, moved)
        return facts, left

    def _lists(self, met: DataFrame) -> DataFrame:
        """(gid, side, hash, a, own, comp, weight, common, d, more, n): the lists of two texts and more that are not all in one
        component, after all texts have been held against c.

        Texts that lack the same shingle (side -1) are listed for pairs whose shares in common with the centre alone would do: x
        with y where reach(x) is at least the weight of y and the other way round. In any other pair something must be over in
        both (side 1).
        """
        scratch, t = self.scratch, self.least
        k = (1 - t) / (1 + t)
        facts, diffs = self._centred(met)
        middle = scratch.settle(facts.groupBy("gid").agg(F.min(F.struct((F.col("d") - k * F.col("weight")).alias("f"), "a", "d", "weight")).alias("c")).select("gid", F.col("c.a").alias("c"), F.col("c.d").alias("cd"), F.col("c.weight").alias("cw")))
        own = diffs.join(middle.select("gid", F.col("c").alias("a")), ["gid", "a"]).select("gid", "hash", F.col("more").alias("cm"))
        common = F.least(F.abs("more"), F.abs("cm"))
        shared = diffs.join(own, ["gid", "hash"]).where(F.signum("more") == F.signum("cm")).groupBy("gid", "a").agg(F.sum(common).alias("s"))
        apart = F.col("d") + F.col("cd") - 2 * F.coalesce("s", F.lit(0.0))
        linked = facts.join(middle, "gid").join(shared, ["gid", "a"], "left").where((F.col("a") != F.col("c")) & (apart <= k * (F.col("weight") + F.col("cw")) + 1e-6))
        self.add(self.scratch.settle(linked.select("a", F.col("c").alias("b"))))
        homes = self.placed(middle.select("gid", "c"), "c").select("gid", "c", F.col("comp").alias("home"))
        rest = scratch.settle(self.placed(facts, "a").join(homes, "gid").where("a <> c"))
        reach = F.col("common") * ((1 + t) / t) * (1 + 1e-6) - F.col("weight")
        known = rest.select("gid", "a", "own", "comp", "common", "weight", "d", reach.alias("reach"), (F.col("comp") != F.col("home")).alias("waits"))
        rows = scratch.settle(diffs.join(known, ["gid", "a"]).select("gid", F.signum("more").cast("int").alias("side"), "hash", "a", "own", "comp", "common", "weight", "d", "reach", "waits", F.abs("more").alias("more")))
        stats = rows.groupBy("gid", "side", "hash").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("weight").alias("light"), F.max("reach").alias("far"),
            F.min(F.when(F.col("waits"), F.col("weight"))).alias("wlight"), F.max(F.when(F.col("waits"), F.col("reach"))).alias("wfar"),
        )
        some = scratch.settle(stats.where("lo <> hi").drop("lo", "hi"))
        able = F.expr("side = 1 OR (waits AND reach >= light AND weight <= far) OR (NOT waits AND weight <= wfar AND reach >= wlight)")
        names = ("gid", "side", "hash", "a", "own", "comp", "common", "weight", "d", "more")
        kept = scratch.settle(rows.join(some, ["gid", "side", "hash"]).where(able).select(*names))
        scratch.drop(facts, diffs, middle, rest, rows, some)
        for _ in range(2):
            # With what it has over in lists, and with no more, a text may add to what it has in common with the centre.
            more = F.sum(F.when(F.col("side") == 1, F.col("more")).otherwise(0.0))
            able = F.col("c") + F.col("mass") >= (t - 1e-6) * F.col("w")
            mass = scratch.settle(kept.groupBy("gid", "a").agg(more.alias("mass"), F.first("common").alias("c"), F.first("weight").alias("w")).where(able).select("gid", "a"))
            left = kept.join(mass, ["gid", "a"])
            sizes = left.groupBy("gid", "side", "hash").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            sizes = scratch.settle(sizes.where("lo <> hi").drop("lo", "hi"))
            now = scratch.settle(left.select(*names).join(sizes, ["gid", "side", "hash"]))
            scratch.drop(kept, mass, sizes)
            kept = now
        return kept

    def _pairs(self, held: DataFrame) -> DataFrame:
        """(a, b) of different components in a common short list that the exact bounds do not part."""
        t = self.least
        near = held.where(F.col("n") <= SHORT)
        x = near.select("gid", "side", "hash", "a", F.col("comp").alias("ca"), F.col("more").alias("ma"))
        y = near.select("gid", "side", "hash", F.col("a").alias("b"), F.col("comp").alias("cb"), F.col("more").alias("mb"))
        both = x.join(y, ["gid", "side", "hash"]).where("a < b AND ca <> cb")
        share = F.least("ma", "mb")
        shared = both.groupBy("gid", "a", "b").agg(F.sum(F.when(F.col("side") == 1, share).otherwise(0.0)).alias("over"), F.sum(F.when(F.col("side") == -1, share).otherwise(0.0)).alias("under"))
        # What the two share in long lists is not known, but at most what the one with less of it has there.
        lone = lambda side: F.sum(F.when((F.col("n") > SHORT) & (F.col("side") == side), F.col("more")).otherwise(0.0))
        facts = self.scratch.settle(held.groupBy("gid", "a").agg(lone(1).alias("lo"), lone(-1).alias("lu"), F.first("common").alias("common"), F.first("weight").alias("weight"), F.first("d").alias("d")))
        for side in ("a", "b"):
            own = facts.select("gid", F.col("a").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("common", "weight", "d", "lo", "lu")])
            shared = shared.join(own, ["gid", side])
        least = F.least("common_a", "common_b")
        weights = F.col("weight_a") + F.col("weight_b")
        over = F.col("over") + F.least("lo_a", "lo_b")
        # Where the shares in common with the centre would do, all shared lacks are listed, and the formula holds.
        alike = weights / 2 - (F.col("d_a") + F.col("d_b")) / 2 + F.col("under") + F.least("lu_a", "lu_b") + over
        bound = F.when(_may_link(least, weights, t), F.least(least + over, alike)).otherwise(least + over)
        return shared.where(_may_link(bound, weights, t)).select("a", "b")


class Classes:
    """The steps shared by near_classes and near_dedup: `rows` (the input with row, node and packed text) and `placed`, a row for
    each of them: row, node, key, class_id, size, links, kept."""

    def __init__(self, docs: DataFrame, key: str, text: str, least: float):
        self.scratch = scratch = Scratch(small_batches(docs).sparkSession)
        idf = verifying(inverse_frequencies(docs, text))
        fields = [f for f in docs.schema.fields if f.name != text]
        self.names = row, node, packed, sign, own, weight = free_names(docs.columns, "row", "node", "packed", "bands", "own", "weight")
        kinds = (T.LongType(), T.LongType(), T.BinaryType(), T.ArrayType(T.LongType()), T.DoubleType(), T.DoubleType())
        signed = T.StructType(fields + [T.StructField(n, k) for n, k in zip(self.names, kinds, strict=True)])
        self.rows = rows = scratch.settle(docs.mapInArrow(partial(_sign, idf=idf, text=text, names=self.names), signed))
        marks = rows.select(F.col(node).alias("node"), F.col(own).alias("own"), F.col(weight).alias("weight"), F.explode(sign).alias("bucket")).groupBy("bucket", "node").agg(F.min("own").alias("own"), F.min("weight").alias("weight"))
        # A bucket's leader is the text with the least of its own: in a group of near copies, the one that the others vary.
        shared = marks.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("own", "node", "weight")).alias("first")).where("n > 1").select("bucket", F.col("first.node").alias("leader"), F.col("first.weight").alias("most"))
        entries = scratch.settle(marks.join(shared, "bucket"))
        members = entries.select("node").distinct()
        # One row of each node, chosen by numbers, so that the texts of many exact copies never meet.
        chosen = rows.groupBy(F.col(node).alias("node")).agg(F.min(row).alias("row")).join(members, "node", "left_semi")
        texts = scratch.settle(rows.select(F.col(row).alias("row"), F.col(packed).alias("packed")).join(chosen, "row").select("node", "packed"))
        linker = Linker(texts, scratch.settle(members.limit(0).selectExpr("node", "node AS comp")), idf, least, scratch)
        # A text has no more in common with another than the lighter of the two weighs.
        met = entries.where("node <> leader").where(_may_link(F.least("weight", "most"), F.col("weight") + F.col("most"), least))
        linker.add(linker.verified(met.select(F.col("node").alias("a"), F.col("leader").alias("b"))))
        # Buckets that still hold several components and more than two nodes are gathered by their largest component.
        placed = scratch.settle(linker.placed(entries.select("bucket", "node", "own"), "node"))
        sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        mixed = scratch.settle(sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("gid"), F.sum("n").alias("all"), F.count("*").alias("comps")).where("comps > 1 AND all > 2").select("bucket", "gid"))
        crowd = placed.join(mixed, "bucket").groupBy("gid", "node").agg(F.min(F.col("own") + F.when(F.col("comp") == F.col("gid"), 0.0).otherwise(2.0)).alias("own"))
        linker.run(crowd)
        comps = linker.comps
        scratch.drop(entries, texts, placed, mixed)
        ids = rows.select(F.col(node).alias("node"), F.col(row).alias("row"), F.col(key).alias("key"))
        named = ids.join(comps, "node", "left").select("node", "row", "key", F.coalesce("comp", "node").alias("comp"))
        first = F.struct(F.col("key").isNull(), "key", "row")
        # Settled, so that the rows of a large class are dealt out by a plain exchange, which adaptive execution splits.
        classes = scratch.settle(named.groupBy("comp").agg(F.min("key").alias("class_id"), F.min_by("row", first).alias("kept"), F.count("*").alias("size")))
        self.placed = named.join(classes, "comp").select("row", "node", "key", "class_id", "size", (F.col("row") == F.col("kept")).alias("kept"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """key, class_id, class_size, kept for every row: classes of documents linked by a weighted Jaccard similarity of `least`.

    Shingles are five words between blanks, A-Z read as a-z; a text of one to four words is one shingle. A shingle's weight is
    1 + ln(count) times an inverse document frequency (1 to 1.25) over all documents, kept for 2**18 hashed features. Signatures are 21 bands
    of 3 consistent weighted samples of the same weights: two texts at 0.8 share a band with a chance above 0.9999, whatever share
    of all documents holds their shingles. Copies of one text are one node. Candidates are not expanded into all pairs: in each
    bucket every node meets a leader; the nodes of buckets that still hold several components meet a pivot, and beyond it only
    texts that differ from their group's centre in a common shingle, see Linker. So every two nodes of one bucket end up in one
    component, have been compared, or cannot be alike by an exact bound. Links are verified on the texts, or by the exact weights
    of their differences; classes are their components, named by their smallest key.

    Null texts count as empty; texts without words are alike. Null keys: the row takes part, and names no class unless the
    whole class has null keys. One row of each class is `kept`: the smallest key, then the first row. Repeated rows are copies.
    An empty table gives no rows. Two different texts count as copies with a chance of 2**-64 for each pair.
    """
    found = Classes(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", least)
    return found.placed.select(F.col("key").alias(key), "class_id", F.col("size").alias("class_size"), "kept")


def _unpacked(batches: Iterator[pa.RecordBatch], text: str, packed: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        plain = pa.array([None if z is None else unpack(z).decode() for z in batch.column(packed).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([plain if n == text else batch.column(n) for n in names], names=names)


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of `docs` that stand for their near-duplicate class, all columns unchanged; see near_classes."""
    found = Classes(docs, key, text, least)
    row, node, packed, *signs = found.names
    stay = found.placed.where("kept").select(F.col("row").alias(row))
    rows = found.rows.drop(node, *signs).join(stay, row, "left_semi")
    return rows.mapInArrow(partial(_unpacked, text=text, packed=packed, names=docs.columns), docs.schema)
