"""Benchmark decontamination: shared runs of words pick windows and items without loss, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import Scratch, keep, small_batches
from tidelog.llm.textblock import LOWER, NO_WORD, Block, spans

FILTER = 1 << 20


def edits(size: int, share: float) -> int:
    """Word edits allowed for an item of `size` words."""
    return int(share * size)


def search(pattern: dict, size: int, text) -> list[int]:
    """Myers' bit-vectors: for each end in the text, the smallest edit distance of the pattern to a piece that ends there."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    vp, vn, score, found = full, 0, size, []
    for word in text:
        eq = pattern.get(word, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp, hn = vn | ~(xh | vp), vp & xh
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1, hn << 1
        vp, vn = (hn | ~(xv | hp)) & full, hp & xv & full
        found.append(score)
    return found


def masks(words: list[int]) -> dict:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(FILTER)).astype(np.int64)


def _ahead(has: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """How many of the `span` flags from each place on are set."""
    upto = np.zeros(len(has) + 1, np.int32)
    np.cumsum(has, out=upto[1:])
    return upto[np.minimum(at + span, len(has))] - upto[at]


class Index:
    """The benchmark items of one slice: their runs of words, which of them hold a run, and what verification needs."""

    def __init__(self, items: list[tuple], share: float, min_words: int):
        block = Block([(t or "").encode() for _, t in items], NO_WORD, LOWER)
        sizes = np.diff(block.first)
        self.ids = [i for i, _ in items]
        self.chosen = np.flatnonzero(sizes >= min_words)
        self.share = share
        self.words = {int(k): block.word[block.first[k] : block.first[k + 1]].tolist() for k in self.chosen}
        self.sizes = np.unique(sizes[self.chosen])
        # Which runs of two and three words the items hold, a bit for each size of item (or each 64th).
        self.grams = {q: np.zeros(FILTER, np.uint64) for q in (2, 3)}
        if len(self.chosen):
            bit = np.repeat(np.uint64(1) << (np.searchsorted(self.sizes, sizes) % 64).astype(np.uint64), sizes)
            for q, table in self.grams.items():
                at = np.flatnonzero(block.inside(q) & np.isin(np.repeat(sizes, sizes)[: len(block.inside(q))], self.sizes))
                np.bitwise_or.at(table, _slot(block.windows(q)[at]), bit[at])
        self.forward = {k: masks(w) for k, w in self.words.items()}
        self.backward = {k: masks(w[::-1]) for k, w in self.words.items()}
        # For each size, the items of it that hold a run: of the longest runs of which an item shares one with each of its places.
        of = np.repeat(np.arange(len(block)), sizes)
        self.holders: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for size in map(int, self.sizes):
            q = next(q for q in (3, 2, 1) if self.need(size, q) > 0 or q == 1)
            at = np.flatnonzero(block.inside(q) & (sizes[of[: len(block.word) - q + 1]] == size))
            runs, owner = block.windows(q)[at], of[at]
            order = np.lexsort((owner, runs))
            self.holders[size] = q, runs[order], owner[order]
        # Items below min_words, by the hash of all their words.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k in np.flatnonzero((sizes > 0) & (sizes < min_words)):
            whole = int(spans(block.word, block.first[k : k + 1], block.first[k + 1 : k + 2])[0])
            self.short.setdefault(int(sizes[k]), {}).setdefault(whole, []).append(int(k))

    def need(self, size: int, q: int) -> int:
        """Runs of q words that an item shares with any text within the allowed edits: each edit spoils q."""
        return size - q + 1 - q * edits(int(size), self.share)

    def windows(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the item-sized windows after which enough word pairs and triples of items of that size follow.

        A text within k edits of an item of s words has s + k words at most, so the runs are counted that far.
        """
        n = len(block.word)
        if not n or not len(self.sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        masks = {}
        for q, table in self.grams.items():
            masks[q] = np.zeros(n, np.uint64)
            masks[q][: max(0, n - q + 1)] = np.where(block.inside(q), table[_slot(block.windows(q))], np.uint64(0))
        most = int(self.sizes.max())
        reach = most + edits(most, self.share)
        # First with the runs of all sizes together, then by size in what is left.
        rough = np.ones(n, bool)
        for q in masks:
            rough &= _ahead(masks[q] != 0, np.arange(n), reach) >= min(self.need(int(s), q) for s in self.sizes)
        starts = np.flatnonzero(rough)
        edge = np.zeros(n + 1, np.int64)
        edge[starts] += 1
        np.subtract.at(edge, np.minimum(starts + reach, n), 1)
        near = np.flatnonzero(np.cumsum(edge)[:n] > 0)
        masks = {q: m[near] for q, m in masks.items()}
        place = np.searchsorted(near, starts)
        end = np.repeat(block.first[1:], np.diff(block.first))
        left = end[starts] - starts
        found, sizes = [], []
        for i, size in enumerate(map(int, self.sizes)):
            k = edits(size, self.share)
            good = left >= size - k
            for q, m in masks.items():
                has = (m >> np.uint64(i % 64)) & np.uint64(1) != 0
                good &= _ahead(has, place, size + k - q + 1) >= self.need(size, q)
            found.append(starts[good])
            sizes.append(np.full(int(good.sum()), size))
        return np.concatenate(found), np.concatenate(sizes)

    def hits(self, block: Block) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, word after the last, distance) for each place of an item in a text."""
        out = self.copies(block)
        start, size = self.windows(block)
        if not len(start):
            return out
        text = np.searchsorted(block.first, start, "right") - 1
        # Windows of one size that overlap are one region.
        cut = np.flatnonzero((size[1:] != size[:-1]) | (text[1:] != text[:-1]) | (start[1:] > start[:-1] + size[1:])) + 1
        first, last = np.concatenate([[0], cut]), np.append(cut, len(start)) - 1
        runs: dict[int, np.ndarray] = {}
        for lo, hi, words, k in zip(start[first].tolist(), start[last].tolist(), size[first].tolist(), text[first].tolist(), strict=True):
            end = min(hi + words + edits(words, self.share), int(block.first[k + 1]))
            q, held, owner = self.holders[words]
            if q not in runs:
                runs[q] = block.windows(q)
            mine = runs[q][lo : max(lo, end - q + 1)]
            left, right = np.searchsorted(held, mine, "left"), np.searchsorted(held, mine, "right")
            at = np.flatnonzero(left < right)
            # How many places of the region start a run of the item, each run of a place once for an item.
            near = np.concatenate([np.unique(owner[left[i] : right[i]]) for i in at]) if len(at) else np.zeros(0, np.int64)
            items, times = np.unique(near, return_counts=True)
            if self.need(words, q) <= 0:
                items, times = np.unique(owner), None
            for item in (items if times is None else items[times >= self.need(words, q)]).tolist():
                out += [(k, item, a - int(block.first[k]), b - int(block.first[k]), d) for a, b, d in self.places(block.word[lo:end].tolist(), item, lo)]
        return out

    def copies(self, block: Block) -> list[tuple[int, int, int, int, int]]:
        """The places of items below min_words: exact ones only."""
        out = []
        for size, items in self.short.items():
            whole = block.windows(size)
            for i in np.flatnonzero(block.inside(size) & np.isin(whole, np.fromiter(items, np.uint64, len(items)))).tolist():
                text = int(np.searchsorted(block.first, i, "right")) - 1
                at = i - int(block.first[text])
                out += [(text, item, at, at + size, 0) for item in items[int(whole[i])]]
        return out

    def places(self, words: list[int], item: int, offset: int) -> list[tuple[int, int, int]]:
        """(first word, word after the last, distance) of the item's places in a region: the best, then those on either side of it."""
        size = len(self.words[item])
        k, out, left = edits(size, self.share), [], [(0, len(words))]
        while left:
            lo, hi = left.pop()
            if hi - lo < size - k:
                continue
            scores = search(self.forward[item], size, words[lo:hi])
            end = lo + min(range(len(scores)), key=lambda i: (scores[i], i))
            if scores[end - lo] > k:
                continue
            back = search(self.backward[item], size, words[lo : end + 1][::-1])
            begin = end - min(range(len(back)), key=lambda i: (back[i], i))
            out.append((offset + begin, offset + end + 1, scores[end - lo]))
            left += [(lo, begin), (end + 1, hi)]
        return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch], items: list[tuple], options: tuple, key: str, text: str, item_type: pa.DataType, clean: bool) -> Iterator[pa.RecordBatch]:
    from tidelog.llm.near_dedup import _chunks

    keep("decontaminate")
    index = Index(items, *options)
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column(text)]
        hits = []
        for lo, hi in _chunks(texts, 1 << 20):
            hits += [(lo + h[0], *h[1:]) for h in index.hits(Block(texts[lo:hi], NO_WORD, LOWER))]
        if clean:
            clear = np.ones(len(texts), bool)
            clear[[h[0] for h in hits]] = False
            yield batch.filter(pa.array(clear))
        elif hits:
            of, item, first, end, distance = zip(*hits, strict=True)
            columns = [batch.column(key).take(pa.array(of)), pa.array([index.ids[i] for i in item], item_type), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(distance, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "item_id", "first_word", "end_word", "distance"])


def _slices(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[tuple[list[tuple], bool]]:
    """The items in slices of about `most` bytes, each small enough to travel with the tasks, and whether it is the only one.
    One slice at a time is fetched."""
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)))).first()[0] or 0
    n = max(1, -(-size // most))
    own = F.pmod(F.xxhash64(text), F.lit(n))
    rows = benchmark.select(F.col(item), F.col(text))
    for i in range(n):
        yield [tuple(r) for r in rows.where(own == i).sort(item, text).collect()], n == 1


def _passes(docs: DataFrame, benchmark: DataFrame, key, text, item, item_text, share, min_words, slice_bytes, clean) -> Iterator[tuple[partial, T.StructType, bool]]:
    """A pass over the texts for each slice, and whether it is the only one: else its result is settled before the next slice is
    fetched, so that neither the driver nor a task holds more than one."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs)
    kind = benchmark.schema[item].dataType
    schema = docs.schema if clean else T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("item_id", kind), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("distance", T.IntegerType())])
    for items, only in _slices(benchmark, item, item_text, slice_bytes):
        yield partial(_scan, items=items, options=(share, min_words), key=key, text=text, item_type=to_arrow_type(kind), clean=clean), schema, only


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
               share: float = 0.2, min_words: int = 8, slice_bytes: int = 8 << 20) -> DataFrame:
    """key, item_id, first_word, end_word, distance for each place where a text holds a benchmark item with few edits.

    Words are runs of letters and digits, A-Z read as a-z. A place counts if the edit distance in words is at most
    `share` of the item's words (rounded down). Each edit spoils few of the runs of two and three words that an item shares with
    a text: windows, and items for them, are picked by the number of shared runs that must be left, which loses nothing, and what
    is picked is verified exactly with Myers' algorithm. So every text with a place is reported for every item and size.
    Of places of an item that overlap, the best is given. Items below `min_words` words are found in exact copies only.

    Whole texts are streamed, without a shuffle; items travel with the tasks in slices of `slice_bytes`, one pass over the
    texts each, one slice at a time, so memory is bounded for a benchmark of any size. Null and empty texts have no places; null keys stay null; repeated rows give repeated
    places; items that are alike are all reported. An empty table on either side gives no rows.
    """
    docs, scratch = docs.select(key, text), Scratch(docs.sparkSession)
    parts = []
    for scan, schema, only in _passes(docs, benchmark, key, text, item, item_text, share, min_words, slice_bytes, False):
        parts.append(docs.mapInArrow(scan, schema) if only else scratch.settle(docs.mapInArrow(scan, schema)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
               share: float = 0.2, min_words: int = 8, slice_bytes: int = 8 << 20) -> DataFrame:
    """The rows whose text holds no benchmark item, all columns unchanged; see find_leaks."""
    scratch = Scratch(docs.sparkSession)
    for scan, schema, only in _passes(docs, benchmark, key, text, item, item_text, share, min_words, slice_bytes, True):
        docs = docs.mapInArrow(scan, schema) if only else scratch.settle(docs.mapInArrow(scan, schema))
    return docs

