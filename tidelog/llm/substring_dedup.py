"""Substring dedup by level-wise doubling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import Scratch, small_batches
from tidelog.llm.textblock import Block, sliding_argmin


def lengths(width: int, least: int = 9) -> list[int]:
    """Window lengths: each at most twice the one before, the last is `width`."""
    found = [width]
    while found[0] > least:
        found.insert(0, -(-found[0] // 2))
    return found


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Gather rows into blocks of about `most` bytes of text, texts compressed."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        keys, texts = batch.column(0), [(t.as_py() or "").encode() for t in batch.column(1)]
        sizes = np.cumsum([len(t) for t in texts])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, "right")))
            packed = [pack(t) for t in texts[lo:hi]]
            empty = pa.array([[b""] * (hi - lo)], pa.list_(pa.binary()))
            ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), keys.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), ids, pa.array([packed], pa.list_(pa.binary())), empty], names=["block", "keys", "texts", "marks"])
            lo, n = hi, n + 1


def _open(texts: list[bytes]) -> Block:
    unpack = zstandard.ZstdDecompressor().decompress
    return Block([unpack(t) for t in texts])


def _marked(block: Block, marks: list[bytes], width: int) -> np.ndarray:
    """Candidate windows of a block, by first word; no marks yet: all."""
    n = max(0, len(block.word) - width + 1)
    inside = block.inside(width)
    for k, m in enumerate(marks):
        lo, hi = block.first[k], block.first[k + 1]
        if m and lo < n:
            got = np.unpackbits(np.frombuffer(m, np.uint8), count=hi - lo).astype(bool)
            inside[lo : min(hi, n)] &= got[: max(0, min(hi, n) - lo)]
    return inside


class Level:
    """What one length asks about a block: hashes of windows, and what the answers mean for the candidates."""

    def __init__(self, block: Block, candidates: np.ndarray, width: int, size: int, sampled: bool, bits: int):
        self.n, self.width = len(candidates), width
        self.at = at = np.flatnonzero(candidates)
        windows = block.windows(size)
        if sampled:  # windows that are equal have their smallest sub-window at the same place: only that is looked at
            self.parts = [sliding_argmin(windows, width - size + 1)[at]]
        else:
            self.parts = [at] if size == width else [at, at + (width - size)]
        self.places = np.unique(np.concatenate(self.parts))
        filters = size < width
        hashes = windows[self.places] >> np.uint64(24 * filters)  # a filter may err towards keeping: 40 bits are enough
        self.hashes, self.inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        self.several = counts > 1
        shift = np.uint64((40 if filters else 64) - bits)
        self.bucket = (self.hashes >> shift).astype(np.int64)
        self.payload = (self.hashes & np.uint64((1 << int(shift)) - 1)).astype("<u4") if filters else self.hashes

    def keep(self, repeated: np.ndarray) -> np.ndarray:
        """The candidates all of whose parts are repeated; `repeated` goes with `hashes`."""
        good = np.zeros(self.n + self.width, bool)
        good[self.places] = repeated[self.inverse]
        out = np.zeros(self.n, bool)
        out[self.at] = np.all([good[p] for p in self.parts], axis=0)
        return out


def _ask(batches: Iterator[pa.RecordBatch], level: tuple) -> Iterator[pa.RecordBatch]:
    """For each block, its distinct hashes by bucket, and which of them it has more than once."""
    width, size, sampled, bits = level
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("several", pa.binary())])
    for batch in batches:
        for row in range(batch.num_rows):
            block = _open(batch.column("texts")[row].as_py())
            asked = Level(block, _marked(block, batch.column("marks")[row].as_py(), width), width, size, sampled, bits)
            buckets, lo = np.unique(asked.bucket, return_index=True)
            cuts = [*lo, len(asked.bucket)]
            name = batch.column("block")[row].as_py()
            rows = [(int(b), name, asked.payload[i:j].tobytes(), np.packbits(asked.several[i:j]).tobytes()) for b, i, j in zip(buckets, cuts[:-1], cuts[1:], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _merger(narrow: bool):
    def merge(key, rows):
        """Which hashes of one bucket stand in two blocks, or twice in one; answered to each block as bits."""
        found = [np.frombuffer(x, "<u4" if narrow else "<u8") for x in rows.column("hashes").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(f)) for x, f in zip(rows.column("several").to_pylist(), found, strict=True)]
        _, inverse = np.unique(np.concatenate(found), return_inverse=True)
        repeated = np.bincount(inverse, weights=1 + np.concatenate(several))[inverse] > 1
        cuts = np.cumsum([0, *map(len, found)])
        bits = [np.packbits(repeated[i:j]).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"block": rows.column("block"), "bucket": pa.array([key[0].as_py()] * len(bits), pa.int64()), "bits": pa.array(bits, pa.binary())})

    return merge


def _answerer(level: tuple, key_type: pa.DataType):
    width, size, sampled, bits = level

    def answer(key, blocks, replies):
        """Narrow a block's candidates; documents without any leave the loop (open = false)."""
        if not blocks.num_rows:
            return _state([], key_type)
        keys, texts, marks = (blocks.column(c)[0].as_py() for c in ("keys", "texts", "marks"))
        block = _open(texts)
        asked = Level(block, _marked(block, marks, width), width, size, sampled, bits)
        _, counts = np.unique(asked.bucket, return_counts=True)
        order = np.argsort(replies.column("bucket").to_numpy()) if replies.num_rows else []
        got = replies.column("bits")
        repeated = [np.unpackbits(np.frombuffer(got[int(i)].as_py(), np.uint8), count=n) for i, n in zip(order, counts, strict=True)]
        left = asked.keep(np.concatenate(repeated).astype(bool)) if repeated else np.zeros(asked.n, bool)
        stay, gone, now = [], [], []
        for k in range(len(block)):
            mine = left[block.first[k] : block.first[k + 1]]
            if mine.any():
                full = np.zeros(block.first[k + 1] - block.first[k], bool)
                full[: len(mine)] = mine
                stay.append(k)
                now.append(np.packbits(full).tobytes())
            else:
                gone.append(k)
        name = key[0].as_py()
        rows = [(name, is_open, [keys[k] for k in at], [texts[k] for k in at], m) for is_open, at, m in ((True, stay, now), (False, gone, [b""] * len(gone))) if at]
        return _state(rows, key_type)

    return answer


def _state(rows: list[tuple], key_type: pa.DataType) -> pa.Table:
    schema = pa.schema([("block", pa.int64()), ("open", pa.bool_()), ("keys", pa.list_(key_type)), ("texts", pa.list_(pa.binary())), ("marks", pa.list_(pa.binary()))])
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _result(batches: Iterator[pa.RecordBatch], width: int, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", key_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    for batch in batches:
        for row in range(batch.num_rows):
            keys, texts, marks = (batch.column(c)[row].as_py() for c in ("keys", "texts", "marks"))
            block = _open(texts)
            n = len(block.word)
            removed = np.zeros(n + 1, np.int64)
            if any(marks):
                at = np.flatnonzero(_marked(block, marks, width))
                removed[at] += 1
                np.subtract.at(removed, at + width, 1)
            stays = np.cumsum(removed)[:n] == 0
            unpack = zstandard.ZstdDecompressor().decompress
            out = []
            for k, text in enumerate(texts):
                lo, hi = block.first[k], block.first[k + 1]
                words, mine = unpack(text).split(), stays[lo:hi]
                kept = words if mine.all() else [words[i] for i in np.flatnonzero(mine)]
                out.append((keys[k], len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def substring_dedup(docs: DataFrame, width: int = 35, key: str = "doc_id", text: str = "text", block_bytes: int = 2 << 20, least: int = 9) -> DataFrame:
    """Remove every word covered by a window of `width` words that also starts at another place of the corpus.

    Words stand between blanks (space, bytes 9 to 13). Lengths double from about `least` to `width`: windows of one length
    are looked at only where those of the length before were repeated, and the loop ends when no candidates survive. At the
    first length, one sub-window of each window is enough, the one with the smallest hash, as equal windows have it at the
    same place. Texts are held in blocks; a block asks with its distinct hashes, dealt out by hash, and gets a bit for each,
    so a passage that stands in every document costs each block one hash. Documents without candidates leave the loop.

    Returns key, n_words, n_removed and kept (the kept words joined by one space), a row for each input row. Null and empty
    texts: no words, kept ''. Repeated rows are copies of each other. Null keys stay null. Empty table: empty result. Other
    columns are not looked at. Two different windows are taken for equal with a chance of 2**-64 for each pair.
    """
    scratch = Scratch(small_batches(docs).sparkSession)
    kind = docs.schema[key].dataType
    key_type = _arrow_type(kind)
    state_type = T.StructType([T.StructField("block", T.LongType()), T.StructField("open", T.BooleanType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("texts", T.ArrayType(T.BinaryType())), T.StructField("marks", T.ArrayType(T.BinaryType()))])
    first = T.StructType([f for f in state_type.fields if f.name != "open"])
    state = scratch.settle(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(partial(_blocks, most=block_bytes), first))
    blocks = state.count()
    bits = min(28, max(8, (blocks * block_bytes // (64 << 20)).bit_length()))
    done, chain = [], lengths(width, least)
    for n, size in enumerate(chain):
        level = (width, size, n == 0 and size < width, bits)
        asked = state.mapInArrow(partial(_ask, level=level), "bucket long, block long, hashes binary, several binary")
        replies = asked.groupBy("bucket").applyInArrow(_merger(size < width), "block long, bucket long, bits binary")
        answered = scratch.settle(state.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_answerer(level, key_type), state_type))
        scratch.drop(*([state] if n == 0 else []))
        done.append(answered.where("NOT open"))
        state = answered.where("open")
        if n == len(chain) - 1 or state.isEmpty():
            done.append(state)
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    out = T.StructType([T.StructField("key", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return every.select("keys", "texts", "marks").mapInArrow(partial(_result, width=width, key_type=key_type), out).withColumnRenamed("key", key)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
