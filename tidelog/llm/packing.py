"""Sequence packing: tokenise, cut, and hierarchical best-fit packing with residuals."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Memo, Scratch, keep, small_batches

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])
BINS = "bin long, used int, items array<struct<doc_id:long,piece:int,start:long,length:int,ids_crc32:long>>"
BIN_FIELDS = pa.schema([("bin", pa.int64()), ("used", pa.int32()), ("items", pa.list_(ITEM))])


def token_bytes(tokenizer_path: str) -> Memo:
    """Little-endian ids of a chunk without blanks, remembered, as a bounded number of bytes.

    Words of this vocabulary never span a blank, and blanks give no ids, so chunks may be encoded alone. Letters and the
    punctuation after them are separate words, and letters are lower-cased, which saves many encodings.
    """
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(tokenizer_path)
    encode, merge, spell = tokenizer.encode, tokenizer.model.tokenize, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def ids(chunk: str) -> bytes:
        if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
            return memo[chunk[:-1]] + memo[chunk[-1]]
        if chunk.isalpha() and max(chunk) < "\u0100":
            # Letters up to Latin-1 are one word, and lower-casing is all that normalising does to them.
            word = chunk.lower()
            if word != chunk:
                return memo[word]
            found = [t.id for t in merge(word if word.isascii() else spell(word)[0][0])]
        else:
            found = encode(chunk, add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()

    memo = Memo(ids)
    return memo


def document_ids(text: str | None, chunks: Memo) -> bytes:
    """A document's ids, closed by id 1."""
    words = (text or "").replace("\n", " ").replace("\t", " ").split(" ")
    return b"".join(map(chunks.__getitem__, words)) + b"\x01\0\0\0"


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    chunks = keep(("packing", path), partial(token_bytes, path))
    step = 4 * limit
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = document_ids(text.as_py(), chunks)
            for k, at in enumerate(range(0, len(ids), step)):
                cut = ids[at : at + step]
                rows.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ITEM, strict=True)] if rows else [pa.array([], f.type) for f in ITEM], schema=pa.schema(list(ITEM)))


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest open bin that has room for it. Gives the items of each bin."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the rooms that any open bin has, ascending; limit values at most
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(rooms, sizes[i])
        if at == len(rooms):
            b, room = len(bins), limit
            bins.append([i])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            bins[b].append(i)
        if left := room - sizes[i]:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def _bin_rows(items: list[list[dict]], first: int) -> pa.RecordBatch:
    used = [sum(x["length"] for x in b) for b in items]
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(items)), pa.int64()), pa.array(used, pa.int32()), pa.array(items, pa.list_(ITEM))], schema=BIN_FIELDS)


def _pack_pieces(batches: Iterator[pa.RecordBatch], limit: int, most: int) -> Iterator[pa.RecordBatch]:
    """Round 0: pieces of one partition, `most` at a time."""
    held: list[dict] = []
    first = 0
    for batch in batches:
        held += batch.to_pylist()
        while len(held) >= most:
            part, held = held[:most], held[most:]
            bins = [[part[i] for i in b] for b in best_fit([x["length"] for x in part], limit)]
            yield _bin_rows(bins, first)
            first += len(bins)
    if held:
        yield _bin_rows([[held[i] for i in b] for b in best_fit([x["length"] for x in held], limit)], first)


def _merge_bins(rows: pa.Table, limit: int) -> pa.Table:
    """A later round: underfull bins are the items."""
    held = sorted(rows.select(["used", "items"]).to_pylist(), key=lambda r: (-r["used"], [(x["doc_id"] is None, x["doc_id"] or 0, x["piece"]) for x in r["items"][:1]]))
    bins = [[x for i in b for x in held[i]["items"]] for b in best_fit([r["used"] for r in held], limit)]
    return pa.Table.from_batches([_bin_rows(bins, 0)])


def pack(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 4096, doc_id: str = "doc_id", text: str = "text",
         slack: int = 4, fan_in: int = 8, most_bins: int = 40_000) -> DataFrame:
    """Pack tokenised documents into sequences of at most `limit` tokens; a row for each piece, with its sequence and offset.

    A document is its ids and id 1; only one longer than `limit` is cut, into pieces of `limit`. Full pieces are sequences
    of their own. The others are packed by best-fit decreasing inside their partition; bins with at most `slack` tokens of
    room leave at once, and underfull bins are merged in a tree, `fan_in` groups into one, as the items of another best-fit
    round, until one group is left or a round frees no bin. A group holds about `most_bins` bins: beyond that there are more
    groups in a round, never larger ones, so memory is bounded and every bin takes part in every round.

    Null and empty texts are id 1 alone. Null ids stay null; repeated rows are packed each, their pieces alike. An empty
    table gives no rows. Other columns of the input play no part.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    scratch = Scratch(small_batches(docs).sparkSession)
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = scratch.settle(chosen.mapInArrow(partial(_tokenise, path=tokenizer_path, limit=limit), PIECES))
    full = pieces.where(F.col("length") == limit).select(F.lit(limit).alias("used"), F.array(F.struct(*ITEM.names)).alias("items"))
    packed = pieces.where(F.col("length") < limit).mapInArrow(partial(_pack_pieces, limit=limit, most=most_bins), BINS)
    level = scratch.settle(packed.withColumn("grp", F.spark_partition_id().cast("long")))
    done = [full]
    groups = level.agg(F.countDistinct("grp")).first()[0]
    before = None
    while True:
        closed = F.col("used") >= limit - slack
        done.append(level.where(closed).select("used", "items"))
        open_bins = level.where(~closed)
        n = open_bins.count()
        target = max(-(-groups // fan_in), -(-n // most_bins))
        if n == 0 or groups <= 1 or (target >= groups and before is not None and n >= before):
            done.append(open_bins.select("used", "items"))
            break
        grp = F.col("grp") if target < groups else F.xxhash64("bin", "grp")
        merged = open_bins.withColumn("grp", F.pmod(grp, F.lit(target))).groupBy("grp").applyInArrow(_merge_one(limit), f"grp long, {BINS}")
        groups, before, level = target, n, scratch.settle(merged)
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "items")
    return numbered.mapInArrow(_place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece, at its offset in its sequence."""
    for batch in batches:
        items = batch.column(1)
        flat, ends = items.flatten(), np.asarray(items.offsets)
        ends = ends - ends[0]
        counts = np.diff(ends)
        lengths = np.asarray(flat.field("length")).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(lengths)])
        offset = before[:-1] - np.repeat(before[ends[:-1]], counts)
        ids = np.repeat(np.asarray(batch.column(0)), counts)
        columns = [flat.field(f.name) for f in ITEM]
        columns[3] = pa.array(lengths)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(ids), pa.array(offset)], names=[*ITEM.names, "sequence_id", "offset"])


def _merge_one(limit: int):
    def merge(key, rows):
        out = _merge_bins(rows, limit)
        return out.add_column(0, "grp", pa.array([key[0].as_py()] * out.num_rows, pa.int64()))

    return merge
