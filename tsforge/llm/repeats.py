"""Exact repeats by suffix arrays: bytes covered by a string of ``size`` bytes that also starts in
a document with a smaller id.

Every string of ``size`` bytes has an anchor: the smallest hash of the 16-byte strings in it.
Equal strings have equal anchors, and neighbouring strings mostly share theirs, so each document
falls into segments (the strings of one anchor in a row, about 67 bytes at size 50).

1. Each task sums up its documents' segments: of equal ones the smallest id alone goes on, to a
   shard by anchor, as two hashes (96 bits of anchor and segment); the others are known to be
   repeats whole. A shard settles the same over all tasks. What is left is one owner for each
   distinct segment, and only those whose anchor has several distinct segments can hold a string
   that another holds.
2. These owners send their bytes, so each distinct segment once, to the shards. Each shard's
   segments are cut down to what lies between strings whose hash occurs twice there. Of these texts,
   each once, it builds a suffix array by induced sorting (suffix_array.py), and permuted common
   prefixes of ``size`` bytes and more join neighbours into groups of equal strings. A group's
   smallest document keeps its string; in the others it is a repeat.
3. Each document's repeated segments and parts of segments, known by the segment's hash, are
   merged and cut out.

Shards grow in number with the input, and equal segments meet as one row for each million segments
that a task read. A passage that very many documents hold between different neighbours has as many
different segments of one anchor; beyond about HOT of them (estimated on a share of the documents)
each string of that anchor is a segment of its own, dealt by its own hash, and settled in step 1.

Defined results: null and empty texts have nothing removed; a row without id takes no part and
keeps its text; rows of one id are one document, so that neither repeats the other, and what it
repeats is cut from each of them; strings never cross documents; what is judged is the input, not
what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import materialize, sliced
from tsforge.llm.minhash import MIX, mixed
from tsforge.llm.suffix_array import common_prefixes, suffix_array

GRAM = 16
#: Bytes of text for each shard.
SHARD_BYTES = 4 << 20
#: Segments that a task sums up at once.
TOGETHER = 1_000_000
#: An odd factor whose powers tell the places inside a segment apart.
STEP = 0x9E3779B97F4A7C15


#: Different segments of one anchor beyond which each of its strings is dealt by itself.
HOT = 1 << 15
#: Hot anchors that a task knows. Others have a smaller share of all segments than one in so many.
MOST_HOT = 100_000
NONE = np.empty(0, np.uint64)


class Powers:
    """Powers of STEP modulo 2**64, and of its inverse, as far as a text needs them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, count: int) -> None:
        if len(self.up) < count:
            size = max(count, 2 * len(self.up))
            self.up, self.down = (
                np.cumprod(np.append(np.uint64(1), np.full(size - 1, factor, np.uint64))) for factor in (np.uint64(STEP), np.uint64(pow(STEP, -1, 1 << 64)))
            )


POWERS = Powers()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place on."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = words[:-8] * np.uint64(STEP)
    out += words[8:] * MIX[0]
    out ^= out >> np.uint64(29)
    out *= MIX[1]
    out ^= out >> np.uint64(32)
    return out


def segments(data: np.ndarray, size: int, hot: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash of the bytes, first start, last start) of the runs of starts whose strings
    share an anchor. Of a ``hot`` anchor each string is a segment, with its own hash as anchor."""
    count = len(data) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = gram_hashes(data)
    wide, done = grams, 1
    width = size - GRAM + 1
    while done * 2 <= width:
        wide, done = np.minimum(wide[:-done], wide[done:]), done * 2
    least = np.minimum(wide[:count], wide[width - done : width - done + count])
    fresh = np.ones(count, bool)
    np.not_equal(least[1:], least[:-1], out=fresh[1:])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], count) - 1
    anchor = least[first]
    split = np.isin(anchor, hot) if len(hot) else None
    if split is not None and split.any():
        times = np.where(split, last - first + 1, 1)
        run = np.repeat(np.arange(len(first)), times)
        first = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
        split, anchor = split[run], anchor[run]
        last = np.where(split, first, last[run])
    # The segment's 16-byte strings weighted by powers of their places, summed; the powers' start
    # at the document's begin is divided out, so that only the segment's own bytes count.
    POWERS.reach(len(grams))
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(grams * POWERS.up[: len(grams)], out=sums[1:])
    hashes = mixed((sums[last + width] - sums[first]) * POWERS.down[first] + (last - first).astype(np.uint64))
    return anchor if split is None else np.where(split, hashes, anchor), hashes, first, last


def hot_anchors(source: DataFrame, size: int, hot: int) -> np.ndarray:
    """Anchors with about ``hot`` different segments and more, by a share of the documents in
    which such a one shows 64 of them; the MOST_HOT hottest. They decide only where strings meet."""
    parts = max(1, min(64, hot // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [segments(np.frombuffer(text_bytes(t), np.uint8), size)[:2] for t in batch.column("text")]
            anchor, hashes = (np.concatenate([f[k] for f in found] or [NONE]) for k in (0, 1))
            one = np.unique(hashes, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[one].view(np.int64)), pa.array(hashes[one].view(np.int64))], names=["anchor", "hash"])

    share = source.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0).select("text")
    counts = share.mapInArrow(run, "anchor long, hash long").groupBy("anchor").agg(F.count_distinct("hash").alias("n"))
    found = counts.where(F.col("n") >= hot / parts).orderBy(F.desc("n"), "anchor").limit(MOST_HOT).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in found], np.int64).view(np.uint64))


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on, as far as there are so many."""
    grams = gram_hashes(np.append(data, np.zeros(max(0, size - len(data)), np.uint8)))
    out, offsets = 0, [*range(0, size - GRAM, GRAM), size - GRAM]
    for off in offsets:
        out = mixed(grams[off : len(grams) - offsets[-1] + off] + out)
    return out


def shard_and_rest(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int32), hashes.astype(np.uint32)


def text_bytes(value) -> bytes:
    return (value.as_py() or "").encode()


def runs_of(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end) of the runs of equal keys."""
    cuts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)
    yield from zip(keys[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def squeezed(values: np.ndarray | bytes) -> bytes:
    return zstandard.compress(values if isinstance(values, bytes) else values.tobytes(), 3)


def loosened(value, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(value.as_py()), kind)


def packed(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_py(), kind) for v in column if v.is_valid] or [np.empty(0, kind)])


def batch_of(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


SENT = [("shard", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("rest", pa.binary()), ("hashes", pa.binary())]
SENT_SCHEMA = "shard int, ids binary, counts binary, rest binary, hashes binary"


def _by_shard(shard: np.ndarray, ids: np.ndarray, rest: np.ndarray | None, hashes: np.ndarray) -> list[tuple]:
    """Rows (shard, ids, counts, rest, hashes) of entries in the order of shards, then of ids."""
    rows = []
    for s, a, b in runs_of(shard):
        own = ids[a:b]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        # Ascending ids as their differences, which pack well.
        rows.append((
            s, squeezed(np.diff(own[starts], prepend=0)), squeezed(np.diff(np.append(starts, b - a)).astype(np.uint32)),
            None if rest is None else rest[a:b].tobytes(), hashes[a:b].tobytes(),
        ))
    return rows


def _send_hashes(source: DataFrame, size: int, shards: int, hot: np.ndarray) -> DataFrame:
    """By shard: owners of segments so far (rest of the anchor, hash), and, with a null rest,
    segments that are repeats already, dealt by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, hashes, owners, ids, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            id_of, owner = np.unique(np.array(ids, np.int64), return_inverse=True)
            owner = owner[np.repeat(np.arange(len(ids)), owners)]
            anchor, found = np.concatenate(anchors), np.concatenate(hashes)
            order = np.argsort(found)
            found, owner, anchor = found[order], owner[order], anchor[order]
            starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            least = np.minimum.reduceat(owner, starts)
            again = np.flatnonzero(owner > np.repeat(least, np.diff(np.append(starts, len(owner)))))
            shard, rest = shard_and_rest(anchor[starts], shards)
            at = np.argsort(shard.astype(np.int64) << 32 | least)
            rows = _by_shard(shard[at], id_of[least[at]], rest[at], found[starts[at]])
            if len(again):
                deal = (mixed(id_of[owner[again]].view(np.uint64)) % np.uint64(shards)).astype(np.int64)
                at = np.argsort(deal << 32 | owner[again])
                rows += _by_shard(deal[at], id_of[owner[again[at]]], None, found[again[at]])
            return batch_of(rows, SENT)

        for batch in sliced(batches):
            for name, text in zip(batch.column("id"), batch.column("text"), strict=True):
                anchor, found, _, _ = segments(np.frombuffer(text_bytes(text), np.uint8), size, hot)
                if len(found):
                    anchors.append(anchor)
                    hashes.append(found)
                    owners.append(len(found))
                    ids.append(name.as_py())
                    held += len(found)
                if held >= TOGETHER:
                    yield flush()
                    anchors, hashes, owners, ids, held = [], [], [], [], 0
        if held:
            yield flush()

    return source.mapInArrow(run, SENT_SCHEMA)


def _listed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.cumsum(loosened(v, np.int64)) for v in rows.column("ids")] or [np.empty(0, np.int64)])
    counts = np.concatenate([loosened(v, np.uint32) for v in rows.column("counts")] or [np.empty(0, np.uint32)])
    return np.repeat(ids, counts), packed(rows.column("hashes"), np.uint64)


def _settle(rows: pa.Table) -> pa.Table:
    """Of one shard, by document: hashes of segments that are repeats whole, and of those that it
    owns and that have to meet others."""
    known = pc.is_valid(rows.column("rest"))
    done_ids, done = _listed(rows.filter(pc.invert(known)))
    rows = rows.filter(known)
    ids, hashes = _listed(rows)
    rest = packed(rows.column("rest"), np.uint32)
    order = np.lexsort((ids, hashes, rest))
    rest, hashes, ids = (x[order] for x in (rest, hashes, ids))
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (rest[1:] != rest[:-1]))[: len(ids)]
    owner = ids[np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))] if len(ids) else ids
    again = ids > owner
    anchor = np.flatnonzero(np.append(True, rest[fresh][1:] != rest[fresh][:-1])[: int(fresh.sum())])
    several = np.repeat(np.diff(np.append(anchor, fresh.sum())) > 1, np.diff(np.append(anchor, fresh.sum())))
    sends = np.flatnonzero(fresh)[several]
    out = []
    for kind, (who, what) in enumerate(((np.concatenate([done_ids, ids[again]]), np.concatenate([done, hashes[again]])), (ids[sends], hashes[sends]))):
        order = np.argsort(who, kind="stable")
        for name, a, b in runs_of(who[order]):
            blob = what[order[a:b]].tobytes()
            out.append((name, None, blob) if kind else (name, blob, None))
    return pa.Table.from_batches([batch_of(out, [("id", pa.int64()), ("whole", pa.binary()), ("sends", pa.binary())])])


PIECES = [("shard", pa.int32()), ("ids", pa.binary()), ("lengths", pa.binary()), ("hashes", pa.binary()), ("data", pa.binary())]


def _send_pieces(wanted: DataFrame, size: int, shards: int, hot: np.ndarray) -> DataFrame:
    """wanted: id, text and sends, the hashes of the segments whose bytes go to their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        pieces: list[bytes] = []

        def flush() -> pa.RecordBatch:
            shard, ids, lengths, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            order, rows = np.argsort(shard, kind="stable"), []
            for s, a, b in runs_of(shard[order]):
                at = order[a:b]
                rows.append((s, squeezed(ids[at]), squeezed(lengths[at].astype(np.uint32)), hashes[at].tobytes(), squeezed(b"".join(pieces[i] for i in at.tolist()))))
            held.clear()
            pieces.clear()
            return batch_of(rows, PIECES)

        for batch in sliced(batches):
            for name, text, sends in zip(batch.column("id"), batch.column("text"), batch.column("sends"), strict=True):
                data = text_bytes(text)
                anchor, hashes, first, last = segments(np.frombuffer(data, np.uint8), size, hot)
                at = np.flatnonzero(np.isin(hashes, packed(sends.values, np.uint64)))
                held.append((shard_and_rest(anchor[at], shards)[0], np.full(len(at), name.as_py(), np.int64), last[at] - first[at] + size, hashes[at]))
                pieces += [data[a : b + size] for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)]
                if len(pieces) >= TOGETHER // 8:
                    yield flush()
        if pieces:
            yield flush()

    return wanted.mapInArrow(run, "shard int, ids binary, lengths binary, hashes binary, data binary")


#: A part of a segment: the segment's hash, and the part's begin and end in it.
PART = np.dtype([("hash", "<u8"), ("a", "<u4"), ("b", "<u4")])


def _parts_of(size: int):
    def parts(rows: pa.Table) -> pa.Table:
        """Of one shard, by document: the parts of its segments that repeat a string of a smaller
        document."""
        ids, lengths = (np.concatenate([loosened(v, k) for v in rows.column(c)]) for c, k in (("ids", np.int64), ("lengths", np.uint32)))
        hashes, blob = packed(rows.column("hashes"), np.uint64), b"".join(zstandard.decompress(v.as_py()) for v in rows.column("data"))
        begin = np.append(0, np.cumsum(lengths.astype(np.int64)))
        # Rows of one id send a segment each; one is enough.
        one = np.sort(np.unique(hashes, return_index=True)[1])
        ids, hashes, begin, ends = ids[one], hashes[one], begin[:-1][one], begin[1:][one]
        # Of each segment: from the first to the last string whose hash occurs again in the shard.
        starts = ends - begin - size + 1
        of = np.repeat(np.arange(len(ids)), starts)
        place = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts - begin, starts)
        string = window_hashes(np.frombuffer(blob, np.uint8), size)[place]
        order = np.argsort(string)
        fresh = string[order][1:] != string[order][:-1]
        lone = np.empty(len(string), bool)
        lone[order] = np.append(True, fresh) & np.append(fresh, True)
        of, place = of[~lone], place[~lone]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))[: len(of)]
        own, low = of[first], place[first]
        high = place[np.append(first[1:], len(of))[: len(first)] - 1] + size
        # Equal ones are one text, whose smallest document keeps it; in others it is a repeat.
        texts: dict[bytes, int] = {}
        kind = np.array([texts.setdefault(blob[a:b], len(texts)) for a, b in zip(low.tolist(), high.tolist(), strict=True)], np.int64)
        owner = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(owner, kind, ids[own])
        symbols = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + np.uint16(2)
        lengths = np.array([len(x) for x in texts], np.int64)
        marks = np.cumsum(lengths + 1) - 1
        symbols[marks] = 1
        in_text = np.repeat(np.arange(len(texts)), lengths + 1)
        valid = np.arange(len(symbols)) <= marks[in_text] - size
        order = suffix_array(symbols)
        shared = common_prefixes(symbols, order) >= size
        inside = order[valid[order]]
        group = np.flatnonzero(~shared[inside])
        least = np.full(len(symbols), np.iinfo(np.int64).max)
        least[inside] = np.repeat(np.minimum.reduceat(owner[in_text[inside]], group), np.diff(np.append(group, len(inside)))) if len(inside) else 0
        # The strings of each segment's text that a smaller document holds.
        count = high - low - size + 1
        row = np.repeat(np.arange(len(own)), count)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        hit = least[(marks - lengths)[kind[row]] + offset] < ids[own[row]]
        row, offset = row[hit], offset[hit]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)))[: len(row)]
        last = np.append(new[1:], len(row))[: len(new)] - 1
        piece, shift = own[row[new]], (low - begin[own])[row[new]]
        found = np.empty(len(new), PART)
        found["hash"], found["a"], found["b"] = hashes[piece], shift + offset[new], shift + offset[last] + size
        at = np.argsort(ids[piece], kind="stable")
        out = [(name, found[at[a:b]].tobytes()) for name, a, b in runs_of(ids[piece][at])]
        return pa.Table.from_batches([batch_of(out, [("id", pa.int64()), ("parts", pa.binary())])])

    return parts


def _removed(data: np.ndarray, size: int, hot: np.ndarray, whole: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which bytes go: those of the whole segments and of the parts listed."""
    _, hashes, first, last = segments(data, size, hot)
    at = np.flatnonzero(np.isin(hashes, whole))
    begins, ends = [first[at]], [last[at] + size]
    if len(parts):
        order = np.argsort(hashes, kind="stable")
        low, high = (np.searchsorted(hashes[order], parts["hash"], side) for side in ("left", "right"))
        times = high - low
        part = np.repeat(np.arange(len(parts)), times)
        at = first[order[np.repeat(low, times) + np.arange(len(part)) - np.repeat(np.cumsum(times) - times, times)]]
        begins.append(at + parts["a"][part])
        ends.append(at + parts["b"][part])
    change = np.bincount(np.concatenate(begins), minlength=len(data) + 1) - np.bincount(np.concatenate(ends), minlength=len(data) + 1)
    return np.cumsum(change[:-1]) > 0


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def repeated_segments(source: DataFrame, hot: np.ndarray, *, size: int, shards: int | None = None) -> DataFrame:
    """(id, whole, parts) of keyed documents that repeat something: packed hashes of segments, and
    packed PARTs."""
    if shards is None:
        shards = max(8, int((source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    sent = _send_hashes(source.where("id is not null"), size, shards, hot).repartition(shards, "shard")
    settled = materialize(sent.groupBy("shard").applyInArrow(_settle, "id long, whole binary, sends binary"), "settled")
    wanted = settled.where("sends is not null").groupBy("id").agg(F.collect_list("sends").alias("sends"))
    pieces = _send_pieces(source.join(wanted, "id"), size, shards, hot).repartition(shards, "shard")
    parts = pieces.groupBy("shard").applyInArrow(_parts_of(size), "id long, parts binary")
    every = settled.where("whole is not null").select("id", "whole", F.lit(None).cast("binary").alias("parts")).union(parts.select("id", F.lit(None).cast("binary"), "parts"))
    return every.groupBy("id").agg(F.collect_list("whole").alias("whole"), F.collect_list("parts").alias("parts"))


def remove_repeats(docs: DataFrame, *, size: int = 50, shards: int | None = None, hot: int = HOT, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept_sha256 and, unless ``with_text`` is off, the
    bytes that are kept and the removed spans (a, b), for every row."""
    if size < GRAM:
        raise ValueError(f"strings need {GRAM} bytes at least")
    source = keyed(docs, id_col, text_col)
    split = hot_anchors(source.where("id is not null"), size, hot)
    found = repeated_segments(source, split, size=size, shards=shards)
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        fields += [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]
        schema += ", kept binary, spans array<struct<a long, b long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text, whole, parts in zip(*map(batch.column, ("text", "whole", "parts")), strict=True):
                data, spans = text_bytes(text), np.empty((0, 2), np.int64)
                kept = data
                if whole.is_valid:
                    array = np.frombuffer(data, np.uint8)
                    gone = _removed(array, size, split, packed(whole.values, np.uint64), packed(parts.values, PART))
                    spans = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    kept = array[~gone].tobytes()
                row = (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept, [{"a": a, "b": b} for a, b in spans.tolist()]) if with_text else row)
            out = batch_of(rows, fields)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *out.columns], names=["id", *out.schema.names])

    # Rows without id stand outside the join, so that they don't meet on one key.
    named = source.where("id is not null").join(found, "id", "left")
    unnamed = source.where("id is null").select("id", "text", *(F.lit(None).cast("array<binary>").alias(c) for c in ("whole", "parts")))
    out = named.mapInArrow(run, schema).union(unnamed.mapInArrow(run, schema))
    return out.withColumnRenamed("id", id_col)
