"""Alignment of two tokenizers' tokens over the same bytes, and how common each link is.

Both tokenizers cut every text; two tokens are linked where their bytes overlap, and the offsets at
which both cut divide a text into groups. Neither tokenizer joins what stands before a run of white
space with that run, so a text is the sequence of its chunks (white space, then what follows), each
of which is tokenized and aligned on its own, once for as long as a worker remembers it (when its table is
full, it keeps the chunks that were used again). Texts with
other white space than space, line feed and tab are one chunk.

A batch of documents leaves its links as packed columns, one row for each stripe of A ids, and each
task also sums how many of its documents hold a pair. Those sums are dealt by stripe and added into
a dense matrix of one stripe's A ids against all B ids (``np.add.at``); the largest of a row is its
A id's best count. Then links and matrices of a stripe meet in the same partition, the matrix first
by sorting, so that one matrix and one batch of links are held at a time. A stripe that holds many
links is dealt over several partitions, each with its own copy of that stripe's matrix.

Defined results: texts that are null or empty, or that a tokenizer doesn't give back byte by byte,
have no tokens; their numbers are 0 and their digest is ''. Every row counts as a document, repeated
ids and rows without an id included, and gives one row; an empty table gives an empty one; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import materialize, sliced

#: White space (space, line feed or tab, if any) and what follows up to the next of it.
CHUNK, OTHER_SPACE = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+"), re.compile(r"[^\S \n\t]")
#: A worker forgets its chunks beyond so many of them or so many links; longer ones aren't found again.
CHUNKS_KEPT, LINKS_KEPT, CHUNK_CHARS = 300_000, 2_000_000, 48
#: Uses (half of the earlier ones) with which a chunk is kept then, if those fill half at most.
USES_KEPT = 3
#: A ids of a stripe; pairs that a task sums before it sends them; bytes of packed links of a partition.
STRIPE, PAIRS_HELD, PART_BYTES = 512, 1_000_000, 1 << 26
#: Documents, and bytes of text, of a batch.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 23
WORD = "▁"


def byte_level() -> dict[str, int]:
    """The public mapping of byte-level vocabularies: printable bytes stand for themselves, the
    others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Grown:
    """Numbers that are added at the end, in one array that doubles when it is full."""

    def __init__(self, first: np.ndarray):
        self.held, self.n = np.array(first, np.int64), len(first)

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], values, np.zeros(self.n + len(values), np.int64)])
        else:
            self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte = byte_level()
        vocabulary = self.a.get_vocab()
        tokens = {i: bytes(byte[c] for c in token) if all(c in byte for c in token) else b"" for token, i in vocabulary.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.n_a, self.n_b, self.space = max(tokens) + 1, len(pieces), self.b.piece_to_id(WORD)
        self.bytes_a = [tokens.get(i, b"") for i in range(self.n_a)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(WORD, " ").encode() for i, p in enumerate(pieces)]
        self.long_a, self.long_b = (np.array([len(t) for t in side]) for side in (self.bytes_a, self.bytes_b))
        #: How an id is written inside its side of a group, and at the end of that side.
        self.written = [b"%d%s" % (i, end) for n, ends in ((self.n_a, (b",", b"|")), (self.n_b, (b",", b";"))) for end in ends for i in range(n)]
        self.long_written = np.array([len(w) for w in self.written])
        #: Whether no piece of B joins a character with white space behind it.
        self.cuts = not any(re.search(rf"[^{WORD}\n\t][{WORD}\n\t]|{WORD}[\n\t]", p) for p in pieces)
        self.forget()

    def forget(self, least: int | None = None) -> None:
        """All chunks but those used ``least`` times."""
        kept = np.flatnonzero(self.uses.values >= least) if least else np.empty(0, np.int64)
        if len(kept):
            ends = self.ends.values
            n = ends[kept + 1] - ends[kept]
            self.links, self.ends = Grown(self.links.values[ragged(ends[kept], n)]), Grown(np.r_[0, np.cumsum(n)])
            self.sizes, self.uses = Grown(self.sizes.values.reshape(-1, 4)[kept].reshape(-1)), Grown(self.uses.values[kept] // 2)
            self.strings = [self.strings[k] for k in kept.tolist()]
            moved = np.full(int(kept[-1]) + 1, -1)
            moved[kept] = np.arange(len(kept))
            self.slots = {c: int(moved[s]) for c, s in self.slots.items() if s < len(moved) and moved[s] >= 0}
        else:
            self.slots: dict[str, int] = {}
            self.strings: list[bytes] = []
            self.links, self.ends = Grown(np.empty(0)), Grown(np.zeros(1))
            self.sizes, self.uses = Grown(np.empty(0)), Grown(np.empty(0))

    def chunks(self, text: str) -> list[str]:
        whole = " " + text
        return CHUNK.findall(whole) if self.cuts and not OTHER_SPACE.search(text) else [whole]

    def ids_b(self, chunks: list[str]) -> list[list[int]]:
        """B puts a space before what it gets: the chunk's own, or one more, which stays a token of its own."""
        found = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [[self.space] if c == " " else ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, found, strict=True)]

    def align(self, chunks: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> None:
        """Adds chunks, laid out one behind the other: all offsets at which a side cuts are ends of links,
        those at which both do are ends of groups, and a link's tokens are those that end there next."""
        data = [c.encode() for c in chunks]
        sizes = np.array([len(d) for d in data])
        well = np.ones(len(data), bool)
        for _ in range(2):
            counts_a, counts_b = (np.array([len(x) for x in side]) for side in (ids_a, ids_b))
            a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (ids_a, ids_b))
            # Mostly all is well at once; else the second round goes without what isn't.
            whole = [b"".join(map(table.__getitem__, ids.tolist())) for table, ids in ((self.bytes_a, a), (self.bytes_b, b))]
            long = [np.diff(np.r_[0, np.cumsum(of[ids])][np.r_[0, np.cumsum(n)]]) for of, ids, n in ((self.long_a, a, counts_a), (self.long_b, b, counts_b))]
            if whole[0] == whole[1] == b"".join(data) and (long[0] == sizes).all() and (long[1] == sizes).all():
                break
            given = [[b"".join(map(table.__getitem__, x)) for x in side] for table, side in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))]
            well = np.array([d == x == y for d, x, y in zip(data, *given, strict=True)])
            data = [d if ok else b"" for d, ok in zip(data, well, strict=True)]
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(side, well, strict=True)] for side in (ids_a, ids_b))
            sizes = sizes * well
        ends_a, ends_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        stops = np.cumsum(sizes)
        links, groups = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        codes = a[np.searchsorted(ends_a, links)] * self.n_b + b[np.searchsorted(ends_b, links)]
        last_link, last_group = np.searchsorted(links, stops, "right"), np.searchsorted(groups, stops, "right")
        # Each group's A ids, then its B ids.
        group_a, group_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        places = np.r_[a + self.n_a * (groups[group_a] == ends_a), 2 * self.n_a + b + self.n_b * (groups[group_b] == ends_b)][order]
        whole = b"".join(map(self.written.__getitem__, places.tolist()))
        cuts = np.r_[0, np.cumsum(self.long_written[places])][np.r_[0, np.cumsum(counts_a + counts_b)]].tolist()
        self.strings += [whole[i : max(i, j - 1)] for i, j in zip(cuts, cuts[1:], strict=False)]
        self.sizes.add(np.column_stack([counts_a, counts_b, np.diff(last_group, prepend=0), well]).reshape(-1))
        self.ends.add(last_link + self.links.n)
        self.links.add(codes)
        self.uses.add(np.zeros(len(chunks), np.int64))

    def placed(self, texts: list[str]) -> list[list[int]]:
        """The slots of each text's chunks; all slots stay as they are until the next call."""
        full = lambda part: len(self.strings) > CHUNKS_KEPT * part or self.links.n > LINKS_KEPT * part
        if full(1):
            self.forget(USES_KEPT)
            if full(0.5):
                self.forget()
        cut = [self.chunks(t) if t else [] for t in texts]
        new = list(dict.fromkeys(c for chunks in cut for c in chunks if c not in self.slots))
        for start in range(0, len(new), 4096):
            part = new[start : start + 4096]
            found = self.a.encode_batch_fast(part, add_special_tokens=False)
            self.slots.update(zip(part, range(len(self.strings), len(self.strings) + len(part)), strict=True))
            self.align(part, [f.ids for f in found], self.ids_b(part))
        out = [list(map(self.slots.__getitem__, chunks)) for chunks in cut]
        for chunk in new:
            if len(chunk) > CHUNK_CHARS:
                del self.slots[chunk]
        return out


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k] .. starts[k] + sizes[k] - 1, one run behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights[order], first)


def pack(*columns: np.ndarray) -> bytes:
    body = b"".join(c.tobytes() for c in columns)
    head = np.array([len(columns), *(len(c) for c in columns), *(c.dtype.itemsize for c in columns)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes, widths = np.frombuffer(data, "<i8", 2 * n, 8).reshape(2, n)
    out, at = [], 8 + 16 * n
    for size, width in zip(sizes.tolist(), widths.tolist(), strict=True):
        out.append(np.frombuffer(data, f"<u{width}", size, at))
        at += size * width
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers (none negative) in the fewest bytes."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


KINDS = DOC, PAIRS, LINKS = 0, 1, 2
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of the batch of at most about BATCH_BYTES of text."""
    start = size = 0
    for k, text in enumerate(batch.column("text")):
        size += text.as_buffer().size if text.is_valid else 0
        if size >= BATCH_BYTES:
            yield batch.slice(start, k + 1 - start)
            start, size = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def scanned(docs: DataFrame, path_a: str, path_b: str, *, id_col: str, text_col: str) -> DataFrame:
    """Rows of three kinds: documents with their numbers, pairs (a stripe's pairs, with how many of a
    task's documents hold each) and links (a stripe's links of a batch of documents)."""
    kind_of_id = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "row", "id", *NUMBERS, "groups_sha256", "stripe", "n_entries", "blob"]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held, id_type = 0, None

        def out(kind: int, n: int, **columns) -> pa.RecordBatch:
            kinds = {"kind": pa.int32(), "row": pa.int64(), "id": id_type, **dict.fromkeys(NUMBERS, pa.int64()), "groups_sha256": pa.string(), "stripe": pa.int64(), "n_entries": pa.int64(), "blob": pa.binary()}
            columns["kind"] = pa.array([kind] * n, pa.int32())
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kinds[c])) for c in names], names=names)

        def striped(kind: int, codes: np.ndarray, own: Aligner, *others: np.ndarray, head: tuple = ()) -> pa.RecordBatch:
            """``codes`` and the columns beside them, cut at stripes; a row for each."""
            span = STRIPE * own.n_b
            of = codes // span
            order = np.argsort(of.astype(np.uint16), kind="stable")
            of, codes, others = of[order], codes[order], [o[order] for o in others]
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
            ends = np.append(cuts[1:], len(of))
            blobs = [pack(*head, narrow(codes[i:j] - of[i] * span), *(narrow(o[i:j]) for o in others)) for i, j in zip(cuts, ends, strict=True)]
            return out(kind, len(cuts), stripe=pa.array(of[cuts], pa.int64()), n_entries=pa.array(ends - cuts, pa.int64()), blob=pa.array(blobs, pa.binary()))

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, n = zip(*held, strict=True)
            return counted(np.concatenate(codes), np.concatenate(n))

        own = None
        for whole in sliced(batches, BATCH_ROWS):
            for batch in _batches(whole):
                own, id_type = aligner(path_a, path_b), batch.schema.field("id").type
                slots = own.placed(batch.column("text").to_pylist())
                sizes, ends = own.sizes.values.reshape(-1, 4), own.ends.values
                flat = np.array([s for of_doc in slots for s in of_doc], np.int64)
                doc = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
                bad = np.zeros(len(slots), bool)
                bad[doc[sizes[flat, 3] == 0]] = True
                flat, doc = flat[~bad[doc]], doc[~bad[doc]]
                totals = np.zeros((len(slots), 3), np.int64)
                np.add.at(totals, doc, sizes[flat, :3])
                digest = ["" if bad[k] or not s else hashlib.sha256(b";".join(map(own.strings.__getitem__, s))).hexdigest() for k, s in enumerate(slots)]
                n_links = totals[:, 0] + totals[:, 1] - totals[:, 2]
                rows = batch.column("row")
                yield out(DOC, batch.num_rows, row=rows, id=batch.column("id"), groups_sha256=pa.array(digest, pa.string()), **{c: pa.array(v) for c, v in zip(NUMBERS, (*totals.T, n_links), strict=True)})

                own.uses.values[:] += np.bincount(flat, minlength=own.uses.n)
                once, times = np.unique(doc * len(own.strings) + flat, return_counts=True)
                doc, slot = once // max(1, len(own.strings)), once % max(1, len(own.strings))
                n = ends[slot + 1] - ends[slot]
                codes = own.links.values[ragged(ends[slot], n)]
                most = own.n_a * own.n_b
                keys, times = counted(np.repeat(doc, n) * most + codes, np.repeat(times, n))
                doc, codes = keys // most, keys % most
                numbers = np.asarray(rows, np.int64)
                if len(codes):
                    # Documents of a batch mostly have consecutive numbers.
                    yield striped(LINKS, codes, own, doc, times, head=(numbers[:1].astype("<u8"), narrow(numbers - numbers[0])))
                    codes, n = np.unique(codes, return_counts=True)
                    held.append((codes, n))
                    n_held += len(codes)
                if n_held > PAIRS_HELD:
                    held = [merged()]
                    n_held = len(held[0][0])
                    if n_held > PAIRS_HELD // 2:
                        yield striped(PAIRS, held[0][0], own, held[0][1])
                        held, n_held = [], 0
        if held:
            codes, n = merged()
            yield striped(PAIRS, codes, own, n)

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    numbers = ", ".join(f"{c} long" for c in NUMBERS)
    return texts.mapInArrow(run, f"kind int, row long, id {kind_of_id}, {numbers}, groups_sha256 string, stripe long, n_entries long, blob binary")


def _fold(n_b: int, key: list[str]):
    """Sums the pairs of each run of equal keys in a dense matrix; marks the largest of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, np.zeros(STRIPE * n_b, np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            places = np.flatnonzero(table)
            best = table.reshape(STRIPE, n_b).max(axis=1)[places // n_b] == table[places]
            for start in range(0, len(places), 1 << 18):
                part = places[start : start + (1 << 18)]
                blob = pack(narrow(part), narrow(table[part]), best[start : start + (1 << 18)].astype("<u1"))
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([blob], pa.binary())], names=["stripe", "n_entries", "blob"])
            table[places] = 0

        for batch in batches:
            for *of, blob in zip(*(batch.column(c).to_pylist() for c in (*key, "blob")), strict=True):
                if now is not None and of != now:
                    yield from done()
                now = of
                places, n = unpack(blob)[:2]
                np.add.at(table, places.astype(np.int64), n.astype(np.int64))
        if now is not None:
            yield from done()

    return run


def counts(found: DataFrame, n_b: int) -> DataFrame:
    """stripe, n_entries, blob (places in the stripe's matrix, counts, whether they are their row's
    largest) of all pairs. A stripe's sums are added in two steps, first in about the square root of
    their number of parts, so neither step waits for one task that reads them all."""
    schema = "stripe long, n_entries long, blob binary"
    sums = found.where(F.col("kind") == PAIRS).select("stripe", "blob")
    parts = sums.groupBy("stripe").agg(F.ceil(F.sqrt(F.count("*"))).alias("parts"))  # no more rows than the vocabulary has stripes
    dealt = sums.join(F.broadcast(parts), "stripe").select("stripe", F.pmod(F.xxhash64("blob"), F.col("parts")).alias("part"), "blob")
    first = dealt.repartition("stripe", "part").sortWithinPartitions("stripe", "part").mapInArrow(_fold(n_b, ["stripe", "part"]), schema)
    return first.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_fold(n_b, ["stripe"]), schema)


def _score(n_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, best, filled = None, np.zeros(STRIPE * n_b, np.int64), np.zeros(STRIPE * n_b, bool), []
        for batch in batches:
            out = []
            for stripe, part, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("stripe", "part", "kind", "blob")), strict=True):
                if (stripe, part) != now:
                    for places in filled:
                        table[places], best[places] = 0, False
                    now, filled = (stripe, part), []
                if kind == PAIRS:
                    places, n, top = unpack(blob)
                    filled.append(places.astype(np.int64))
                    table[filled[-1]], best[filled[-1]] = n, top.astype(bool)
                else:
                    first, rows, places, doc, times = unpack(blob)
                    places, doc, times = places.astype(np.int64), doc.astype(np.int64), times.astype(np.int64)
                    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    out.append((rows[doc[starts]].astype(np.int64) + int(first[0]), np.add.reduceat(times * best[places], starts), np.add.reduceat(times * table[places], starts)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["row", "n_best", "count_sum"])

    return run


def scores(found: DataFrame, matrix: DataFrame, n_b: int) -> DataFrame:
    """row, n_best, count_sum of every document with tokens."""
    links = found.where(F.col("kind") == LINKS).select("stripe", "kind", "blob")
    # No more rows than the vocabulary has stripes.
    parts = links.groupBy("stripe").agg(F.ceil(F.sum(F.length("blob")) / PART_BYTES).cast("long").alias("parts"))
    dealt = links.join(F.broadcast(parts), "stripe").select("stripe", F.pmod(F.xxhash64("blob"), F.col("parts")).alias("part"), "kind", "blob")
    copies = matrix.join(F.broadcast(parts), "stripe").select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(PAIRS).alias("kind"), "blob")
    met = copies.unionByName(dealt).repartition("stripe", "part").sortWithinPartitions("stripe", "part", "kind")
    return met.mapInArrow(_score(n_b), "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    n_b = aligner(path_a, path_b).n_b
    found = materialize(scanned(docs, path_a, path_b, id_col=id_col, text_col=text_col), "alignment")
    matrix = materialize(counts(found, n_b), "pair_counts")
    told = found.where(F.col("kind") == DOC).join(scores(found, matrix, n_b), "row", "left")
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return told.select(F.col("id").alias(id_col), *NUMBERS, *sums, "groups_sha256")


def pair_table(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a_id, b_id, n_docs (documents that hold them linked) and best (whether no B id has more with
    that A id)."""
    n_b = aligner(path_a, path_b).n_b
    found = materialize(scanned(docs, path_a, path_b, id_col=id_col, text_col=text_col), "alignment")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, blob in zip(batch.column("stripe").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                places, n, best = unpack(blob)
                places = places.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(places // n_b + stripe * STRIPE), pa.array(places % n_b), pa.array(n.astype(np.int64)), pa.array(best.astype(bool))], names=["a_id", "b_id", "n_docs", "best"])

    return counts(found, n_b).mapInArrow(rows, "a_id long, b_id long, n_docs long, best boolean")
