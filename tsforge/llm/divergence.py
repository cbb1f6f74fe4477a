"""How sources of a language differ from each other and from the language, term by term.

Terms are counted inside tasks, whose tables of counts are emptied when they are full, and summed by
(language, source, term). What is kept of a language's terms is cut into stripes, and its sources
are dealt over seats. One block holds the sources of one seat in one stripe, as sparse counts in a
compressed Arrow message. Blocks stay in the partition where they lie; in each round of a
round-robin tournament (the circle method) a copy of every block travels to the partition of the
seat that it meets. A meeting is evaluated once, for both directions, and gives each pair of
sources its partial sum over the stripe; sums over stripes and rounds complete them. The first
pass over a block keeps a heap of each source's most telling terms, so no more than ``top`` rows a
source and stripe are left to be ranked.

All numbers are integers: a term's share is 1 + floor(10 ** 9 * (count + 5) / (N + 5 * V)), with N
the counts of kept terms and V their number, and a difference is the distance between two shares.

Defined results: null text, language and source are empty strings; an empty text has no terms, yet
its source counts as a group. A language without kept terms gives its pairs with value 0 and no
terms; a language with one source gives no pairs; an empty table gives an empty one. Every row is
a document, repeated ids included; other columns aren't read. Ties go to the smaller item by the
bytes of its UTF-8.
"""

from __future__ import annotations

import heapq
import io
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsforge.llm.common import materialize, sliced

#: Letters A-Z and all characters beyond ASCII, in lower-cased UTF-8.
TERM, END = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
#: Bytes of a text that are split at once; terms, bytes and rows of texts after which a task's counts are sent.
WINDOW, HELD_TERMS, HELD_BYTES, HELD_ROWS = 1 << 20, 600_000, 1 << 28, 1 << 20
#: A term's number of documents and its occurrences are held as one number.
ONE_DOC = 1 << 40
#: Added to each count; the unit of shares.
PRIOR, UNIT_STEPS = 5, 3
#: Terms of a stripe and sources of a seat.
STRIPE, SEAT = 32768, 16


def windows(data: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes that end where no term is cut."""
    start = 0
    while start < len(data):
        cut = END.search(data, min(start + size, len(data)))
        stop = cut.start() if cut else len(data)
        yield data[start:stop]
        start = stop


def term_counts(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it). The empty term stands for
    the group itself, whose documents it counts."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]

    def emptied(held: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            both = np.fromiter(terms.values(), np.int64, len(terms))
            columns = [pa.repeat(pa.scalar(c, pa.string()), len(terms)) for c in (lang, source)]
            columns += [pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(both % ONE_DOC), pa.array(both // ONE_DOC)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = defaultdict(dict)
        terms_held = bytes_held = rows = 0
        for batch in sliced(batches):
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                of_group, seen = held[lang.as_py(), source.as_py()], Counter()
                before, data = len(of_group), text.as_py().encode().lower()
                for piece in windows(data):
                    seen.update(TERM.findall(piece))
                for term, n in seen.items():
                    of_group[term] = of_group.get(term, 0) + n + ONE_DOC
                of_group[b""] = of_group.get(b"", 0) + ONE_DOC
                terms_held += len(of_group) - before
                bytes_held += len(data)
                rows += 1
                # Below these bounds no term's two numbers run into each other.
                if terms_held > HELD_TERMS or bytes_held > HELD_BYTES or rows > HELD_ROWS:
                    yield from emptied(held)
                    held.clear()
                    terms_held = bytes_held = rows = 0
        yield from emptied(held)

    partial = docs.select(*plain).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10 ** 9 * counts / total), by long division in three steps of three digits, which is
    exact for totals below 9 * 10 ** 15."""
    out, rest = np.zeros_like(counts), counts
    for _ in range(UNIT_STEPS):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


BLOCK = pa.schema([("source", pa.string()), ("total", pa.int64()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def packed(rows: list[tuple]) -> bytes:
    out = io.BytesIO()
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), BLOCK.types, strict=True)]
    with pa.ipc.new_stream(out, BLOCK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(pa.table(columns, schema=BLOCK))
    return out.getvalue()


def unpacked(blob: bytes, width: int) -> tuple[list[str], np.ndarray]:
    """The block's sources and their shares of the stripe's ``width`` terms, a row for each source."""
    block = pa.ipc.open_stream(blob).read_all()
    table = np.empty((block.num_rows, width), np.int64)
    for row, total, places, counts in zip(table, block["total"], block["places"], block["counts"], strict=True):
        if width:
            full = np.zeros(width, np.int64)
            full[places.values.to_numpy()] = counts.values.to_numpy()
            row[:] = shares(full + PRIOR, total.as_py())
    return block["source"].to_pylist(), table


def distances(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sums of absolute differences between each row of ``one`` and each of ``other``."""
    return np.array([np.abs(other - row).sum(axis=1) for row in one], np.int64).reshape(len(one), len(other))


def _pack(top: int):
    """One block: its packed counts, and each source's ``top`` terms by heap."""

    def run(rows: pa.Table) -> pa.Table:
        lang, stripe, seat = (rows.column(c)[0].as_py() for c in ("lang", "stripe", "seat"))
        width, v, n_lang = (pc.max(rows.column(c)).as_py() for c in ("width", "n_terms", "lang_total"))  # in the groups' own rows; else 0
        rows = rows.sort_by([("source", "ascending"), ("place", "ascending")])
        sources = rows.column("source").to_pylist()
        place, n, of_lang = (rows.column(c).to_numpy() for c in ("place", "n", "lang_n"))
        starts = [k for k, s in enumerate(sources) if not k or s != sources[k - 1]] + [len(sources)]
        block, best = [], []
        for low, high in zip(starts, starts[1:], strict=False):
            source, own = sources[low], int(n[low])  # place -1: the group itself, with its total
            here = slice(low + 1, high)
            block.append((source, own + PRIOR * v, place[here], n[here]))
            if high > low + 1:
                gain = shares(n[here] + PRIOR, own + PRIOR * v) - shares(of_lang[here] + PRIOR, n_lang + PRIOR * v)
                terms = rows.column("term").slice(low + 1, high - low - 1)
                over = np.flatnonzero(gain > 0)
                ranked = heapq.nsmallest(top, ((-g, t.encode()) for g, t in zip(gain[over].tolist(), terms.take(pa.array(over)).to_pylist(), strict=True)))
                best += [(source, term.decode(), -minus) for minus, term in ranked]
        n_best = len(best)
        source, term, value = zip(*best, strict=True) if best else ((), (), ())
        blank = [None] * n_best
        return pa.table({
            "lang": pa.array([lang] * (n_best + 1), pa.string()), "source": pa.array([None, *source], pa.string()), "term": pa.array([None, *term], pa.string()), "value": pa.array([None, *value], pa.int64()),
            "stripe": pa.array([stripe, *blank], pa.int64()), "seat": pa.array([seat, *blank], pa.int64()), "width": pa.array([width, *blank], pa.int64()), "blob": pa.array([packed(block), *blank], pa.binary()),
        })

    return run


PAIRS = "lang string, source string, item string, value long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial distances of the pairs of a meeting (a row: home and away); a block meets itself where ``away`` is null."""
    for batch in batches:
        for lang, width, home, away in zip(*(batch.column(c).to_pylist() for c in ("lang", "width", "home", "away")), strict=True):
            names, own = unpacked(home, width)
            others, theirs = unpacked(away, width) if away is not None else (names, own)
            sums = distances(own, theirs)
            keep = np.triu(np.ones_like(sums, bool), 1) if away is None else np.ones_like(sums, bool)
            one, two = np.nonzero(keep)
            arrays = [pa.array([lang] * len(one), pa.string()), pa.array([names[i] for i in one], pa.string()), pa.array([others[j] for j in two], pa.string()), pa.array(sums[keep])]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "item", "value"])


def partner(seat: Column, seats: Column, turn: int) -> Column:
    """Whom a seat meets in a round: of an odd number of seats m those whose numbers add up to
    2 * turn (mod m); the last of an even number meets the one that would meet itself. Numbers that
    don't occur stand for a free round; every two seats meet in exactly one of the first rounds."""
    odd = seats - F.when(seats % 2 == 0, 1).otherwise(0)
    met = F.pmod(2 * F.lit(turn) - seat, odd)
    return F.when(seat == odd, turn).when(met == seat, odd).otherwise(met)


def pair_distances(blocks: DataFrame) -> DataFrame:
    """lang, source, item, value of both directions of every pair; ``blocks`` has lang, stripe, seat,
    seats, width and blob."""
    key = ["lang", "stripe", "seat"]
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    resident = blocks.select(*key, "seats", "width", F.col("blob").alias("home")).repartition(tasks, *key).persist(StorageLevel.DISK_ONLY)
    sums = materialize(resident.select("lang", "width", "home", F.lit(None).cast("binary").alias("away")).mapInArrow(_meet, PAIRS), "meetings")
    turns = resident.agg(F.max(F.col("seats") - F.when(F.col("seats") % 2 == 0, 1).otherwise(0))).first()[0] or 0
    for turn in range(turns if turns > 1 or not resident.where("seats > 1").isEmpty() else 0):
        going = resident.where((F.col("seats") > 1) & (turn < F.col("seats") - F.when(F.col("seats") % 2 == 0, 1).otherwise(0)))
        peers = going.select("lang", "stripe", partner(F.col("seat"), F.col("seats"), turn).alias("seat"), F.col("seat").alias("from"), F.col("home").alias("away"))
        met = resident.join(peers, key).where(F.col("seat") < F.col("from")).select("lang", "width", "home", "away")
        sums = sums.union(materialize(met.mapInArrow(_meet, PAIRS), "meetings"))
    resident.unpersist()
    ordered = sums.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), "value")
    whole = ordered.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return whole.select("lang", "value", both.alias("way")).select("lang", "way.source", "way.item", "value")


def divergence(docs: DataFrame, *, least_docs: int = 30, top: int = 50, stripe: int = STRIPE, seat: int = SEAT,
               lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank. ``least_docs``: documents of its language
    that a kept term needs; ``top``: ranks of part term; ``stripe`` and ``seat``: sizes of blocks."""
    counts = materialize(term_counts(docs, lang_col=lang_col, source_col=source_col, text_col=text_col), "counts")
    in_lang = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = materialize(in_lang.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "kept")
    sources = counts.where("term = ''").groupBy("lang").agg(F.count("*").alias("sources"))
    sizes = sources.join(kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    sizes = materialize(sizes.select(
        "lang", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_terms", "lang_total")),
        F.greatest(F.lit(1), F.ceil(F.coalesce("n_terms", F.lit(0)) / stripe)).cast("long").alias("stripes"), F.ceil(F.col("sources") / seat).cast("long").alias("seats"),
    ), "sizes")
    in_stripe = Window.partitionBy("lang", "stripe")
    placed = kept.join(sizes.select("lang", "stripes"), "lang").withColumn("stripe", F.pmod(F.xxhash64("term"), F.col("stripes")))
    placed = placed.select("lang", "term", "lang_n", "stripe", (F.row_number().over(in_stripe.orderBy("term")) - 1).alias("place"))
    cells = materialize(counts.where("term <> ''").select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "cells")

    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(sizes, "lang")
    groups = materialize(groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "n_terms", "lang_total", "stripes", F.pmod(F.xxhash64("source"), F.col("seats")).alias("seat"),
    ), "groups")
    widths = placed.groupBy("lang", "stripe").agg(F.count("*").alias("width"))
    head = groups.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1))).join(widths, ["lang", "stripe"], "left")
    whole = ["lang", "stripe", "seat", "source", "n_terms", "lang_total"]
    head = head.select(*whole, F.coalesce("width", F.lit(0)).alias("width"), F.lit(-1).alias("place"), F.col("total").alias("n"), F.lit(0).cast("long").alias("lang_n"), F.lit("").alias("term"))
    body = cells.join(groups.select("lang", "source", "seat"), ["lang", "source"])
    body = body.select("lang", "stripe", "seat", "source", *(F.lit(0).cast("long").alias(c) for c in ("n_terms", "lang_total", "width")), F.col("place").cast("int").alias("place"), "n", "lang_n", "term")
    rows = head.unionByName(body)
    kinds = "lang string, source string, term string, value long, stripe long, seat long, width long, blob binary"
    packs = materialize(rows.groupBy("lang", "stripe", "seat").applyInArrow(_pack(top), kinds), "blocks")

    blocks = packs.where("blob is not null").join(sizes.select("lang", "seats"), "lang").select("lang", "stripe", "seat", "seats", "width", "blob")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_distances(blocks).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    terms = packs.where("blob is null").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
