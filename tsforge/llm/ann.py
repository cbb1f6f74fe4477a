"""Approximate nearest neighbours by shifted space-filling curves.

Each of ``curves`` curves projects the vectors by its own random rotation onto a few axes, shifts
them, and orders them by their Hilbert keys. A curve is cut into ranges of equally many keys; a
query looks at the range of its own key and those on either side: a window of ``share`` of the
rows, ``window_rows`` at least. A range and its queries meet in one task, which ranks by matrix
products; ranges of more than ``rows_together`` vectors are dealt over several tasks, and so are
queries. The best of all windows are merged and ranked again by their exact inner products. Where
lengths differ, vectors get one more component that makes them equal, so that the largest inner
product becomes the nearest direction.

Many short windows find more than few long ones. In directions without structure (the test vectors
spread evenly over 64 dimensions) the defaults look at about as many vectors as an exact search
would (0.96 tables for each query, some vectors several times) for a recall over 0.9, and the work
grows with queries times rows; vectors in clusters need a far smaller ``share``. A table of up to
``window_rows`` vectors is searched whole.

Equal vectors are one entry with their ``k + 1`` smallest ids (more can't be in a result), so a
vector that a third of the rows share costs no more than others, and queries that share a vector
are searched once.

Defined results: vectors that are null, zero, not of the commonest length, or hold null or
non-finite components take no part, as queries or candidates; neither do rows without id;
repeated rows of one id and vector count once; ties go to the smaller id, also where a window has
more of them than places; an empty table gives no rows; with fewer candidates than k, all are
returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsforge.llm.common import materialize, sliced
from tsforge.llm.minhash import mixed

AXES, BITS = 7, 9


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of non-negative integer cells (rows, axes).

    From the highest bit down, an axis whose bit is set flips the lower bits of the first axis,
    and one whose bit is clear swaps them with it; a Gray code over all axes then gives the
    order, and the bits interleave to one number."""
    x = cells.T.astype(np.int64).copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        bit, lower = 1 << level, (1 << level) - 1
        for axis in range(axes):
            is_set = (x[axis] & bit) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[axis]) & lower)
            x[0] ^= np.where(is_set, lower, swap)
            x[axis] ^= swap
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= carry
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = key << 1 | (x[axis] >> level & 1)
    return key


class Curves:
    def __init__(self, dims: int, count: int, longest: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.longest = longest
        axes = min(AXES, dims + 1)
        self.turns = [np.linalg.qr(rng.standard_normal((dims + 1, dims + 1)))[0][:, :axes] for _ in range(count)]
        self.shifts = [rng.uniform(0, 0.5, axes) for _ in range(count)]
        #: Coordinates of a unit vector in so many dimensions are about this large.
        self.reach = 3.0 / np.sqrt(dims + 1)

    def keys(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """(curves, rows) keys. A query is scaled to unit length; others to the longest one's."""
        norms = np.linalg.norm(vectors, axis=1)
        scale = norms if query else self.longest
        unit = vectors / np.maximum(scale, 1e-300)[:, None] if query else vectors / scale
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1)))
        full = np.column_stack([unit, rest])
        out = []
        for turn, shift in zip(self.turns, self.shifts, strict=True):
            place = (full @ turn / self.reach + 1) / 3 + shift / 3
            out.append(hilbert_keys(np.clip(place * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS))
        return np.array(out)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0.0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(table: DataFrame, is_query: Column, *, k: int = 20, curves: int = 16, share: float = 0.06, window_rows: int = 1024,
            rows_together: int = 32768, queries_together: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found for each row of
    ``table`` for which ``is_query`` holds."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = table.sparkSession
    single = table.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull()).where(usable(F.col("v")))
    dims = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dims = dims["dims"]
    rows = rows.where(F.size("v") == dims)
    # One entry for each distinct vector: its smallest id names it.
    order = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    unique = rows.groupBy("v", "id").agg(F.max("asks").alias("asks"))
    few = unique.select("v", "id").withColumn("nth", order).where(F.col("nth") <= k + 1)
    ids_of = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = materialize(ids_of.select(F.col("ids")[0].alias("entry"), "ids", "v"), "entries")
    asking = materialize(unique.where("asks").select("v", F.col("id").alias("query_id")).join(entries.select("v", "entry"), "v").select("query_id", "entry"), "asking")
    asked = materialize(entries.join(asking.select("entry").distinct(), "entry", "left_semi").select("entry", "v"), "asked")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    size, longest = entries.agg(F.count("*"), F.max(norm)).first()
    n_asked = asked.count()
    lines = Curves(dims, curves, longest)

    # A window is three ranges, so a curve has few of them, however many rows there are.
    blocks = max(1, round(3 * size / max(window_rows, share * size)))
    width = min(blocks, 3)

    def keys_of(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
        for batch in sliced(batches, 4096):
            if batch.num_rows:
                for curve, found in enumerate(lines.keys(matrix(batch.column("v")), query)):
                    yield batch, curve, found

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, curve, found in keys_of(batches, False):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), curve, np.int32)), pa.array(found)], names=["curve", "key"])

    bounds = [np.empty(0, np.int64)] * curves
    if blocks > 1:
        cuts = F.percentile_approx("key", [i / blocks for i in range(1, blocks)], 20000)
        for r in entries.select("v").mapInArrow(keys, "curve int, key long").groupBy("curve").agg(cuts.alias("cuts")).collect():
            bounds[r["curve"]] = np.array(r["cuts"], np.int64)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, curve, found in keys_of(batches, False):
            block, count = np.unique(np.searchsorted(bounds[curve], found, "left"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), curve, np.int32)), pa.array(block.astype(np.int32)), pa.array(count)], names=["curve", "block", "n"])

    # Where one key has very many vectors its range is larger than planned.
    sizes = entries.select("v").mapInArrow(held, "curve int, block int, n long").groupBy("curve", "block").agg(F.sum("n").alias("n")).collect()
    parts = np.ones((curves, blocks), np.int64)
    for r in sizes:
        parts[r["curve"], r["block"]] = -(-r["n"] // rows_together)
    shares = max(1, -(-n_asked // queries_together))

    def placed(source: DataFrame, query: bool) -> DataFrame:
        """(curve, block, part, hand, entry, v): a vector goes to a part of its range, for each
        share of the queries; a query, to all parts of the ranges around its key."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, curve, found in keys_of(batches, query):
                block = np.searchsorted(bounds[curve], found, "left")
                mix = mixed(batch.column("entry").to_numpy().view(np.uint64))
                row = np.arange(len(found))
                if query:
                    block = (np.clip(block - width // 2, 0, blocks - width)[:, None] + np.arange(width)).ravel()
                    row = np.repeat(row, width)
                    times = parts[curve, block]
                    row, block, part = np.repeat(row, times), np.repeat(block, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    hand = mix[row] % np.uint64(shares)
                else:
                    part = mix % parts[curve, block].astype(np.uint64)
                    row, block, part, hand = np.repeat(row, shares), np.repeat(block, shares), np.repeat(part, shares), np.tile(np.arange(shares), len(row))
                at = pa.array(row)
                numbers = [pa.array(x.astype(np.int32)) for x in (np.full(len(row), curve), block, part, hand)]
                yield pa.RecordBatch.from_arrays([*numbers, batch.column("entry").take(at), batch.column("v").take(at)], names=[*by, "entry", "v"])

        return source.select("entry", "v").mapInArrow(run, f"curve int, block int, part int, hand int, entry long, v {kind}")

    by = ("curve", "block", "part", "hand")

    def rank(asked: pa.Table, block: pa.Table) -> pa.Table:
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if asked.num_rows and block.num_rows:
            names, v = block.column("entry").to_numpy(), matrix(block.column("v").combine_chunks())
            queries, q = asked.column("entry").to_numpy(), matrix(asked.column("v").combine_chunks())
            most = min(k + 1, len(v))
            # Products of matrices round differently from sums of one row: what comes so near to the last place stays.
            margin = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
            for part in range(0, len(q), 128):
                near = q[part : part + 128] @ v.T
                last = np.partition(near, len(v) - most, axis=1)[:, len(v) - most]
                row, at = np.nonzero(near >= (last - margin[part : part + 128])[:, None])
                exact = (v[at] * q[part + row]).sum(axis=1)
                order = np.lexsort((names[at], -exact, row))
                row, at, exact = row[order], at[order], exact[order]
                starts = np.searchsorted(row, row)
                kept = np.arange(len(row)) - starts < most
                parts.append((queries[part + row[kept]], names[at[kept]], exact[kept]))
        query, entry, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({"query": query, "entry": entry, "score": score})

    ranked = placed(asked, True).groupBy(*by).cogroup(placed(entries, False).groupBy(*by)).applyInArrow(rank, "query long, entry long, score double")
    merged = ranked.groupBy("query", "entry").agg(F.max("score").alias("score"))
    nearest_first = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    best = merged.withColumn("nth", F.row_number().over(nearest_first)).where(F.col("nth") <= k + 1)
    named = best.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    lists = named.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id"))).alias("all"))
    lists = materialize(lists.select(F.col("query").alias("entry"), F.slice("all", 1, k + 1).alias("near")), "near")
    own = asking.join(lists, "entry")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.away")).alias("score"))
