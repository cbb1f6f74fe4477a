"""MinHash near-duplicates by tensored banding.

Two collections A and B of ``collections`` entries each hold ``rows`` minhashes an entry. A table
(i, j) has the pair (A_i, B_j) as its key, so 2 * collections * rows minhashes serve
collections ** 2 tables of 2 * rows minhashes. Two sets of Jaccard similarity s share a table
with probability (1 - (1 - s ** rows) ** collections) ** 2. Unless ``collections`` is given, it is
the least number with which a link at exactly the threshold goes unseen once in 15,000 at the most:
14 at 0.85 (one at 0.9 then goes unseen once in 10 ** 8) and 20 at 0.80.

Before keys are formed, entries that no other set has are struck out, so texts without a
relative emit next to nothing. Equal sets are one class from the start. Within a table's bucket
each set is compared with one pivot (the member with most company), never with all others; the
components of what is confirmed are formed; and only buckets that still hold several components
go on. For these, sets drop out that provably link with nothing left: a shingle that no other
open set holds can't be shared, and a set with too many such shingles can't reach the threshold.
Fresh pivots follow, and when the pairs left are no more than blocks bear, or pivots bring no more,
the sets left are compared block by block inside tasks that give out links alone. So no bucket is
capped and nothing is left out. Links are confirmed on whole sets of 64-bit shingle hashes.

Defined results: null, empty and blank texts have an empty set, which links with nothing; a text
of fewer words than a shingle is one shingle; rows of one id are one document, whose text is the
one of the smallest 64-bit hash (null last) where they differ; rows without an id take no part and
aren't returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import materialize, sliced
from tsforge.llm.components import components

#: Odd factors of the mixing steps; fixed values of a public 64-bit finalizer.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


#: Sets in a block, when those left open are compared with each other.
BLOCK = 256

#: Columns of such a comparison that are held at once.
STRIPE = 4096

#: How often a link at exactly the threshold may share no table.
MISS = 1 / 15000


def collections_for(percent: int, rows: int) -> int:
    """The least number of collections that keeps MISS at a similarity of ``percent`` hundredths."""
    alone = 1 - (percent / 100) ** rows
    return max(1, math.ceil(math.log(1 - math.sqrt(1 - MISS)) / math.log(alone))) if alone > 0 else 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; A-Z are lower-cased and
    words end at space, tab, line feed, vertical tab, form feed and carriage return only."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = max(1, len(words) - width + 1)
    width = min(width, len(words))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mixed(out + codes[k : k + n])
    return np.unique(out)


def minhashes(values: np.ndarray, count: int) -> np.ndarray:
    factors = np.random.default_rng(20240501).integers(1, 2**63, count, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(count, ~np.uint64(0))
    for part in range(0, len(values), 4096):
        low = np.minimum(low, (factors[:, None] * values[None, part : part + 4096]).min(axis=1))
    return low


def signatures(docs: DataFrame, *, width: int, rows: int, collections: int, id_col: str, text_col: str) -> DataFrame:
    """id, key (of the text), n (size of the set), sig (digest of the set), entries (A's, then B's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, sigs, entries = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), width)
                sizes.append(len(found))
                if not len(found):
                    sigs.append(None)
                    entries.append(None)
                    continue
                sigs.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                hashes = minhashes(found, 2 * collections * rows).reshape(2 * collections, rows)
                code = np.zeros(2 * collections, np.uint64)
                for k in range(rows):
                    code = mixed(code + hashes[:, k])
                entries.append(code.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(entries, pa.list_(pa.int64()))],
                names=["id", "key", "n", "sig", "entries"],
            )

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text).alias("key"), text.alias("text"))
    return source.mapInArrow(run, "id long, key long, n long, sig binary, entries array<long>")


def text_key(text: Column) -> Column:
    return F.when(text.isNull(), (1 << 63) - 1).otherwise(F.xxhash64(text))


def shingle_sets(docs: DataFrame, *, width: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingles(t.as_py(), width).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "items"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, items array<long>")


def bucket_keys(reps: DataFrame, collections: int) -> DataFrame:
    """(key, id) of the tables that an entry shared with another set takes part in."""
    flat = reps.select("id", F.posexplode("entries").alias("pos", "code"))
    shared = flat.groupBy("pos", "code").count().where("count > 1").select("pos", "code")
    alive = flat.join(shared, ["pos", "code"]).groupBy("id").agg(F.collect_list(F.struct("pos", "code")).alias("entries"))
    left = F.filter("entries", lambda e: e["pos"] < collections)
    right = F.filter("entries", lambda e: e["pos"] >= collections)
    pairs = alive.select("id", F.explode(left).alias("a"), right.alias("right")).select("id", "a", F.explode("right").alias("b"))
    return pairs.select(F.xxhash64("a.pos", "a.code", "b.pos", "b.code").alias("key"), "id")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b): those whose sets meet the threshold."""
    one, two = (sets.select(F.col("id").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")
    joined = pairs.join(one, "a").join(two, "b")
    both = F.size(F.array_intersect("a_items", "b_items"))
    return joined.where(100 * both >= percent * (F.size("a_items") + F.size("b_items") - both)).select("a", "b")


def near_links(reps: DataFrame, docs: DataFrame, *, width: int, percent: int, collections: int, id_col: str, text_col: str, rounds: int) -> DataFrame:
    """(id, root) over the representatives ``reps`` (id, key, n, entries) that have a link."""
    keys = materialize(bucket_keys(reps, collections), "keys")
    crowds = keys.groupBy("key").count().where("count > 1")
    members = materialize(keys.join(crowds, "key").select("key", "id", "count"), "members")
    involved = reps.select("id", "key").join(members.select("id").distinct(), "id", "left_semi")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("key", text_key(F.col("text"))).join(involved, ["id", "key"], "left_semi").dropDuplicates(["id"])
    sets = materialize(shingle_sets(texts, width=width, id_col="id", text_col="text"), "sets")

    # The member with most company is near the middle of its group: most others link with it.
    company = members.groupBy("id").agg(F.sum("count").alias("company"))
    ranked = members.join(company, "id")
    pivots = ranked.groupBy("key").agg(F.max_by("id", F.struct("company", "id")).alias("pivot"))
    roots, done, before = None, None, float("inf")
    open_members = members.select("key", "id")
    for turn in range(rounds + 1):
        pairs = (
            open_members.join(pivots, "key").where("id <> pivot")
            .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        )
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        done = pairs if done is None else done.union(pairs)
        fresh = materialize(confirmed(pairs, sets, percent), "links")
        # A known component goes on as a star around its root.
        roots = components(fresh if roots is None else _stars(roots).union(fresh))
        state = _still_open(open_members, roots, sets, percent)
        if state is None:
            return roots
        open_members, left, held = state
        # Pairs count once for each table they share. Blocks bear a few dozen of them a set.
        if turn == rounds or left <= collections**2 * held * BLOCK // 4 or left > before / 2:
            break
        before = left
        of = F.xxhash64("id", F.lit(turn))
        by_root = open_members.groupBy("key", "root").agg(F.min_by("id", of).alias("pivot"), F.count("*").alias("size"))
        pivots = by_root.groupBy("key").agg(F.max_by("pivot", F.struct("size", "pivot")).alias("pivot"))
    across = materialize(_block_links(open_members, reps, sets, percent, collections), "links")
    return roots if across.isEmpty() else components(_stars(roots).union(across))


def _stars(roots: DataFrame) -> DataFrame:
    return roots.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))


def _block_links(open_members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, collections: int, block: int = BLOCK) -> DataFrame:
    """All links between components among the open sets: whoever shares a table shares an entry
    of A, so the sets with one such entry are compared with each other, in pairs of blocks of
    about ``block`` sets: the items that several of them hold are the columns of a table of ones and
    zeros, and its products count what each pair shares. Only links leave a task, never the pairs. A set is copied once for each
    block of its entry: m sets of one entry that pivots and drop-outs have left open cost
    m * m / block copies, in as many tasks."""
    ids = open_members.select("id", "root").distinct()
    flat = reps.join(ids, "id").select("id", "root", F.explode(F.slice("entries", 1, collections)).alias("code"))
    sizes = flat.groupBy("code").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    parts = F.ceil(F.col("size") / block).cast("int")
    placed = flat.join(sizes, "code").select("code", "id", "root", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    paired = placed.select("code", "id", "root", "part", other).select("code", "id", "root", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    def compare(rows: pa.Table) -> pa.Table:
        ids, roots, part = (rows.column(c).to_numpy() for c in ("id", "root", "part"))
        items = rows.column("items").combine_chunks()
        sizes = np.diff(items.offsets.to_numpy()).astype(np.int64)
        _, places, holders = np.unique(items.flatten().to_numpy(), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(ids)), sizes)[several := holders[places] > 1]
        columns = (np.cumsum(holders > 1) - 1)[places[several]]
        order = np.argsort(columns, kind="stable")
        owner, columns = owner[order], columns[order]
        one, two = (np.flatnonzero(part == rows.column(c)[0].as_py()) for c in ("low", "high"))
        both = np.zeros((len(one), len(two)))
        for start in range(0, columns.max(initial=-1) + 1, STRIPE):
            inside = slice(*np.searchsorted(columns, [start, start + STRIPE]))
            held = np.zeros((len(ids), min(STRIPE, columns[-1] + 1 - start)), np.float32)
            held[owner[inside], columns[inside] - start] = 1
            both += held[one] @ held[two].T
        near = (100 * both >= percent * (sizes[one][:, None] + sizes[two] - both)) & (roots[one][:, None] != roots[two])
        left, right = (ids[place[k]] for place, k in zip((one, two), np.nonzero(near), strict=True))
        found = np.unique(np.column_stack([np.minimum(left, right), np.maximum(left, right)]), axis=0)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return paired.join(sets, "id").groupBy("code", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def _still_open(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int):
    """The members of buckets with several components whose sets can still link, with root, n
    and v; how many pairs they leave; how many sets they are. None if no bucket is open."""
    now = members.select("key", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    for _ in range(3):
        mixed_keys = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        now = materialize(now.join(mixed_keys, "key").select("key", "id", "root"), "open")
        ids = now.select("id").distinct()
        held = ids.count()
        if not held:
            return None
        items = sets.join(ids, "id").select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
        lone = items.groupBy("item").agg(F.count("*").alias("holders"), F.first("id").alias("id")).where("holders = 1")
        alone = lone.groupBy("id").agg(F.count("*").alias("alone"))
        size = sets.join(ids, "id").select("id", F.size("items").alias("n"))
        fit = size.join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("v")).where(100 * F.col("v") >= percent * F.col("n"))
        kept = materialize(fit, "fit")
        now = now.join(kept, "id").select("key", "id", "root", "n", "v")
        if 2 * kept.count() > held:
            break
    now = materialize(now, "open")
    by_root = now.groupBy("key", "root").count()
    by_key = by_root.groupBy("key").agg(F.sum("count").alias("all"), F.sum(F.col("count") * F.col("count")).alias("own"))
    left = by_key.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2)).first()[0]
    return (now, left, held) if left else None


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, rows: int = 4, collections: int | None = None,
                    rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id (the smallest id reachable over links) and kept, one
    row for each distinct id. ``percent`` is the least Jaccard similarity in hundredths."""
    if collections is None:
        collections = collections_for(percent, rows)
    found = signatures(docs.where(F.col(id_col).isNotNull()), width=width, rows=rows, collections=collections, id_col=id_col, text_col=text_col)
    rest = F.struct("key", "n", "sig", "entries")
    found = materialize(found.groupBy("id").agg(F.min_by(rest, "key").alias("one")).select("id", "one.*"), "signatures")
    classes = found.where("sig is not null").groupBy("sig").agg(F.min("id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = found.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "key", "n", "entries")
    roots = near_links(reps, docs, width=width, percent=percent, collections=collections, id_col=id_col, text_col=text_col, rounds=rounds)
    # The smallest id of a class is its representative, so the smallest root is the smallest id.
    of_class = classes.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("sig", F.coalesce("root", "rep").alias("component"))
    out = found.select("id", "n", "sig").join(of_class, "sig", "left").select("id", "n", F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
