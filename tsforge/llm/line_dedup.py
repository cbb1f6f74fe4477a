"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

A document is the sequence of its lines that hold more than white space, trimmed and hashed. A
run is repeated if at least ``window`` consecutive lines of it stand in the same order earlier
(in a document of smaller id, or further up in the same one). With ``words``, a single line of at
least that many words (parted by white space) is a repeated run as well, whatever stands around
it, also where it is a document's only line.

1. Of every ``window`` consecutive lines the one with the smallest hash is a fingerprint, so each
   run of that length holds one; a line of ``words`` words is its own. Fingerprints that occur
   once in the corpus end the search where they stand.
2. The windows around the others are hashed, and each position is joined to the earliest position
   of the same window. A run gives one such pair for each document that it is earliest in: of
   neighbouring pairs on one diagonal only the first stays.
3. Each pair is extended both ways along the two documents' line hashes as far as they agree.
   What the later document holds of the run is deleted.

Counts and earliest positions are summed before the shuffle, so a line that a third of all
documents hold gives one row a task; the joins that carry them back are plain equi-joins, which
adaptive execution splits where one key is hot. A position has one partner, the earliest one, so
no pairs of occurrences are formed.

Defined results: blank lines are kept and break no run; null and empty texts stay as they are;
a row without id takes no part and stays whole; rows alike in id and text stand at the same place,
so that neither is earlier than the other; different texts of one id are documents of their own,
in the order of their hashes; a document that loses every line has the text ''; lines are equal if
their 64-bit hashes are; a column line_dedup of the input gives way to the one that is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import materialize


def line_array(text: str | Column) -> Column:
    return F.split(F.col(text) if isinstance(text, str) else text, "\n", -1)


def _lines(docs: DataFrame, id_col: str, text_col: str, words: int | None) -> DataFrame:
    """id, the text's hash as key, and the hashes of its lines that aren't blank, with their places
    in the text and whether they are long enough to count alone."""
    alone = lambda x: F.lit(False) if words is None else F.regexp_count(x, F.lit("[^ ]+")) >= words
    trimmed = F.transform(line_array(text_col), lambda x: F.trim(F.translate(x, "\t\r\v\f", "    ")))
    placed = F.transform(trimmed, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("at"), (x != "").alias("full"), alone(x).alias("alone")))
    return (
        docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.filter(placed, lambda x: x["full"]).alias("lines"))
    )


def repeated_lines(docs: DataFrame, *, window: int = 2, words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, gone): the lines (from 0) that lie in a later copy of a run, of the text with that
    id and hash."""
    rows = materialize(_lines(docs, id_col, text_col, words), "lines")
    ends = F.sequence(F.lit(0), F.size("lines") - window)
    span = lambda i, n: F.struct(i.alias("i"), F.lit(n).alias("n"), F.slice("lines", i + 1, n).alias("w"))
    runs = F.when(F.size("lines") >= window, F.transform(ends, lambda i: span(i, window))).otherwise(F.array())
    if words is not None:
        alone = F.filter(F.transform("lines", lambda x, i: F.struct(x["alone"].alias("alone"), i.alias("i"))), lambda x: x["alone"])
        runs = F.concat(runs, F.transform(alone, lambda x: span(x["i"], 1)))
    hashes = F.transform("r.w", lambda x: x["h"])
    windows = rows.select("id", "key", F.explode(runs).alias("r")).select("id", "key", "r.i", "r.n", F.xxhash64(hashes).alias("whole"), F.array_min(hashes).alias("print"))
    place = F.struct("id", "key", "i")
    prints = windows.groupBy("print").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    matched = materialize(windows.join(prints.where("low < high").select("print"), "print"), "windows")
    first = matched.groupBy("whole", "print").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("whole", "print", "first")
    later = matched.join(first, ["whole", "print"]).where(place > F.col("first"))
    # One row for two documents and a diagonal; of neighbouring windows on it the first leads.
    pair = later.select("id", "key", "i", "n", F.col("first.id").alias("id2"), F.col("first.key").alias("key2"), (F.col("i") - F.col("first.i")).alias("shift"))
    seeds = pair.groupBy("id", "key", "id2", "key2", "shift").agg(F.collect_set(F.struct("i", "n")).alias("all"))
    leads = F.filter("all", lambda x: ~F.exists("all", lambda y: (y["i"] == x["i"] - 1) & (y["n"] == x["n"])))
    held = rows.select("id", "key", F.transform("lines", lambda x: x["h"]).alias("own"))
    both = seeds.select("id", "key", "id2", "key2", "shift", leads.alias("seeds")).join(held, ["id", "key"]).join(held.toDF("id2", "key2", "other"), ["id2", "key2"])
    equal = F.transform("own", lambda h, j: h.eqNullSafe(F.get("other", j - F.col("shift"))))
    agree = both.select("id", "key", "seeds", equal.alias("equal"))

    def extended(x: Column) -> Column:
        """The lines of the run around a seed; of a single line whose run is too short, itself."""
        behind = F.array_position(F.reverse(F.slice("equal", 1, x["i"])), False).cast("int")
        ahead = F.array_position(F.slice("equal", x["i"] + 1, F.size("equal")), False).cast("int")
        begin = F.when(behind == 0, 0).otherwise(x["i"] - behind + 1)
        end = F.when(ahead == 0, F.size("equal")).otherwise(x["i"] + ahead - 1)
        return F.when(end - begin >= window, F.sequence(begin, end - 1)).otherwise(F.sequence(x["i"], x["i"] + x["n"] - 1))

    gone = agree.select("id", "key", F.array_distinct(F.flatten(F.transform("seeds", extended))).alias("gone"))
    numbers = gone.groupBy("id", "key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    ats = rows.select("id", "key", F.transform("lines", lambda x: x["at"]).alias("ats")).dropDuplicates(["id", "key"])
    return numbers.join(ats, ["id", "key"]).select("id", "key", F.transform("gone", lambda j: F.get("ats", j)).alias("gone"))


def drop_repeated_lines(docs: DataFrame, *, window: int = 2, words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, ``text_col`` without the lines of later copies, and the struct
    ``line_dedup`` of n_lines, n_removed and emptied (no line but blank ones is left)."""
    gone = repeated_lines(docs, window=window, words=words, id_col=id_col, text_col=text_col)
    # The input's columns stand in one struct, whatever their names.
    row = lambda c: F.col("row").getField(c)
    source = docs.select(F.struct("*").alias("row"))
    source = source.withColumns({"id": row(id_col).cast("long"), "key": F.xxhash64(row(text_col)), "lines": line_array(row(text_col))})
    joined = source.join(gone, ["id", "key"], "left")
    kept = F.filter("lines", lambda x, i: ~F.array_contains("gone", i))
    touched = F.col("gone").isNotNull()
    text = F.when(touched, F.array_join(kept, "\n")).otherwise(row(text_col))
    counts = F.struct(
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.when(touched, F.size("gone")).otherwise(0).alias("n_removed"),
        (touched & (F.trim(F.translate(F.array_join(kept, ""), "\t\r\v\f", "    ")) == "")).alias("emptied"),
    )
    done = joined.select("row", text.alias("text"), counts.alias("counts"))
    return done.select(*((F.col("text") if c == text_col else row(c)).alias(c) for c in docs.columns if c != "line_dedup"), F.col("counts").alias("line_dedup"))
