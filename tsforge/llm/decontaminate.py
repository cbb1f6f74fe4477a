"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are brought to lower-case words joined by single spaces. An item of m
characters may be found with up to k = m * percent // 100 edits. Cut into k + 1 pieces, at least
one piece stands unedited in any such copy, so every copy shows an exact piece hit at a known
offset. The pieces of a block of items form one search automaton; each hit is verified by Myers'
bit-parallel distance of the whole item against the text around the hit.

Documents are searched where they are read, without a shuffle. Items go in blocks of about
``block_chars`` characters (an item more at most). A benchmark of one block is one lazy pass over
the documents; of more, each block is a pass whose hits are written before the next block is read,
so that driver and tasks hold one block at a time.

Defined results: null, empty and wordless items match nothing, and so do null and empty texts;
equal items are each reported; repeated rows of a document are reported each, those without an id
with a null doc_id; items without an id aren't searched for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import materialize, sliced

WORDS = re.compile(r"\w+")


def plain(text: str | None) -> str:
    return " ".join(WORDS.findall((text or "").lower()))


def budget(size: int, percent: int) -> int:
    return size * percent // 100


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of the item with their offsets, of lengths that differ by one at most."""
    n, parts = len(item), errors + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """The least edit distance of ``pattern`` to a substring of a text, one bit a character."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.all, self.top = (1 << self.size) - 1, 1 << (self.size - 1)

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end): the first end with the least distance."""
        up, down, score, every, top, masks = self.all, 0, self.size, self.all, self.top, self.masks
        least, at = score, 0
        for i, c in enumerate(text):
            eq = masks.get(c, 0)
            flat = (((eq & up) + up) ^ up) | eq | down
            more = down | (every & ~(flat | up))
            less = up & flat
            if more & top:
                score += 1
            elif less & top:
                score -= 1
                if score < least:
                    least, at = score, i + 1
            more, less = more << 1 & every, less << 1 & every
            eq |= down
            up = less | (every & ~(eq | more))
            down = more & eq
        return least, at


class Finder:
    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.items = [(i, p, budget(len(p), percent)) for i, p in items]
        self.myers: dict[int, Myers] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item, errors) in enumerate(self.items):
            for offset, piece in pieces(item, errors):
                found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def search(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item id, distance, end in the plain text) of every item found, each once with its
        best copy."""
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                known = best.get(n)
                if known and known[0] == 0:
                    continue
                _, item, errors = self.items[n]
                start = end + 1 - size - offset
                windows = tried.setdefault(n, [])
                if windows and windows[-1][0] <= start <= windows[-1][1]:
                    continue  # a copy whose verified window covers this one's
                if text.startswith(item, max(0, start)):
                    best[n] = (0, start + len(item))
                    continue
                begin = max(0, start - 2 * errors)
                if n not in self.myers:
                    self.myers[n] = Myers(item)
                distance, at = self.myers[n].best(text[begin : start + len(item) + 2 * errors])
                windows.append((start - errors, start + errors))
                if distance <= errors and (known is None or distance < known[0]):
                    best[n] = (distance, begin + at)
        for n, (distance, at) in best.items():
            yield self.items[n][0], distance, at


def item_blocks(benchmark: DataFrame, block_chars: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    block, used = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    for row in rows.orderBy("id", "text").toLocalIterator():
        if item := plain(row["text"]):
            block.append((row["id"], item))
            used += len(item)
            if used >= block_chars:
                yield block
                block, used = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, *, percent: int = 8, block_chars: int = 4 << 20, doc_id: str = "doc_id",
                 doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, end_char: each test item that a document holds, with the edit
    distance of its best copy and that copy's end in the document's plain text."""
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, end_char int"

    def search(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(block, percent)
            for batch in sliced(batches):
                rows = [
                    (doc.as_py(), *hit)
                    for doc, text in zip(batch.column("id"), batch.column("text"), strict=True)
                    for hit in finder.search(plain(text.as_py()))
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "end_char"])

        return source.mapInArrow(run, schema)

    blocks = item_blocks(benchmark, block_chars, item_id, item_text)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return docs.sparkSession.createDataFrame([], schema)
    if following is None:
        return search(block)
    found = [materialize(search(block), "hits")]
    while following is not None:
        found.append(materialize(search(following), "hits"))
        following = next(blocks, None)
    return reduce(DataFrame.union, found)
