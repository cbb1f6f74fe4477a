"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of a byte string is its value as a polynomial at a fixed base, modulo two primes
near 2 ** 31, together with its length. It composes: the fingerprint of two strings one behind the
other is the first one's, shifted by the second one's length (times the base to that power), plus
the second one's. So a text is fingerprinted in chunks. A text of one chunk is done where it is
read. A longer one leaves as rows of chunks, which are dealt over all tasks, hashed there, shifted
by the number of bytes behind them, and summed for each text in any order.

Equal fingerprints say little by themselves, so the texts behind them are compared byte by byte.
The second pass reads the texts again and lets through, by a Bloom filter of a fixed size, little
but those whose fingerprint occurs twice. Their chunks stream into groups by (fingerprint, place):
a group is of one kind exactly if its smallest and its largest chunk are the same, and both are
kept in each task before anything is sent, so copies beyond the first of a task cost no shuffle
however many they are. Texts that share a fingerprint but differ are then told apart by their
chunks themselves.

A-Z are lower-cased before anything else; no other character changes.

Defined results: a null text is the empty one, and all empty texts are equal. The row with the
largest id stays; rows without an id come last and stay only where no row of their group has one.
Rows that repeat an id and a text are copies like any others: exactly one row of a group is kept,
and all of them carry its id. An empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import materialize, sliced

#: Bytes of a chunk.
CHUNK = 1 << 16
#: The largest prime below 2 ** 31 and the one before it, and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 741103597)
#: Words of 64 bits in the filter of the second pass: 2 MB, whatever the input.
FILTER_WORDS = 1 << 18


class Polynomial:
    """Fingerprints of byte strings, chunk by chunk; sums stay below 2 ** 56."""

    def __init__(self, primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES, chunk: int = CHUNK):
        self.primes, self.bases, self.chunk = primes, bases, chunk
        powers = np.ones((2, chunk), np.int64)
        for row, (p, base) in enumerate(zip(primes, bases, strict=True)):
            power = 1 % p
            for k in range(chunk - 1, -1, -1):
                powers[row, k], power = power, power * base % p
        self.powers = powers

    def of_chunk(self, data: bytes) -> tuple[int, int]:
        values = np.frombuffer(data, np.uint8).astype(np.int64)
        one, two = (self.powers[:, self.chunk - len(values) :] * values).sum(axis=1)
        return int(one) % self.primes[0], int(two) % self.primes[1]

    def shifted(self, value: tuple[int, int], behind: int) -> tuple[int, int]:
        """The share of a chunk that has ``behind`` bytes behind it."""
        one, two = (v * pow(b, behind, p) % p for v, b, p in zip(value, self.bases, self.primes, strict=True))
        return one, two

    def pieces(self, data: bytes) -> list[bytes]:
        return [data[i : i + self.chunk] for i in range(0, len(data), self.chunk)] or [b""]

    def of(self, data: bytes) -> tuple[int, int]:
        """The whole text's, front to back."""
        one = two = 0
        for piece in self.pieces(data):
            (one, two), own = self.shifted((one, two), len(piece)), self.of_chunk(piece)
            one, two = (one + own[0]) % self.primes[0], (two + own[1]) % self.primes[1]
        return one, two


def normalised(text: pa.Scalar) -> bytes:
    """UTF-8 of the text with A-Z lower-cased."""
    return (text.as_py() or "").encode().lower()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hashed: Polynomial | None = None) -> DataFrame:
    """row (a number of its own), id, n_bytes, one, two (the fingerprint) and sha256 of each row's
    normalised text. Written to the shared folder, so numbers of rows stay as they are."""
    poly = hashed or Polynomial()
    kind = docs.schema[id_col].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for start, texts in _by_bytes(batch.column("text")):
                out: list[tuple] = []
                for k, data in enumerate(texts, start):
                    sha, pieces = hashlib.sha256(data).hexdigest(), poly.pieces(data)
                    if len(pieces) == 1:
                        out.append((k, len(data), *poly.of_chunk(data), sha, None, None))
                    else:
                        behind = len(data)
                        for at, piece in enumerate(pieces):
                            behind -= len(piece)
                            out.append((k, len(data), None, None, None if at else sha, behind, piece))
                if out:
                    place, n, one, two, sha, behind, piece = zip(*out, strict=True)
                    own = batch.take(pa.array(place))
                    arrays = [own.column("row"), own.column("id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sha, pa.string()), pa.array(behind, pa.int64()), pa.array(piece, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "n_bytes", "one", "two", "sha256", "behind", "piece"])

    def hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [poly.shifted(poly.of_chunk(piece.as_py()), behind.as_py()) for piece, behind in zip(batch.column("piece"), batch.column("behind"), strict=True)]
            values = np.array(shares, np.int64).reshape(-1, 2)
            arrays = [batch.column(c) for c in ("row", "id", "n_bytes", "sha256")] + [pa.array(values[:, 0]), pa.array(values[:, 1])]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "n_bytes", "sha256", "one", "two"])

    head = f"row long, id {kind.simpleString()}, n_bytes long"
    numbered = _texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    read = materialize(numbered.mapInArrow(scan, f"{head}, one long, two long, sha256 string, behind long, piece binary"), "fingerprints")
    dealt = read.where("piece is not null").select("row", "id", "n_bytes", "sha256", "behind", "piece").repartition("row", "behind")
    shares = dealt.mapInArrow(hash_chunks, f"{head}, sha256 string, one long, two long")
    sums = [F.pmod(F.sum(c), F.lit(p)).alias(c) for c, p in zip(("one", "two"), poly.primes, strict=True)]
    long = shares.groupBy("row").agg(F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), *sums, F.max("sha256").alias("sha256"))
    return read.where("piece is null").select("row", "id", "n_bytes", "one", "two", "sha256").unionByName(materialize(long, "long_fingerprints"))


def _by_bytes(texts: pa.Array, most: int = 1 << 24) -> Iterator[tuple[int, list[bytes]]]:
    """Normalised texts in runs of about ``most`` bytes, each with the place of its first one."""
    start, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(normalised(text))
        size += len(held[-1])
        if size >= most:
            yield start, held
            start, held, size = k + 1, [], 0
    yield start, held


def _chunks(docs: DataFrame, poly: Polynomial, extra: str = "") -> DataFrame:
    """one, two, n_bytes, at (number of the chunk), piece, and the column ``extra`` of ``docs``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for start, texts in _by_bytes(batch.column("text")):
                out = [(k, *poly.of(data), len(data), at, piece) for k, data in enumerate(texts, start) for at, piece in enumerate(poly.pieces(data))]
                if out:
                    place, one, two, n, at, piece = zip(*out, strict=True)
                    columns = {"one": pa.array(one, pa.int64()), "two": pa.array(two, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "at": pa.array(at, pa.int64()), "piece": pa.array(piece, pa.binary())}
                    columns |= {extra: batch.column(extra).take(pa.array(place))} if extra else {}
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "one long, two long, n_bytes long, at long, piece binary"
    return docs.mapInArrow(split, f"{schema}, {extra} {docs.schema[extra].dataType.simpleString()}" if extra else schema)


PRINT = ["one", "two", "n_bytes"]


def clashes(docs: DataFrame, groups: DataFrame, poly: Polynomial, *, text_col: str) -> DataFrame:
    """The fingerprints among ``groups`` (of two rows or more) whose texts aren't all the same."""
    code = F.xxhash64(*PRINT)
    word, bit = F.pmod(F.shiftright(code, 6), F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(code, F.lit(64)).cast("int"))
    words = groups.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    read = _chunks(docs.select(F.col(text_col).cast("string").alias("text")), poly)
    likely = read.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    ends = likely.groupBy(*PRINT, "at").agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
    return ends.where("low <> high").select(*PRINT).distinct().join(groups.select(*PRINT), PRINT, "left_semi")


def _told_apart(docs: DataFrame, clashing: DataFrame, poly: Polynomial, *, id_col: str, text_col: str) -> DataFrame:
    """row, id, n_bytes, sha256 and class (equal for equal texts alone) of the rows whose
    fingerprint is among ``clashing``. Each place's distinct chunks get numbers, and a text is the
    list of its chunks' numbers."""
    texts = materialize(_texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "texts")
    chunks = materialize(_chunks(texts, poly, "row").join(clashing, PRINT, "left_semi"), "chunks")
    place = [*PRINT, "at"]
    numbers = chunks.groupBy(*place, "piece").agg(F.min("row").alias("number"))
    told = chunks.join(numbers, [*place, "piece"]).groupBy("row", *PRINT).agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("class"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sha = [hashlib.sha256(normalised(text)).hexdigest() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(sha, pa.string())], names=["row", "id", "sha256"])

    own = texts.join(told.select("row"), "row", "left_semi").mapInArrow(digest, f"row long, id {texts.schema['id'].dataType.simpleString()}, sha256 string")
    return told.join(own, "row").select("row", "id", "sha256", F.struct(*PRINT, "class").alias("class"))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hashed: Polynomial | None = None) -> DataFrame:
    """``id_col``, keep_id (id of the row that stays), group_size, kept and text_sha256, one row for each row of ``docs``."""
    poly = hashed or Polynomial()
    found = fingerprints(docs, id_col=id_col, text_col=text_col, hashed=poly)
    last = F.max(F.struct("id", "row")).alias("last")
    groups = materialize(found.groupBy(*PRINT).agg(F.count("*").alias("group_size"), last), "groups")
    clashing = materialize(clashes(docs, groups.where("group_size > 1"), poly, text_col=text_col), "clashes")
    told = [F.col("id").alias(id_col), F.col("last.id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), F.col("sha256").alias("text_sha256")]
    if clashing.isEmpty():
        return found.join(groups, PRINT).select(*told)
    clear = found.join(groups.join(clashing, PRINT, "left_anti"), PRINT).select(*told)
    apart = materialize(_told_apart(docs, clashing, poly, id_col=id_col, text_col=text_col), "told_apart")
    return clear.union(apart.join(apart.groupBy("class").agg(F.count("*").alias("group_size"), last), "class").select(*told))


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. They are numbered and written first,
    so that a row is found again by its number even where ids are missing or repeat."""
    number = "exact_dedup_row"
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    ids = numbered.select(F.struct(F.col(id_col).alias("id"), number).alias("id"), F.col(text_col).alias("text"))
    kept = exact_duplicates(ids, id_col="id", text_col="text").where("kept").select(F.col(f"id.{number}").alias(number))
    return numbered.join(kept, number, "left_semi").drop(number)
