"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the
encoding of theirs, and each prefix of a byte string has one encoding. So one number for each
prefix says everything: the last token of that prefix's encoding. The token that ends at byte i
is the one whose start j has a stored last token that it may follow. Following the stored tokens
back from the end gives the encoding. Appending bytes only adds entries, and after an edit the
entries before it stay and those behind it are taken over as soon as as many entries as the
longest token has bytes agree again.

A text is split by a pattern first, and each match is encoded on its own. Matches repeat, so
each worker keeps a bounded table of those it has encoded.

Defined results: null is the empty text, which has no tokens; decoding gives the text's bytes.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import sliced

#: Entries of a worker's tables of words, prefixes and token pairs; a full table is emptied.
WORDS_KEPT, PREFIXES_KEPT, PAIRS_KEPT = 250_000, 500_000, 300_000
#: Bytes of a string that counts as short.
SHORT = 64
#: A space beside another white space, or at an end.
WIDE_SPACE = regex.compile(r"^ | $| \s|\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Each token and each beginning of one, with the token or else -1.
        self.starts_with = {token[:n]: -1 for token in ranks for n in range(1, len(token))} | ranks
        self.ends_with = {token[n:]: -1 for token in ranks for n in range(1, len(token))} | ranks
        self.pairs: dict[int, bool] = {}
        #: The last token of each prefix of the short strings seen so far.
        self.prefixes: dict[bytes, int] = {}

    def merged(self, data: bytes) -> list[int]:
        """By repeated merges of the lowest rank; only short strings come here."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
            if rank == sys.maxsize:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``left right`` encodes its own bytes; where left is -1, whether ``right`` does."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        pair = [right] if left < 0 else [left, right]
        fits = self.pairs[left << 32 | right] = self.merged(b"".join(self.bytes_of[t] for t in pair)) == pair
        return fits


    def encode_short(self, data: bytes) -> list[int]:
        """The same table, shared by all short strings: entries of a beginning seen before stay."""
        size, memo, ends_with, pairs = len(data), self.prefixes, self.ends_with, self.pairs
        if len(memo) >= PREFIXES_KEPT:
            memo.clear()
        known = size
        while known and data[:known] not in memo:
            known -= 1
        for end in range(known + 1, size + 1):
            for start in range(end - 1, -1, -1):
                token = ends_with.get(data[start:end])
                if token is None:
                    break
                if token >= 0:
                    left = memo[data[:start]] if start else -1
                    fits = pairs.get(left << 32 | token)
                    if self.may_follow(left, token) if fits is None else fits:
                        memo[data[:end]] = token
                        break
        out, end = [], size
        while end:
            token = memo[data[:end]]
            out.append(token)
            end -= len(self.bytes_of[token])
        out.reverse()
        return out


class PrefixTable:
    """The last token of each prefix of one byte string, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int] = []
        self.append(data)

    def _fill(self, begin: int, stop: int) -> None:
        """The entries of the prefixes that end behind ``begin``, up to ``stop``, where earlier
        ones are known. Each start offers the tokens that begin there; one of all offers fits."""
        data, last, starts_with, known = self.data, self.last, self.vocabulary.starts_with, self.vocabulary.pairs
        last += [-1] * (stop - begin)
        for start in range(max(0, begin - self.vocabulary.longest + 1), stop):
            left = last[start - 1] if start else -1
            for end in range(start + 1, stop + 1):
                token = starts_with.get(data[start:end])
                if token is None:
                    break
                if token >= 0 and end > begin and last[end - 1] < 0:
                    fits = known.get(left << 32 | token)
                    if self.vocabulary.may_follow(left, token) if fits is None else fits:
                        last[end - 1] = token

    def append(self, more: bytes) -> None:
        begin, self.data = len(self.data), self.data + more
        self._fill(begin, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to stop; returns how many entries were computed."""
        tail, step = self.last[stop:], self.vocabulary.longest
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = self.last[:start]
        behind, done, total = start + len(new), start, len(self.data)
        while done < total:
            upto = min(total, max(done, behind) + step)
            self._fill(done, upto)
            done = upto
            if done - step >= behind and self.last[done - step :] == tail[done - step - behind : done - behind]:
                self.last += tail[done - behind :]
                break
        return done - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        out.reverse()
        return out


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str, cut_at_spaces: bool = False):
        self.cut_at_spaces = cut_at_spaces
        self.vocabulary, self.split = vocabulary, regex.compile(pattern)
        self._words: dict[str, array] = {}
        self._pieces: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        known = self._pieces.get(text)
        if known is None:
            if len(self._pieces) >= WORDS_KEPT:
                self._pieces.clear()
            known = self._encode(text)
            if len(text) <= SHORT:
                self._pieces[text] = known
        return known

    def _encode(self, text: str) -> list[int]:
        data = text.encode()
        return self.vocabulary.encode_short(data) if len(data) <= SHORT else PrefixTable(self.vocabulary, data).tokens()

    def matches(self, text: str) -> list[int]:
        pieces = self._pieces
        return [i for match in self.split.findall(text) for i in pieces.get(match) or self.piece(match)]

    def encode(self, text: str) -> array:
        """Where ``cut_at_spaces`` holds, a space between two other characters always begins a
        match, so that the words between such spaces are split and looked up on their own."""
        if not self.cut_at_spaces or WIDE_SPACE.search(text):
            return array("I", self.matches(text))
        first, *rest = text.split(" ")
        out, words = array("I", self.matches(first)), self._words
        for word in rest:
            ids = words.get(word)
            if ids is None:
                if len(words) >= WORDS_KEPT:
                    words.clear()
                # Letters alone are one match, with the space before them.
                ids = array("I", self._encode(" " + word) if word.isalpha() else self.matches(" " + word))
                if len(word) <= SHORT:
                    words[word] = ids
            out.extend(ids)
        return out

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class EditableEncoding:
    """A text with its encoding, which appends and edits bring up to date near the change."""

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.text = encoder, text
        self.starts = [m.start() for m in encoder.split.finditer(text)]
        self.pieces = [encoder.piece(m) for m in encoder.split.findall(text)]

    def replace(self, start: int, stop: int, new: str) -> int:
        """Returns how many matches were encoded anew. Matches that end two characters before
        the edit stay, as the pattern looks one character ahead; splitting again stops where a
        match behind the edit starts as one did before."""
        shift = len(new) - (stop - start)
        keep = max(0, bisect_right(self.starts, max(0, start - 2)) - 1)
        begin = self.starts[keep] if keep < len(self.starts) else 0
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= stop}
        self.text = self.text[:start] + new + self.text[stop:]
        starts, pieces, resume = [], [], len(self.pieces)
        for m in self.encoder.split.finditer(self.text, begin):
            if m.start() >= start + len(new) and m.start() in old:
                resume = old[m.start()]
                break
            starts.append(m.start())
            pieces.append(self.encoder.piece(m.group()))
        self.starts = self.starts[:keep] + starts + [s + shift for s in self.starts[resume:]]
        self.pieces = self.pieces[:keep] + pieces + self.pieces[resume:]
        return len(pieces)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def ids(self) -> array:
        return array("I", [i for piece in self.pieces for i in piece])


@lru_cache(maxsize=4)
def encoder_for(path: str, pattern: str) -> Encoder:
    # In patterns like the usual one a match holds a space only as its first character or among
    # white space alone.
    return Encoder(Vocabulary(read_ranks(path)), pattern, cut_at_spaces=pattern == public_tokenizers.PATTERN)


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = True) -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256 and, unless ``with_ids`` is off, the ids
    themselves as array<int>, for every row. No shuffle: each text is encoded where it is read.
    ``ranks_path`` names a file that every executor has."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    digest = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks_path, pattern)
        for batch in sliced(batches):
            rows = []
            for text in batch.column("text"):
                ids = encoder.encode(text.as_py() or "")
                rows.append((
                    len(ids), hashlib.sha256(little_endian(ids)).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest(),
                    ids.tolist() if with_ids else None,
                ))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            fields = digest + [("token_ids", pa.list_(pa.int32()))] * with_ids
            arrays = [pa.array(columns[i], kind) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", *(n for n, _ in fields)])

    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, ranks_path: str, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``id_col`` and data: the bytes of each row's tokens (null ids: no bytes)."""
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_for(ranks_path, ".").vocabulary
        for batch in sliced(batches):
            data = [b"".join(map(vocabulary.bytes_of.__getitem__, ids.as_py() or ())) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(data, pa.binary())], names=["id", "data"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, data binary").withColumnRenamed("id", id_col)
