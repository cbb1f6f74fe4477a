"""Exact duplicates, source divergence and token alignment against brute force, on small fixtures
that hold nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tsforge.llm import divergence, exact_dedup, token_alignment

SCHEMA = "doc_id long, text string, lang string, source string, row long, id long, piece string, seat string, term string, kind int"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, rows):
    """Documents (id, text, lang, source) with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, 7, 8, "x", "y", "z", 9) for r in rows], SCHEMA)


# Exact duplicates


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_duplicates(rows):
    groups = defaultdict(list)
    for k, (i, text, *_) in enumerate(rows):
        groups[lowered(text)].append((i is not None, i or 0, k))
    out = []
    for text, members in groups.items():
        known, top, _ = max(members)
        sha = hashlib.sha256(text.encode()).hexdigest()
        ids = [(i if has else None) for has, i, _ in members]
        kept_id = top if known else None
        left = 1
        for i in ids:
            stays = i == kept_id and left > 0
            left -= stays
            out.append((i, kept_id, len(members), stays, sha))
    return Counter(out)


DUPLICATES = [
    (1, "Some Text", "en", "a"), (2, "some text", "en", "a"), (2, "SOME TEXT", "en", "a"), (None, "some text", "en", "a"), (3, None, "en", "a"), (4, "", None, None),
    (5, "ÄB", "de", "a"), (6, "äb", "de", "a"), (7, "Äb", "de", "a"), (None, "alone", "de", "a"), (None, "alone", "de", "a"), (8, "x" * 300_000, "de", "a"), (9, "X" * 300_000, "de", "a"),
    (10, "x" * 299_999 + "y", "de", "a"), (11, "x" * 65_536, "de", "a"), (12, "x" * 65_537, "de", "a"), (-5, "neg", "de", "a"), (-4, "neg", "de", "a"), (13, " ", "de", "a"), (14, "a\x00", "de", "a"), (15, "a", "de", "a"),
]


def told(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_exact_duplicates_equal_brute_force(spark):
    assert told(exact_dedup.exact_duplicates(docs(spark, DUPLICATES))) == brute_duplicates(DUPLICATES)


def test_texts_that_share_a_fingerprint_are_told_apart(spark):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.choice((3, 9, 12)))), "en", "s") for k in range(300)] + DUPLICATES
    weak = exact_dedup.Polynomial(primes=(3, 2), bases=(1, 1), chunk=4)
    small = [(i, t[:40] if t else t, *rest) for i, t, *rest in rows]
    assert told(exact_dedup.exact_duplicates(docs(spark, small), hashed=weak)) == brute_duplicates(small)


def test_fingerprints_compose(spark):
    poly, data = exact_dedup.Polynomial(chunk=16), bytes(range(256)) * 3
    number = lambda d, p, b: sum(x * pow(b, len(d) - 1 - k, p) for k, x in enumerate(d)) % p
    assert poly.of(data) == tuple(number(data, p, b) for p, b in zip(poly.primes, poly.bases, strict=True))
    pieces, behind = poly.pieces(data), len(data)
    total = np.zeros(2, np.int64)
    for piece in pieces:
        behind -= len(piece)
        total += poly.shifted(poly.of_chunk(piece), behind)
    assert tuple(total % poly.primes) == poly.of(data) and poly.of(b"") == (0, 0)
    found = {r["id"]: r for r in exact_dedup.fingerprints(docs(spark, DUPLICATES)).where("id > 0").collect()}
    whole = exact_dedup.Polynomial()
    assert all((found[i]["one"], found[i]["two"], found[i]["n_bytes"]) == (*whole.of(lowered(t).encode()), len(lowered(t).encode())) for i, t, *_ in DUPLICATES if i and i > 2)


def test_exact_duplicates_of_nothing_and_rows_that_stay(spark):
    empty = docs(spark, DUPLICATES).where("false")
    assert exact_dedup.exact_duplicates(empty).collect() == [] and exact_dedup.drop_exact_duplicates(empty).columns == empty.columns
    stays = exact_dedup.drop_exact_duplicates(docs(spark, DUPLICATES))
    got = Counter((r["doc_id"], lowered(r["text"])) for r in stays.collect())
    assert got == Counter((i, t) for i, _, _, kept, sha in brute_duplicates(DUPLICATES).elements() if kept for t in {lowered(x[1]) for x in DUPLICATES} if hashlib.sha256(t.encode()).hexdigest() == sha)
    assert stays.columns == docs(spark, DUPLICATES).columns


def test_a_group_of_copies_with_a_third_of_all_rows(spark):
    rows = [(k, f"t{k % 700}" if k % 3 else "Copy " * 20, "en", "s") for k in range(6000)]
    assert told(exact_dedup.exact_duplicates(docs(spark, rows))) == brute_duplicates(rows)


# Source divergence


def brute_divergence(rows, least, top=50):
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        group = (lang or "", source or "")
        groups.add(group)
        terms = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(text)))
        counts[group].update(terms)
        in_docs[group[0]].update(terms.keys())
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least)
        v, own = len(kept), sorted(s for at, s in groups if at == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v) for t in kept}  # noqa: E731,B023
        of_lang = share(sum((counts[lang, s] for s in own), Counter()))
        p = {s: share(counts[lang, s]) for s in own}
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[s][t] - of_lang[t], t) for t in kept if counts[lang, s][t] and p[s][t] > of_lang[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return Counter(out)


def sources(seed=3, n=400):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("mot", "wört", "Palabra", "été", "日本", "x'y") for b in "abcdefgh"]
    rows = []
    for k in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", "é", "S2", None, "s10"])
        bias = words[: 5 + 3 * len(source or "")]
        rows.append((k, " ".join(rng.choice(bias if rng.random() < 0.5 else words) for _ in range(rng.randrange(0, 30))), lang, source))
    return [*rows, (1, None, "fr", "only"), (1, "", "it", "a"), (1, "uno", "it", "b"), (2, "ciao mondo " * 1000, "it", "c"), (None, "one1two_three", "en", "s1")]


def told_divergence(df):
    return Counter(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("stripe", "seat"), [(32768, 16), (5, 1), (7, 2)])
def test_divergence_equals_brute_force(spark, stripe, seat):
    rows = sources()
    assert told_divergence(divergence.divergence(docs(spark, rows), least_docs=12, top=4, stripe=stripe, seat=seat)) == brute_divergence(rows, 12, 4)


def test_every_two_seats_meet_once(spark):
    for seats in range(2, 12):
        odd = seats - (seats % 2 == 0)
        met = spark.range(seats).withColumn("seats", F.lit(seats))
        found = [(r["id"], r["other"]) for turn in range(odd) for r in met.select("id", divergence.partner(F.col("id"), F.col("seats"), turn).alias("other")).collect() if r["other"] < seats and r["other"] != r["id"]]
        assert Counter(found) == Counter((a, b) for a in range(seats) for b in range(seats) if a != b)


def test_divergence_of_long_texts_and_nothing(spark):
    assert divergence.divergence(docs(spark, sources()).where("false")).collect() == []
    data = ("wort " * 70_000 + "é" * 1_500_000 + " ende").encode()
    assert b"".join(divergence.windows(data, 1000)) == data
    assert Counter(t for w in divergence.windows(data, 1000) for t in divergence.TERM.findall(w)) == Counter(divergence.TERM.findall(data))
    assert divergence.shares(np.array([8 * 10**15, 5]), 9 * 10**15).tolist() == [1 + 10**9 * 8 // 9, 1]


# Token alignment


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    level = token_alignment.byte_level()
    of_a = lambda i: bytes(level[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    linked, digests = [], []
    for _, text, *_ in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if b"".join(map(of_a, ids_a)) != (" " + (text or "")).encode() or b"".join(map(of_b, ids_b)) != (" " + (text or "")).encode():
            ids_a = ids_b = []
        spans = []
        for ids, of in ((ids_a, of_a), (ids_b, of_b)):
            ends = np.cumsum([len(of(i)) for i in ids]).tolist()
            spans.append([(e - len(of(i)), e, i) for i, e in zip(ids, ends, strict=True)])
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e]
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [tuple([i for s, e, i in side if low < e <= high] for side in spans) for low, high in zip([0, *cuts], cuts, strict=False)]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        linked.append(links)
        digests.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(text.encode()).hexdigest() if ids_a else ""))
    n = Counter(pair for links in linked for pair in set(links))
    best = defaultdict(int)
    for (x, _), count in n.items():
        best[x] = max(best[x], count)
    out = Counter((i, n_a, n_b, g, len(links), sum(n[p] == best[p[0]] for p in links), sum(n[p] for p in links), sha) for (i, *_), links, (n_a, n_b, g, sha) in zip(rows, linked, digests, strict=True))
    return out, {(x, y, c, c == best[x]) for (x, y), c in n.items()}


TEXTS = [
    "a quick brown fox", "A quick  brown fox\njumps over\n\nthe lazy dog ", " leading", "\nleading line", "\t tab", "trailing ", "two  ", " ", "  ", "\n", "naïve café 日本語 😀", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "word▁mark", "▁", "a\rb\r\nc", "nbsp here   wide", "\x00\x01 control", "x\x1c y", "don't I'll we've 12345 6.7e-8", "é Å ﬁ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "-- == !!! ... \n ... ", None, "",
    "ZWJ 👩‍👩‍👧 ", "﻿bom", "http://x.y/z?q=1&r=2#f", "   many   spaces   ", "\n \n  \n", "a \n b", "a\n b", "a\t\tb",
]


def told_alignment(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_alignment_equals_brute_force(spark):
    rng = random.Random(9)
    words = "the of and Haus été niño 42 x_y (z) 中 foo-bar".split()
    texts = TEXTS + [rng.choice((" ", "  ", "\n")).join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + TEXTS[:3]
    rows = [(k if k % 9 else None, t, "en", "s") for k, t in enumerate(texts)] + [(3, "again", "en", "s")] * 2
    want, pairs = brute_alignment(rows)
    assert told_alignment(token_alignment.aligned(docs(spark, rows), A, B)) == want
    assert {tuple(r) for r in token_alignment.pair_table(docs(spark, rows), A, B).collect()} == pairs
    assert token_alignment.aligned(docs(spark, rows).where("false"), A, B).collect() == []


def test_alignment_with_small_tables_and_many_parts(spark, monkeypatch):
    """Workers import the module anew, so limits are passed on by the closures of the driver alone
    for what is read there; the parts of a stripe are."""
    monkeypatch.setattr(token_alignment, "PART_BYTES", 64)
    rows = [(k, f"{'word ' * (k % 7)}number {k} of many, {k * 37 % 11} été", "en", "s") for k in range(1200)]
    assert told_alignment(token_alignment.aligned(docs(spark, rows).repartition(5), A, B)) == brute_alignment(rows)[0]


def test_chunks_are_tokenized_like_whole_texts():
    own, rng = token_alignment.aligner(A, B), random.Random(4)
    alphabet = ["a", "B", "the", "1", "é", "日", " ", " ", "  ", "\n", "\t", "'s", ".", "!", "\r", " ", "😀", "_"]
    assert own.cuts
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25)))
        chunks = own.chunks(text)
        assert "".join(chunks) == " " + text
        assert [i for c in own.a.encode_batch_fast(chunks, add_special_tokens=False) for i in c.ids] == own.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for ids in own.ids_b(chunks) for i in ids] == own.b.encode(text)


def test_worker_forgets_and_still_aligns(monkeypatch):
    own, fresh = token_alignment.Aligner(A, B), token_alignment.Aligner(A, B)
    monkeypatch.setattr(token_alignment, "CHUNKS_KEPT", 12)
    for k in range(60):
        texts = [f"some words {k} été", "", "b" * 100, "words▁mark x"]
        slots = own.placed(texts)
        own.uses.values[:] += np.bincount([s for of in slots for s in of], minlength=own.uses.n)
        assert [len(s) for s in slots] == [4, 0, 1, 2] and len(own.strings) < 20 and " " + "b" * 100 not in own.slots
        fresh.forget()
        for mine, want in zip(slots, fresh.placed(texts), strict=True):
            for i, j in zip(mine, want, strict=True):
                for one, at in ((own, i), (fresh, j)):
                    assert one.strings[at].count(b";") + bool(one.strings[at]) == one.sizes.values.reshape(-1, 4)[at, 2]
                assert own.strings[i] == fresh.strings[j] and (own.sizes.values.reshape(-1, 4)[i] == fresh.sizes.values.reshape(-1, 4)[j]).all()
                assert own.links.values[own.ends.values[i] : own.ends.values[i + 1]].tolist() == fresh.links.values[fresh.ends.values[j] : fresh.ends.values[j + 1]].tolist()
    assert " some" in own.slots and " words" in own.slots
