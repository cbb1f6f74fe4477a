"""The training-data operators against brute force and round trips, on small fixtures that hold
nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tsforge.llm import ann, bpe, common, components, decontaminate, html_text, language_id, line_dedup, minhash, repeats, suffix_array, toxicity, url_rules

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, v string, h string"


def docs(spark, texts, ids=None):
    """Documents with columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s0", len(t or ""), 7, "x", "y") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "la", "mu"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(4, 12)))
    shared = [line() for _ in range(8)]
    texts = []
    for _ in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.4 else line() for _ in range(rng.randrange(1, 9))]
        texts.append("\n".join(lines))
    for k in range(0, n, 7):
        texts.append(texts[k])
        texts.append(texts[k] + " tail")
    return [*texts, None, "", "   ", "one", "One", "\n\n", "long " * 3000]


# Byte-level BPE


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library(spark, reference):
    texts = [*corpus(), "it's  two\n\n spaces ", "日本語 😀 ñandú", "a" * 300, " " * 200 + "x", "<|endoftext|>", "tab\tand\r\nline"]
    got = {r["doc_id"]: r for r in bpe.encode_texts(docs(spark, texts), RANKS, PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = reference.encode_ordinary(text or "")
        assert got[i]["token_ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    back = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode_ids(bpe.encode_texts(docs(spark, texts), RANKS, PATTERN), RANKS).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))


def test_bpe_appends_and_edits(reference):
    encoder, rng = bpe.encoder_for(RANKS, PATTERN), random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice(" \n\tabthe.é世😀1%'s") for _ in range(rng.randrange(60)))
        live = bpe.EditableEncoding(encoder, text)
        for _ in range(3):
            a = rng.randrange(len(live.text) + 1)
            live.replace(a, rng.randrange(a, min(len(live.text), a + 5) + 1), "".join(rng.choice(" \nthe's1") for _ in range(rng.randrange(4))))
        live.append(" the end")
        assert live.ids().tolist() == reference.encode_ordinary(live.text)
    table = bpe.PrefixTable(encoder.vocabulary, b"the quick brown fox " * 40)
    again = table.replace(10, 12, b"XY")
    assert table.last == bpe.PrefixTable(encoder.vocabulary, table.data).last and again < len(table.data)


# URL rules


def by_hand(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
    fits = [(h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://EXAMPLE.org/es/a", "https://a.b.example.org/en/12?x=1", "http://example.org", "http://badexample.org/es/", "x://org/", "http://a.com/de/1#q",
            "http://com/fr/", "http://a.com/es/://b.org/", "https://www.example.org/en/2", "http://example.org./es/", "a://b://c.org/"] * 3
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id long, url string, key string, host string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge_urls(pages).collect()}
    assert got == {i: by_hand(u) for i, u in enumerate(urls)}
    blocks = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge_urls(pages, block_bytes=1).collect()}
    assert blocks == got and url_rules.judge_urls(pages.limit(0)).count() == 0
    assert url_rules.judge_urls(pages, []).where("verdict <> 'allow' or rule is not null").count() == 0


# Decontamination


def edit_distance_to_substring(p, t):
    before = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        now = [i]
        for j, d in enumerate(t, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def test_myers_distance():
    rng = random.Random(2)
    for _ in range(500):
        p, t = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randrange(1, 12), rng.randrange(20)))
        assert decontaminate.Myers(p).best(t)[0] == edit_distance_to_substring(p, t)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    items = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(14)) for _ in range(12)]
    texts = corpus(n=20)
    for item in items[:9]:
        edited = list(item)
        for _ in range(rng.randrange(0, 9)):
            k = rng.randrange(len(edited))
            edited[k] = rng.choice(["", "q", edited[k] + "z"])
        texts.append("before it, " + "".join(edited).upper() + "! after it")
    table = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*items, None, "", "!!"])], "item_id long, text string, id string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(docs(spark, texts), table).collect()}
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            distance = edit_distance_to_substring(decontaminate.plain(item), decontaminate.plain(text)) if len(text or "") < 5000 else 99
            if distance <= decontaminate.budget(len(decontaminate.plain(item)), 8):
                want[d, i] = distance
    assert got == want and len(want) >= 5
    assert {(r[0], r[1]) for r in decontaminate.contaminated(docs(spark, texts), table, block_chars=100).collect()} == set(want)
    assert decontaminate.contaminated(docs(spark, texts), table.limit(0)).count() == 0


# MinHash


def near_by_hand(texts, ids, width, percent):
    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()

    sets, parent = {i: shingles(t) for i, t in zip(ids, texts, strict=True)}, {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = corpus()
    for k in range(40):  # one large group, at all distances from its middle
        words = list(base)
        for _ in range(k // 3):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    ids = [3 * i + 1 for i in range(len(texts))]
    frame = docs(spark, texts, ids).union(docs(spark, texts[:5], ids[:5])).union(docs(spark, ["lost"], [None]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, width=3, percent=85).collect()}
    assert got == near_by_hand(texts, ids, 3, 85)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_one_text_stands_for_an_id(spark):
    texts = ["a b c d e f g", "q r s t u v w", None]
    first = min(texts[:2], key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    frame = docs(spark, [*texts, first], [5, 5, 5, 9]).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame, width=3, percent=85).collect()}
    assert got == {5: (5, 5, True), 9: (5, 5, False)}


def test_blocks_find_what_pivots_leave(spark):
    rng = random.Random(6)
    texts = []
    for k in range(30):
        words = [f"w{j}" for j in range(100)]
        for _ in range(3):
            words[rng.randrange(100)] = f"y{k}{rng.randrange(99)}"
        texts.append(" ".join(words))
    ids = list(range(30))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, texts), width=3, percent=85, rounds=0).collect()}
    assert got == near_by_hand(texts, ids, 3, 85)


def test_a_hot_group_takes_few_tables(spark, monkeypatch):
    """Blocks take what the first pivots leave of a group of near copies, and settled components
    aren't formed anew: each table written costs shuffles, whatever it holds."""
    rng, written = random.Random(8), []
    texts = []
    for k in range(90):
        words = [f"w{j}" for j in range(100)]
        for _ in range(4):
            words[rng.randrange(100)] = f"z{rng.randrange(3)}"
        texts.append(" ".join(words))

    def counted(df, name, write=common.materialize):
        written.append(name)
        return write(df, name)

    monkeypatch.setattr(minhash, "materialize", counted)
    monkeypatch.setattr(components, "materialize", counted)
    monkeypatch.setattr(minhash, "STRIPE", 7, raising=False)
    found = minhash.near_duplicates(docs(spark, texts), width=3, percent=85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == near_by_hand(texts, list(range(90)), 3, 85)
    assert "open" in written
    assert written.count("pairs") == 1
    assert len(written) <= 20


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)

    def least(x):
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return min(seen)

    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: least(x) for x in near if near[x] - {x}}
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame(links, "a long, b long"), rounds=1)


def test_shared_folder(spark):
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Session)
    Session.conf = Conf({"spark.master": "local[8]"})
    assert common.shared_dir(Session) == Session.conf["spark.checkpoint.dir"]
    kept = common.materialize(spark.range(3).toDF("x"), "kept")
    assert kept.count() == 3 and common.own_dir(spark) in kept.inputFiles()[0]


# Suffix arrays and repeats


@pytest.mark.parametrize("few", [3, 1024])
def test_suffix_array_and_common_prefixes(monkeypatch, few):
    monkeypatch.setattr(suffix_array, "FEW_SYMBOLS", few)
    rng = random.Random(8)
    for _ in range(600):
        s = np.array([rng.randrange(1, rng.choice((2, 3, 5, 200))) for _ in range(rng.randrange(1, 60))])
        order = suffix_array.suffix_array(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        shared = suffix_array.common_prefixes(s.astype(np.uint16), order)
        for a, b in zip(order, order[1:], strict=False):
            assert shared[b] == next((k for k in range(len(s) - max(a, b)) if s[a + k] != s[b + k]), len(s) - max(a, b))


def test_segments_are_known_by_their_bytes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 4000).astype(np.uint8)
    twice = np.concatenate([rng.integers(97, 123, 333).astype(np.uint8), data])
    _, one, first, last = repeats.segments(data, 50)
    assert len(set(one.tolist())) == len({data[a : b + 50].tobytes() for a, b in zip(first, last, strict=True)})
    assert len(np.intersect1d(one, repeats.segments(twice, 50)[1])) >= len(one) - 2


@pytest.mark.parametrize("hot", [repeats.HOT, 8])
def test_repeats_equal_brute_force(spark, hot):
    rng = random.Random(2)
    texts = [*corpus(9), "é" * 60, "x" * 400, "x" * 90 + "é" * 60]
    passage = "".join(rng.choice("abcdefg hij") for _ in range(120))
    for k in range(30):  # one passage between different neighbours, and cut off at different places
        around = ["".join(rng.choice("abcdefg hij") for _ in range(rng.randrange(90))) for _ in range(2)]
        texts.append(around[0] + passage[rng.randrange(40) : 120 - rng.randrange(40)] + around[1])
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    frame = docs(spark, texts, ids).union(docs(spark, texts[:3], ids[:3])).union(docs(spark, [texts[0]], [None]))
    assert (len(repeats.hot_anchors(repeats.keyed(frame, "doc_id", "text"), 50, hot)) > 0) == (hot == 8)
    got = defaultdict(set)
    for r in repeats.remove_repeats(frame, hot=hot).collect():
        got[r["doc_id"]].add((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
        assert r["n_removed"] == sum(b - a for a, b in r["spans"]) and len(r["spans"]) == r["n_spans"]
    seen = set()
    for i, text in sorted(zip(ids, texts, strict=True)):
        data = (text or "").encode()
        strings = [data[k : k + 50] for k in range(len(data) - 49)]
        gone = bytearray(len(data))
        for k, s in enumerate(strings):
            if s in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(strings)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        assert got[i] == {(len(data), sum(gone), runs, bytes(c for c, g in zip(data, gone, strict=True) if not g))}
    assert got[None] == {(len(texts[0]), 0, 0, texts[0].encode())}
    assert repeats.remove_repeats(frame.limit(0)).count() == 0


# Line dedup


def test_tables_keep_their_miss_rate(spark, monkeypatch):
    class Asked(Exception):
        pass

    def asked(docs, *, rows, collections, **_):
        raise Asked(rows, collections)

    monkeypatch.setattr(minhash, "signatures", asked)
    for percent, want in ((80, 20), (85, 14)):
        with pytest.raises(Asked) as e:
            minhash.near_duplicates(docs(spark, ["a"]), percent=percent)
        rows, collections = e.value.args
        assert collections == want and 1 - (1 - (1 - (percent / 100) ** rows) ** collections) ** 2 <= 1 / 15000


def test_lines_equal_brute_force(spark):
    texts = [*corpus(11), "a line\nb line\nc line", "b line\nc line\nd", "q\n\nb line\n \nc line", "a line\nb line\na line\nb line"]
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(docs(spark, texts)).collect()}
    seen = {}
    for i, text in enumerate(texts):
        lines = [(k, x.strip(" \t\r\v\f")) for k, x in enumerate((text or "").split("\n"))]
        full, gone = [x for x in lines if x[1]], set()
        for (k, a), (m, b) in zip(full, full[1:], strict=False):
            if seen.setdefault((a, b), (i, k)) != (i, k):
                gone |= {k, m}
        want = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        assert got[i]["text"] == want and got[i]["line_dedup"]["n_removed"] == len(gone) and got[i]["h"] == "y"
    assert line_dedup.drop_repeated_lines(docs(spark, texts).limit(0)).count() == 0


def test_long_lines_count_alone(spark):
    nine, seven = "one two three four five six seven eight nine", "one two three four five six seven"
    texts = [f"a\n{nine}\nb", f"c\n \t{nine} \nd", nine, f"e\n{seven}\nf", f"g\n{seven}\nh", seven, f"{nine}\ni\n{nine}", "p q\nr s", "p q\nr s", None, ""]
    got = {r["doc_id"]: (r["text"], r["line_dedup"]["n_removed"], r["line_dedup"]["emptied"]) for r in line_dedup.drop_repeated_lines(docs(spark, texts), words=8).collect()}
    want = {i: (t, 0, False) for i, t in enumerate(texts)} | {1: ("c\nd", 1, False), 2: ("", 1, True), 6: ("i", 2, False), 8: ("", 2, True)}
    assert got == want
    texts, seen = corpus(13), {}
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs(spark, texts), words=8).collect()}
    for i, text in enumerate(texts):
        full = [(k, x.strip(" \t\r\v\f")) for k, x in enumerate((text or "").split("\n")) if x.strip(" \t\r\v\f")]
        runs = [*zip(full, full[1:], strict=False), *((x,) for x in full if len(x[1].split()) >= 8)]
        gone = {k for run in runs if seen.setdefault(tuple(x for _, x in run), (i, run[0][0])) != (i, run[0][0]) for k, _ in run}
        assert got[i] == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone))


@pytest.mark.parametrize(("window", "words"), [(2, None), (3, 4), (4, None)])
def test_runs_of_any_window_equal_brute_force(spark, window, words):
    rng = random.Random(window)
    texts = ["\n".join(rng.choice(["a", "b", "c", "d e", "one two three four", " ", "f"]) for _ in range(rng.randrange(12))) for _ in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs(spark, texts), window=window, words=words).collect()}
    seen = {}
    for i, text in enumerate(texts):
        full = [(k, x.strip()) for k, x in enumerate(text.split("\n")) if x.strip()]
        runs = [*(full[k : k + window] for k in range(len(full) - window + 1)), *([x] for x in full if words and len(x[1].split()) >= words)]
        gone = {k for run in runs if seen.setdefault(tuple(x for _, x in run), (i, run[0][0])) != (i, run[0][0]) for k, _ in run}
        assert got[i] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def test_line_dedup_takes_any_column_names(spark):
    names = ("__id", "__gone", "__key", "id", "key", "gone", "row", "lines", "line_dedup", "a.b")
    frame = docs(spark, ["x\ny", "x\ny\nz"]).select("doc_id", "text", *(F.lit(n).alias(n) for n in names))
    got = line_dedup.drop_repeated_lines(frame)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.columns == ["doc_id", "text", *(n for n in names if n != "line_dedup"), "line_dedup"]
    assert rows[1]["text"] == "z" and rows[1]["a.b"] == "a.b" and rows[1]["__gone"] == "__gone" and rows[1]["line_dedup"]["n_removed"] == 2


def test_lines_of_one_id_with_different_texts(spark):
    rows = [(1, "a\nb"), (5, "a\nb\nc"), (5, "own one\nown two\nown three"), (5, "own one\nown two\nown three"), (7, "own one\nown two\nend")]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.drop_repeated_lines(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect())
    assert got == sorted([rows[0], (5, "c"), rows[2], rows[3], (7, "end")])


# Nearest neighbours


def test_hilbert_keys_step_to_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells))) and (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_nearest(spark):
    rng = np.random.default_rng(12)
    vectors = [*(rng.normal(size=16) * rng.uniform(0.5, 2, (700, 1)))]
    vectors += [vectors[3]] * 60
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [rows[5], (900, None, 1), (920, [0.0] * 16, 1), (940, [float("nan")] * 16, 1), (960, [1.0] * 3, 1), (980, [None] * 16, 1), (None, [1.0] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, entry int")
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, window_rows=256, share=0.4, rows_together=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x, hits, total = np.array(vectors), 0, 0
    for q in range(0, len(vectors), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -np.round(scores, 9)))[:20]
        assert len(got[q]) == 20 and q not in dict(got[q]) and np.allclose([s for _, s in got[q]], [scores[v] for v, _ in got[q]])
        hits, total = hits + len({v for v, _ in got[q]} & set(best.tolist())), total + 20
    assert set(got) == set(range(0, len(vectors), 20)) and hits / total >= 0.9
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(table.where("vec_id < 5"), F.lit(True)).count() == 20


def test_nearest_ties_go_to_smaller_ids(spark):
    """Distinct vectors of one inner product with the query, more than a result holds."""
    rng = np.random.default_rng(5)
    vectors = [[1.0, 0.0, 0.0], *([1.0, *v] for v in rng.permutation([[a, b] for a in range(20) for b in range(20)][1:]).astype(float).tolist())]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = ann.nearest(table, F.col("vec_id") == 0, window_rows=1 << 20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 21)) and all(r["score"] == 1.0 for r in got)


def test_recall_over_many_blocks(spark):
    """Vectors without structure, far more than a window holds."""
    x = np.random.default_rng(6).normal(size=(6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = defaultdict(dict)
    for r in ann.nearest(table, F.col("vec_id") % 100 == 0, window_rows=128, share=0.12).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    y, hits = x.astype(float), 0
    for q in range(0, 6000, 100):
        scores = y @ y[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & set(got[q]))
        assert len(got[q]) == 20 and all(abs(scores[v] - s) < 1e-12 for v, s in got[q].items())
    assert hits / 1200 >= 0.9


# Language ID


def test_language_id(spark):
    rng = random.Random(13)
    letters = {"en": ["the", "and", "ing", "ou", "th"], "fr": ["é", "eau", "que", "oi", "les"], "de": ["sch", "ung", "ü", "ei", "der"]}
    rows = []
    for i in range(240):
        lang = list(letters)[i % 3]
        text = " ".join("".join(rng.choice(letters[lang]) for _ in range(3)) for _ in range(25))
        rows.append((i, text, "xx" if i % 17 == 0 else lang, f"h{i % 3}.{lang}.org", lang))
    rows += [(900, None, "en", "h0.en.org", None), (901, "", "en", None, None), (902, "12 34 !!", "en", None, None), (903, "é" * 5000, None, None, "fr"), (904, "th", "en", "h0.en.org", "en")]
    frame = spark.createDataFrame(rows, "id long, text string, declared string, host string, truth string")
    got = {r["id"]: r for r in language_id.identify(frame, id_col="id", declared=F.col("declared"), host=F.col("host")).collect()}
    assert all(got[i]["language"] == truth for i, *_, truth in rows if truth and i != 903)
    assert [got[i]["kept"] for i in (900, 901, 902)] == [False] * 3 and got[900]["language"] is None
    assert all(got[i]["kept"] for i in range(240))
    assert language_id.identify(frame.limit(0), id_col="id").count() == 0
    urls = spark.createDataFrame([("http://a.com/fr/x", "fr"), ("https://a.de", "de"), ("https://a.org/eng/", None), (None, None)], "u string, w string")
    assert all(r[0] == r[1] for r in urls.select(language_id.suffix_language(F.col("u")), "w").collect())


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(14)
    words = [f"w{k}" for k in range(300)]
    texts, marks = [], []
    for i in range(900):
        bad = i % 6 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))] + (["scum", "idiot"] if bad else [])
        rng.shuffle(text)
        texts.append(" ".join(text))
        marks.append((i, 1, int(bad)))
    labels = spark.createDataFrame([*marks[:600], (5000, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    frame = docs(spark, [*texts, None, ""])
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame, labels, categories).collect()}
    held = range(600, 900)
    assert np.mean([got[i]["toxic"] for i in held if marks[i][2]]) > 0.95 and np.mean([got[i]["toxic"] for i in held if not marks[i][2]]) < 0.02
    assert len(got) == 902 and not got[900]["toxic"] and not got[901]["toxic"]
    assert toxicity.toxicity(frame, labels.limit(0), categories).where("toxic or low_quality").count() == 0
    assert toxicity.toxicity(frame, labels.where("toxic = 0"), categories).where("toxic").count() == 0


def test_chain_equals_a_dense_refit(spark):
    """The same steps on a dense table of words, held-out folds included."""
    rng = random.Random(15)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.sample(words, 8) + ["bad"] * (i % 4 == 0) + ["poor"] * (i % 3 == 0)) for i in range(160)]
    marks = [(i, 1 - int(i % 3 == 0 or i % 7 == 0), int(i % 4 == 0)) for i in range(120)]
    frame, labels = docs(spark, texts), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}).collect()}

    vocabulary = sorted({w for t in texts for w in t.split()})
    assert len({int(toxicity.features(w)[0]) for w in vocabulary}) == len(vocabulary)
    x = np.array([[w in t.split() for w in vocabulary] for t in texts], float)
    y = np.array([[1 - q, t] for _, q, t in marks], float)
    folds = (np.arange(120, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(toxicity.FOLDS)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fitted(words_of, beside, label):
        share = (label.sum() + 0.5) / (len(label) + 1)
        held, ones = words_of.sum(0), words_of[label == 1].sum(0)
        ratio = np.where(held < 4, 0, np.log((ones + 0.5) / (label.sum() + 1)) - np.log((held - ones + 0.5) / (len(label) - label.sum() + 1)))
        table = np.column_stack([words_of * ratio, beside, np.ones(len(label))])
        w = np.zeros(table.shape[1])
        w[-1] = np.log(share / (1 - share))
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, 31):
            slope = table.T @ (sigmoid(table @ w) - label) / len(label)
            slope[: len(ratio)] += 3e-3 * w[: len(ratio)]
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        return lambda a, b: np.column_stack([a * ratio, b, np.ones(len(a))]) @ w

    train, beside, every = x[:120], np.zeros((120, 0)), np.zeros((160, 0))
    for k, name in enumerate(("low_quality", "toxic")):
        out = np.zeros(120)
        for fold in range(toxicity.FOLDS):
            test = folds == fold
            out[test] = fitted(train[~test], beside[~test], y[~test, k])(train[test], beside[test])
        score = fitted(train, beside, y[:, k])(x, every)
        threshold = max((2 * y[out >= t, k].sum() / ((out >= t).sum() + y[:, k].sum()), t) for t in out)
        assert all(abs(got[i][f"p_{name}"] - sigmoid(score[i])) < 1e-4 for i in range(160))
        flagged = {i for i in range(160) if got[i][name]}
        assert {i for i in range(160) if score[i] >= threshold[1] + 1e-3} <= flagged
        beside, every = np.column_stack([beside, np.clip(out, -10, 10)]), np.column_stack([every, np.clip(score, -10, 10)])


# Main text


def test_main_text(spark):
    long = "some words that make up a paragraph of fair length in the middle of the page"
    pages = [
        f"<html><head><title>no</title></head><body><nav><a href='/'>home</a></nav><div class=ad>buy it now while you can my friend</div><article><h1>Head &amp; more</h1><p>{long}<br>next&nbsp;line<p>Short.</article>"
        f"<div class='comments'><p>{long}</p></div><footer>&copy; us</footer></body></html>",
        None, "", "<script>var a = '<p>x</p>';</script>", f"<p>{long}<!-- <p>gone</p> --></p>", f"<main><p>{long}</p><form><label>Name</label><input></form><p>{long} &am", "<article>" + "<p>one</p>" * 3000 + "</article>",
        f"<article><p class='notice'>sign up now<p>{long}<ul><li class=share>tell all<li>point</ul></article>",
    ]
    frame = spark.createDataFrame([(i, "http://a.org/", p, 1) for i, p in enumerate(pages)], "page_id long, url string, html string, blocks int")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
    assert got[0] == f"Head & more\n\n{long} next line\n\nShort." and got[1] == got[2] == got[3] == ""
    assert got[4] == long and got[5] == f"{long}\n\n{long} &am" and got[6].count("one") == 3000
    assert got[7] == f"{long}\n\npoint"
    assert html_text.main_text(frame.limit(0)).count() == 0
