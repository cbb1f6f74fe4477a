"""Texts of some megabytes, beside nulls and empty texts, through each operator on documents."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tsforge.llm import bpe, decontaminate, language_id, line_dedup, minhash, repeats, toxicity, url_rules

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SIZE = 3_000_000


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    lines, size = [], 0
    while size < SIZE:
        lines.append(" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))))
        size += len(lines[-1]) + 1
    whole = "\n".join(lines)
    return [whole, None, "", "short text", whole[: SIZE // 2] + "\nan own end of it", "é" * (SIZE // 10)]


@pytest.fixture(scope="module")
def frame(spark, texts):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id long").repartition(3).cache()


def test_bpe(texts, frame):
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for r in bpe.encode_texts(frame.where("doc_id <> 5"), RANKS, PATTERN, with_ids=False).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_decontamination(spark, texts, frame):
    item = " ".join(texts[0].split()[200_000:200_040])
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    assert {(r["doc_id"], r["distance"]) for r in decontaminate.contaminated(frame, items).collect()} == {(0, 0)} | ({(4, 0)} if item.split()[-1] in texts[4] and item in " ".join(texts[4].split()) else set())


def test_near_duplicates(texts, frame):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, width=3, percent=85).collect()}
    words = texts[0].split()
    assert got[0] == (len({tuple(words[k : k + 3]) for k in range(len(words) - 2)}), 0) and got[1] == (0, 1) and got[5] == (1, 5) and got[4][1] == 4


def test_repeats(texts, frame):
    got = {r["doc_id"]: r for r in repeats.remove_repeats(frame, with_text=False).collect()}
    assert got[0]["n_removed"] == 0 and got[0]["n_bytes"] == len(texts[0]) and got[1]["n_bytes"] == got[2]["n_bytes"] == 0
    assert got[4]["n_removed"] >= SIZE // 2 and got[5]["n_removed"] == 0


def test_lines(texts, frame):
    got = {r["doc_id"]: (r["text"], r["line_dedup"]["n_lines"]) for r in line_dedup.drop_repeated_lines(frame).collect()}
    cut = texts[4].split("\n")[-2]
    assert got[0] == (texts[0], texts[0].count("\n") + 1) and got[4][0] == f"{cut}\nan own end of it" and got[1][0] is None


def test_language_and_toxicity(spark, frame):
    judged = {r["doc_id"]: r for r in language_id.identify(frame, declared=F.col("lang")).collect()}
    assert judged[0]["kept"] and judged[0]["n_trigrams"] > 10**6 and not judged[1]["kept"] and not judged[2]["kept"]
    labels = spark.createDataFrame([(0, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(frame, labels, {"toxic": F.col("toxic")}).count() == 6


def test_addresses(spark):
    long = "http://" + "a." * 50_000 + "example.org/es/" + "x" * SIZE
    pages = spark.createDataFrame([(0, long), (1, None), (2, "http://example.com" + "/y" * SIZE)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages).collect()}
    assert got == {0: ("example.org/es/", "block"), 1: (None, "allow"), 2: (None, "allow")}
