"""Language ID: few labelled rows, and every source of evidence against a dense computation."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tsforge.llm import language_id

LETTERS = {"en": ["the", "and", "ing", "ou", "th"], "fr": ["é", "eau", "que", "oi", "les"], "de": ["sch", "ung", "ü", "ei", "der"]}


def text_of(rng, lang, n=25):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(3)) for _ in range(n))


def test_few_rows_of_one_language_are_judged(spark):
    rng = random.Random(1)
    rows = [(i, text_of(rng, "en"), "en") for i in range(19)] + [(19, None, "en"), (20, "", None)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), declared=F.col("lang")).collect()
    assert all(r["kept"] and r["language"] == "en" and r["confidence"] == 1.0 and r["n_trigrams"] > 0 for r in got if r["doc_id"] < 19)
    assert not any(r["kept"] for r in got if r["doc_id"] >= 19)


def test_a_rare_language_is_known_and_a_lone_label_draws_no_other_rows(spark):
    rng = random.Random(2)
    rows = [(i, text_of(rng, "en"), "en") for i in range(200)] + [(200 + i, text_of(rng, "de"), "de") for i in range(3)] + [(300, text_of(rng, "en"), "zz"), (301, text_of(rng, "de"), "not a language")]
    got = {r["doc_id"]: r["language"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), declared=F.col("lang")).collect()}
    assert all(got[i] == "en" for i in range(200)) and [got[i] for i in (200, 201, 202, 301)] == ["de"] * 4


def test_fusion_equals_a_dense_computation(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        lang = rng.choice(list(LETTERS))
        host = rng.choice([None, f"a.{lang}.org", f"b.{lang}.org", "mixed.net", "x.mixed.net"])
        suffix = rng.choice([None, lang, rng.choice(list(LETTERS)), "qq"])
        declared = rng.choice([lang, lang, None, rng.choice(list(LETTERS)), "EN-us", "??"])
        rows.append((i, text_of(rng, lang, rng.randrange(0, 12)), declared, suffix, host))
    rows += [(150, None, "fr", "fr", "a.fr.org"), (151, "12", "fr", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")
    got = {r["doc_id"]: r for r in language_id.identify(frame, declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host")).collect()}

    names = ["de", "en", "fr"]
    said = [{"EN-us": "en", "??": None}.get(r[2], r[2]) for r in rows]
    counts = np.zeros((language_id.BUCKETS, 3))
    for r, d in zip(rows, said, strict=True):
        if d and r[1] is not None:
            np.add.at(counts[:, names.index(d)], language_id.trigrams(r[1]), 1)
    every = (counts.sum(1) + 0.05) / (counts.sum() + 0.05 * language_id.BUCKETS)
    table = np.log((counts + 2000 * every[:, None] + 0.05) / (counts.sum(0) + 2000 + 0.05 * language_id.BUCKETS))
    weight, fits = [], []
    for r in rows:
        found = language_id.trigrams(r[1])
        mean = table[found].sum(0) / max(1, len(found))
        w = (mean - mean.max()) * min(len(found), 40)
        weight.append(w - np.log(np.exp(w).sum()))
        fits.append(len(found) > 0 and mean.max() > -np.log(language_id.BUCKETS))

    def sums(values):
        out = defaultdict(lambda: np.zeros(3))
        for v, w, fit in zip(values, weight, fits, strict=True):
            out[v] += np.exp(w) * fit
        return out

    hosts = [r[4] for r in rows]
    domains = [h and ".".join(h.split(".")[-2:]) for h in hosts]
    by_host, by_domain = sums(hosts), sums(domains)
    overall = sum(c for h, c in by_host.items() if h) + 1
    overall = overall / overall.sum()

    def likelihood(values):
        by = sums(values)
        matrix = np.array([by[n] for n in names]) + 0.5
        logs = np.log(matrix / matrix.sum(0))
        return [logs[names.index(v)] if v in names else np.zeros(3) for v in values]

    by_declared, by_suffix = likelihood(said), likelihood([r[3] for r in rows])
    for k, r in enumerate(rows):
        prior = overall
        if hosts[k]:
            d = (by_domain[domains[k]] + 20 * overall) / (by_domain[domains[k]].sum() + 20)
            prior = (by_host[hosts[k]] + 20 * d) / (by_host[hosts[k]].sum() + 20)
        score = weight[k] + np.log(prior) + by_declared[k] + by_suffix[k]
        p = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        one = got[r[0]]
        if not len(language_id.trigrams(r[1])):
            assert one["language"] is None and not one["kept"] and one["confidence"] == 0.0
            continue
        assert abs(one["confidence"] - p.max()) < 1e-4 and one["kept"] == bool(fits[k] and one["confidence"] >= 0.5)
        assert p.max() - np.sort(p)[-2] < 1e-3 or one["language"] == names[int(p.argmax())]
