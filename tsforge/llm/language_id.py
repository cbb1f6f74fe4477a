"""Language ID by Bayesian evidence fusion.

What speaks for a language l: the text's likelihood under a character-trigram model of l,
P(declared | l) of the language that the markup declares, P(suffix | l) of the language that the
address suggests (a path segment or country domain), and the prior P(l | host). Priors are
smoothed in a hierarchy: a host falls back on its domain, a domain on all rows; the counts behind
them, like the tables of declared and suffix, are grouped sums of the text posteriors over all rows.

The trigram model is fitted on about ``train_rows`` rows for each declared language (a share of the
range of hashes of id and text that holds so many); everything else covers all rows. Trigrams are
hashed into a table of fixed size. A language's rates are smoothed with ``common`` trigrams spread
as all languages' together and a twentieth of one in every place, so that a language of few rows is known as well and yet doesn't draw
texts that another explains better. A text's log-likelihood counts as that of ``full_weight``
trigrams at most, so that neighbouring trigrams, which aren't independent, don't drown the other
evidence. The model holds the ``most_languages`` commonest declared languages.

Rejected are texts without letters, those less likely than even letters under every language,
and those whose best language has less than ``least`` of the posterior.

Defined results: null and empty texts are rejected with a null language, whatever else is known;
declared languages that aren't two to eight letters, null or unknown ones, suffixes and hosts say
nothing; with no labelled row at all
every language is null and every row rejected; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import materialize, sliced

BUCKETS = 1 << 15
#: Languages that country domains suggest. Fixed values.
COUNTRY = {"at": "de", "de": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def trigrams(text: str | None) -> np.ndarray:
    """Table places of the lower-cased text's trigrams; what isn't a letter counts as one space."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letters()[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    codes = np.where(alpha, codes, 32)[keep].astype(np.uint64)
    if not alpha.any():
        return np.empty(0, np.int64)
    codes = np.concatenate([[np.uint64(32)], codes])
    if len(codes) < 3:
        return np.empty(0, np.int64)
    h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)


def declared_language(value: Column) -> Column:
    name = F.lower(F.substring_index(F.substring_index(F.trim(value), "-", 1), "_", 1))
    return F.when(name.rlike("^[a-z]{2,8}$"), name)


def suffix_language(url: Column) -> Column:
    """The language that a URL suggests: its first path segment if that has two letters, else the
    one that its country domain speaks."""
    segment = F.regexp_extract(F.lower(url), r"^[^:]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1)
    country = F.regexp_extract(F.lower(url), r"^[^:]*://[^/?#]*\.([a-z]{2})(?::\d+)?(?:[/?#]|$)", 1)
    known = F.create_map(*(F.lit(x) for pair in COUNTRY.items() for x in pair))
    return F.when(segment != "", segment).otherwise(known[country])


def fit(rows: DataFrame, train_rows: int, common: float, most_languages: int) -> tuple[list[str], np.ndarray]:
    """The languages and the (BUCKETS, languages) log-probabilities. rows: id, text, declared."""
    labelled = rows.where("declared is not null and text is not null")
    sizes = {r["declared"]: r["count"] for r in labelled.groupBy("declared").count().orderBy(F.desc("count"), "declared").limit(most_languages).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((BUCKETS, 0))
    share = F.create_map(*(F.lit(x) for n in languages for x in (n, min(1.0, train_rows / sizes[n]))))
    near = (F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < share[F.col("declared")] * (1 << 20)) & F.col("declared").isin(languages)
    place = {n: i for i, n in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in sliced(batches):
            for name, text in zip(batch.column("declared"), batch.column("text"), strict=True):
                total[place[name.as_py()]] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        k, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(bucket, pa.int64()), pa.array(total[k, bucket])], names=["k", "bucket", "n"])

    counts = labelled.where(near).select("declared", "text").mapInArrow(count, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((BUCKETS, len(languages)))
    for r in counts.toLocalIterator():
        table[r["bucket"], r["k"]] = r["n"]
    every = (table.sum(axis=1, keepdims=True) + 0.05) / (table.sum() + 0.05 * BUCKETS)
    return languages, np.log((table + common * every + 0.05) / (table.sum(axis=0) + common + 0.05 * BUCKETS))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, suffix: Column | None = None,
             host: Column | None = None, train_rows: int = 1000, common: float = 2000.0, most_languages: int = 256,
             full_weight: int = 40, least: float = 0.5, smoothing: float = 20.0) -> DataFrame:
    """``id_col``, language, confidence (its posterior), text_language (the text's alone),
    n_trigrams and kept, for every row."""
    nothing = F.lit(None).cast("string")
    host_name = F.lower(host) if host is not None else nothing
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
        declared_language(declared if declared is not None else nothing).alias("declared"),
        (suffix if suffix is not None else nothing).alias("suffix"), F.coalesce(host_name, F.lit("")).alias("host"),
    )
    languages, table = fit(rows, train_rows, common, most_languages)
    id_type = rows.schema["id"].dataType.simpleString()
    if not languages:
        return rows.select(F.col("id").alias(id_col), nothing.alias("language"), F.lit(0.0).alias("confidence"), nothing.alias("text_language"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("kept"))
    size, even = len(languages), -np.log(BUCKETS)
    table32 = table.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, weights, fits = [], [], []
            for text in batch.column("text"):
                found = trigrams(text.as_py())
                total = np.zeros(size)
                for part in range(0, len(found), 1 << 16):
                    total += table32[found[part : part + (1 << 16)]].sum(axis=0, dtype=np.float64)
                mean = total / max(1, len(found))
                weight = (mean - mean.max()) * min(len(found), full_weight)
                n.append(len(found))
                weights.append(weight - np.log(np.exp(weight).sum()))
                fits.append(bool(len(found)) and mean.max() > even)
            arrays = [batch.column("id"), batch.column("declared"), batch.column("suffix"), batch.column("host")]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(n, pa.int64()), pa.array(weights, pa.list_(pa.float64())), pa.array(fits, pa.bool_())],
                names=["id", "declared", "suffix", "host", "n", "weight", "fits"],
            )

    schema = f"id {id_type}, declared string, suffix string, host string, n long, weight array<double>, fits boolean"
    scored = materialize(rows.mapInArrow(score, schema), "scored")
    every = range(size)
    names = F.array(*map(F.lit, languages))
    posterior = [F.exp(F.col("weight")[k]) for k in every]
    told = [F.sum(F.when(F.col("fits"), posterior[k]).otherwise(0.0)).alias(f"c{k}") for k in every]

    def likelihoods(column: str) -> Column:
        """log P(column | language), from the sums of text posteriors by its (known) values."""
        sums = {r[0]: [r[k + 1] for k in every] for r in scored.where(F.col(column).isin(languages)).groupBy(column).agg(*told).collect()}
        matrix = np.array([sums.get(n, [0.0] * size) for n in languages]) + 0.5
        logs = np.log(matrix / matrix.sum(axis=0))
        table = F.create_map(*(x for n, row in zip(languages, logs, strict=True) for x in (F.lit(n), F.array(*map(F.lit, row.tolist())))))
        return F.coalesce(table[F.col(column)], F.array(*[F.lit(0.0)] * size))

    # Hosts fall back on their domain (the last two labels), domains on all rows.
    by_host = materialize(scored.where("host <> ''").groupBy("host").agg(*told), "hosts").withColumn("domain", F.substring_index("host", ".", -2))
    by_domain = by_host.groupBy("domain").agg(*(F.sum(f"c{k}").alias(f"d{k}") for k in every))
    total = by_domain.agg(*(F.sum(f"d{k}") for k in every)).first()
    overall = np.array([x or 0.0 for x in total]) + 1.0
    overall = (overall / overall.sum()).tolist()

    def sum_of(prefix: str) -> Column:
        out = F.col(f"{prefix}0")
        for k in every[1:]:
            out = out + F.col(f"{prefix}{k}")
        return out

    of_domain = [(F.col(f"d{k}") + smoothing * overall[k]) / (sum_of("d") + smoothing) for k in every]
    priors = by_host.join(by_domain, "domain").select(
        "host", F.array(*(F.log((F.col(f"c{k}") + smoothing * of_domain[k]) / (sum_of("c") + smoothing)) for k in every)).alias("prior")
    )
    # Rows without a host stand outside the join, so that they don't meet on one key.
    found = ("id", "n", "fits", "weight", "prior", "declared", "suffix")
    hosted = scored.where("host <> ''").join(priors, "host").select(*found)
    alone = scored.where("host = ''").withColumn("prior", F.array(*(F.lit(float(np.log(x))) for x in overall))).select(*found)
    joined = hosted.union(alone).withColumn("by_declared", likelihoods("declared")).withColumn("by_suffix", likelihoods("suffix"))
    fused = joined.select(
        "id", "n", "fits", "weight",
        F.array(*(F.col("weight")[k] + F.col("prior")[k] + F.col("by_declared")[k] + F.col("by_suffix")[k] for k in every)).alias("all"),
    ).withColumn("top", F.array_max("all"))
    confidence = 1.0 / F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    known = F.col("n") > 0
    best = names[(F.array_position("all", F.col("top")) - 1).cast("int")]
    text_best = names[(F.array_position("weight", F.array_max("weight")) - 1).cast("int")]
    return fused.select(
        F.col("id").alias(id_col), F.when(known, best).alias("language"), F.when(known, confidence).otherwise(0.0).alias("confidence"),
        F.when(known, text_best).alias("text_language"), F.col("n").alias("n_trigrams"),
        (known & F.col("fits") & (confidence >= least)).alias("kept"),
    )
