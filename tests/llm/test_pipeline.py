"""The pipeline's stages on a small table, each on what the one before it kept."""

import corpus_pipeline
import pytest
from tsforge.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    text = lambda k, n=60: " ".join(words[(k * 37 + j * j) % 400] for j in range(n))
    item = text(77, 20)
    rows = [(i, f"{text(i)}\n{text(i + 100)}\n{text(i + 200)}") for i in range(30)]
    rows += [(40, rows[0][1]), (41, rows[1][1].replace("\n", " ") + " end"), (42, f"{text(300)} {item} {text(301)}"), (43, "12 34 !!"), (44, None), (45, text(302) + "\n" + rows[2][1])]
    table = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialize(stage(spark, docs, folder), f"test{n}")
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        kept.append({r["doc_id"] for r in out.select("doc_id").collect()})
        docs = out
    every = {*range(30), 40, 41, 42, 43, 44, 45}
    assert kept[0] == every - {43, 44} and kept[1] == kept[0] - {40} and kept[2] == kept[1] - {41} and kept[3] == kept[2] - {42} == kept[4]
    assert corpus_pipeline.run(spark, folder).count() == len(kept[4])


def test_one_long_line_between_other_lines_goes(spark, folder):
    line = "this notice of nine words stands in every document"
    rows = [(i, f"first {i}\n{line}\nlast {i}", "en", "src0", 1) for i in range(3)] + [(3, line, "en", "src0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, folder).collect()}
    assert got == {0: rows[0][1], 1: "first 1\nlast 1", 2: "first 2\nlast 2"}


def test_judgments_of_one_row_leave_namesakes(spark, folder):
    kept = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 30").collect()]
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = lambda stage, bad: sorted((r["doc_id"] or -1, r["text"]) for r in stage(spark, spark.createDataFrame(kept + bad, schema), folder).collect())
    want = sorted((r[0] or -1, r[1]) for r in kept)
    assert texts(corpus_pipeline.identify_language, [(None, "12 34 !!", "en", "src0", 8), (3, "56 78 ??", "en", "src1", 8)]) == want
    assert texts(corpus_pipeline.drop_contaminated, [(None, f"x {item} y", "en", "src0", 9), (3, f"z {item} y", "en", "src1", 9)]) == want


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got, want = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(ORACLE_SQL[name]).df()
    order = sorted(want.columns)
    text = lambda df: df[order].astype(str).replace("None", "nan").sort_values(order).reset_index(drop=True)
    assert sorted(got.columns) == order and text(got).equals(text(want))
