"""The pipeline, and each of its stages, over rows with all that data may hold: nulls, empty and long texts, repeated rows,
columns with the names that the operators use inside; and over an empty table."""

from __future__ import annotations

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, body string, mark string, line string, label string, class_id string, n_lines string"
PROSE = "The committee met again on Tuesday to discuss the new railway line and the cost of the two bridges that it needs."
ITEM = "Which of the seven rivers that cross the old province is the longest one by far and why do boats avoid it"
ROWS = [
    (1, PROSE), (2, f"{PROSE} Nobody objected."), (2, f"{PROSE} Nobody objected."), (3, None), (4, ""), (5, "12 34 !!"), (6, f"Question: {ITEM}?\nThe answer is known to all who live there."),
    (None, "A document without any number that says something about the harvest of last year in the hills."), (7, "Wholly different words about gardens, bees and the honey that they make in late summer.\n" * 3),
    (8, " ".join(f"word{i} about things" for i in range(4000))), (9, "Wholly different words about gardens, bees and the honey that they make in late summer."),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en" if i != 8 else None, "s" if i != 7 else None, len(t or ""), *["x"] * 7) for i, t in ROWS]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_over_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda i: (i is not None, i))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, folder)
        kept[name] = ids(done)
        if name != "tokens":
            assert done.columns == docs.columns
    assert kept["language"] == [None, 1, 2, 2, 6, 7, 8, 9]
    assert kept["lines"] == ids(docs) == kept["tokens"]
    assert kept["near_duplicates"] == [None, 1, 3, 5, 6, 7, 8, 9]
    assert kept["benchmark"] == [None, 1, 2, 2, 3, 4, 5, 7, 8, 9]
    lines = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.lines_once(spark, docs, folder).collect()}
    assert lines[3] == ("", 0) and lines[9] == ("", 0) and lines[7][0].count("honey") == 1 and lines[1] == (PROSE, len(PROSE))


def test_run_over_odd_rows_and_an_empty_table(spark, folder, tmp_path):
    found = corpus_pipeline.run(spark, folder).collect()
    ids = [r["doc_id"] for r in found]
    assert None in ids and {1, 7, 8} <= set(ids) and not {3, 4, 5, 6} & set(ids)
    assert all(r["n_tokens"] == len(r["ids"]) for r in found)
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
