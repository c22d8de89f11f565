"""The driver contract: names, the flagship query, and the queries against their SQL on the smallest tables."""

import os
import random

import pytest

import __spark_entry__ as entry
from charterloom.plans.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 20 and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)


def clean(value):
    return round(value, 6) if isinstance(value, float) else tuple(map(clean, value)) if isinstance(value, list) else value


def rounded(rows):
    return sorted(repr(tuple(clean(v) for v in r)) for r in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rounded(got.select(*columns).collect()) == rounded(expected)


@needs_data
def test_dense_corpus_holds_the_stored_scores(spark):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    expected = con.execute(f"SELECT i, j, score FROM ({entry.oracle_sql()['similarity_dense_corpus']})").fetchall()
    got = entry.queries()["similarity_dense_corpus"](spark, FOLDER).select("i", "j", "score").collect()
    assert rounded(got) == rounded(expected) and any(0 < r["score"] < 1 for r in got)


def token_table(spark, folder, texts):
    """``tokenized_corpus`` of the texts, in a folder of its own."""
    rows = [(k, list(text)) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_idx bigint, tokens array<string>").selectExpr("*", "timestamp '2024-01-01 00:00:00' AS tokenized_at").coalesce(1).write.parquet(f"{folder}/tokenized_corpus.parquet")
    return str(folder)


def sql_rows(name, folder, columns):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW tokenized_corpus AS SELECT * FROM '{folder}/tokenized_corpus.parquet/*.parquet'")
    return con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()


def test_pairs_above_hold_copies(spark, tmp_path):
    folder = token_table(spark, tmp_path, ["abcdefgh", "abcdefgh", "abcdefgx", "klmnopqr", "abcdefgh", "abc", "abc"])
    got = [tuple(r) for r in entry.queries()["cosine_above"](spark, folder).select("i", "j", "score").collect()]
    assert {(i, j) for i, j, s in got if s == 1} == {(0, 1), (0, 4), (1, 4)}
    assert rounded(got) == rounded(sql_rows("cosine_above", folder, ["i", "j", "score"]))


def test_top_pairs_hold_copies(spark, tmp_path):
    folder = token_table(spark, tmp_path, ["abcdefgh", "abcdefgh", "abcdefgx", "klmnopqr", "abcdefgh", "abc", "abc"])
    got = [tuple(r) for r in entry.queries()["topk_pairs"](spark, folder).select("i", "j", "score").collect()]
    assert [(i, j) for i, j, _ in got[:3]] == [(0, 1), (0, 4), (1, 4)] and len(got) == 6
    assert rounded(got) == rounded(sql_rows("topk_pairs", folder, ["i", "j", "score"]))


@pytest.mark.parametrize("copies", [3, 8])
def test_top_pairs_of_many(spark, tmp_path, copies):
    rng = random.Random(copies)
    texts = ["".join(rng.choices("abcd", k=rng.randint(5, 30))) for _ in range(40)] + ["abcdefghij"] * copies
    folder = token_table(spark, tmp_path, texts)
    got = [tuple(r) for r in entry.queries()["topk_pairs"](spark, folder).select("i", "j", "score").collect()]
    assert len(got) == 20 and rounded(got) == rounded(sql_rows("topk_pairs", folder, ["i", "j", "score"]))


def test_copies_only_count_in_frequencies(spark, tmp_path):
    folder = token_table(spark, tmp_path, ["abcdefgh", "abcdefgh", "abcdefgx", "klmnopqr", "xbcdefgh", "abc", "abc"])
    got = [tuple(r) for r in entry.queries()["cosine_intra"](spark, folder).select("i", "j", "score").collect()]
    assert {(i, j) for i, j, _ in got} == {(0, 2), (0, 4), (2, 4)}
    assert rounded(got) == rounded(sql_rows("cosine_intra", folder, ["i", "j", "score"]))


@needs_data
def test_all_pairs_are_not_summed_by_shuffle(spark):
    """A product row for every common feature of a pair went through a shuffle."""
    plan = entry.queries()["cosine_intra"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_cutoff_writes_no_pairs(spark, tmp_path):
    from charterloom.plans import materialize as M

    rng = random.Random(5)
    folder = token_table(spark, tmp_path, ["".join(rng.choices("abc", k=rng.randint(3, 25))) for _ in range(30)])
    before = set(M._written)
    got = entry.queries()["pipeline_cutoff"](spark, folder).select("diagonal", "n_pairs", "threshold", "n_kept").collect()
    assert not any(p.endswith("/pairs") for p in M._written - before)
    assert rounded(got) == rounded(sql_rows("pipeline_cutoff", folder, ["diagonal", "n_pairs", "threshold", "n_kept"]))


@pytest.mark.parametrize("name", ["tfidf_weights", "cosine_above"])
def test_postings_are_not_written(spark, tmp_path, name):
    from charterloom.plans import materialize as M

    folder = token_table(spark, tmp_path, ["abcdefgh", "abcdefgh", "abcdefgx", "klmnopqr"])
    spark.createDataFrame([(100, list("abcdefyz"))], "doc_idx bigint, tokens array<string>").write.parquet(f"{folder}/formulary.parquet")
    before = set(M._written)
    assert entry.queries()[name](spark, folder).count() > 0
    assert not any(p.endswith(("/postings", "/weights")) for p in M._written - before)
