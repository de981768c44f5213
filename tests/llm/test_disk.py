"""What the pipeline's stages shuffle and write."""

import pytest

from rentscope.llm import ngram_join, quality_rules

BOILERPLATE = "all rights are reserved by the owner of this site"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_tables(spark):
    """Joins as they are where no table is small enough to be sent unasked."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_postings_are_shuffled_once(spark, no_small_tables):
    sets = spark.createDataFrame([(1, 2, [7, 8], b"a"), (2, 2, [7, 9], b"b"), (2, 2, [7, 9], b"b")], "set_id long, n long, prefix array<long>, bitmap binary")
    rows = ngram_join.buckets(sets)
    assert plan(rows).count("Exchange hashpartitioning(gram") == 1
    got = sorted((r["gram"], r["set_id"], r["at"], bytes(r["bitmap"]), r["n_sets"]) for r in rows.collect())
    assert got == [(7, 1, 0, b"a", 3), (7, 2, 0, b"b", 3), (7, 2, 0, b"b", 3), (9, 2, 1, b"b", 2), (9, 2, 1, b"b", 2)]


def test_buckets_are_written_without_bitmaps(spark, monkeypatch):
    columns, written = {}, ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: columns.setdefault(name, df.columns) and written(df, name))
    base = [f"w{k}" for k in range(100)]
    rows = [(d, " ".join([*base[:d], f"x{d}", *base[d + 1 :]])) for d in range(1, 6)] + [(9, " ".join(f"v{k}" for k in range(50)))]
    out = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert sorted((r["doc_id"], r["component_id"]) for r in out.collect()) == [*((d, 1) for d in range(1, 6)), (9, 9)]
    assert "bitmap" in columns["sets"] and "bitmap" not in columns["buckets"]


def test_removed_lines_are_sent_to_the_texts(spark, no_small_tables, monkeypatch):
    """No shuffle of texts while the removed lines are few; the same rows where they are too many to send."""
    filler = lambda k: " ".join(f"w{k}x{j}" for j in range(14))
    rows = [(k, f"{BOILERPLATE}\n{filler(k)}" if k % 2 else filler(k), "big") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = quality_rules.passing(docs)
    assert "SortMergeJoin" not in plan(few)
    monkeypatch.setattr(quality_rules, "SENT_IDS", 99)
    many = quality_rules.passing(docs)
    assert "SortMergeJoin" in plan(many)
    want = [(k, filler(k), "big") for k in range(100)]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == want
