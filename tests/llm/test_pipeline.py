"""The pipeline's stages against brute force over their own inputs, and the registered SQL."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rentscope.llm import common
from rentscope.llm.queries import ORACLE, QUERIES
from scripts.check_oracle import canon, duck
from tests.conftest import SF01
from tests.llm.test_operators import SPACE, brute_cleaned, brute_components, expected_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "keep_id"]


@pytest.fixture(scope="module")
def steps(spark):
    """Each stage's input and output over documents with a few more rows and a clashing column."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    more = [(5000, None, "en", "src1", 0), (5001, "", None, None, 0), (5002, "12 34", "en", "src1", 5), (None, "the words of no id " * 9, "en", "src1", 9)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("keep_id", F.lit("x"))
    out, docs = [], common.written(docs, "documents")
    for name, stage in corpus_pipeline.STAGES:
        made = common.written(stage(spark, docs, SF01), name)
        out.append((name, docs, made))
        docs = made
    return out


def pairs_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None)


def test_stages_keep_the_columns(steps):
    assert [name for name, _, _ in steps] == ["language_id", "quality_rules", "exact_dedup", "ngram_join", "packing"]
    assert all(made.columns == COLUMNS for _, _, made in steps[:-1])


def test_language_stage(steps):
    _, docs, made = steps[0]
    assert [i for i, _ in pairs_of(docs) if i not in dict(pairs_of(made))] == [5000, 5001, 5002]
    assert made.where("doc_id is null").count() == 0


def test_rules_stage(steps):
    """Documents that the rules reject go; the others lose the lines that their host repeats."""
    _, docs, made = steps[1]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want = brute_cleaned(rows)
    assert pairs_of(made) == sorted((i, t) for i, t, kept in want if kept)
    changed = {i for (i, t, _), (_, left, kept) in zip(rows, want) if kept and t != left}
    assert len(changed) > 50
    assert all(r["n_chars"] == len(r["text"]) for r in made.collect() if r["doc_id"] in changed)


def test_exact_stage(steps):
    _, docs, made = steps[2]
    first: dict[str, int] = {}
    for i, t in pairs_of(docs):
        first.setdefault(SPACE.sub(" ", t), i)
    assert [i for i, _ in pairs_of(made)] == sorted(first.values())


def test_near_stage(steps):
    _, docs, made = steps[3]
    assert [i for i, _ in pairs_of(made)] == [i for i, _, c in brute_components(pairs_of(docs), 5, 80) if i == c]


def test_packing_stage(steps):
    _, docs, made = steps[4]
    flat = np.concatenate([ids for _, ids in expected_ids(pairs_of(docs), "byte_bpe_50k.json", 0)])
    rows = sorted(made.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in rows:
        assert r["sequence_id"] * 1024 + r["offset"] == at
        assert zlib.crc32(flat[at : at + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"]
        at += r["length"]
    assert at == len(flat)


def test_run_applies_the_stages(spark):
    """run() gives the pieces of the documents that brute force leaves after all stages but the learned one."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    left = corpus_pipeline.recognise_language(spark, docs, SF01)
    rows = [(i, t) for i, t, kept in brute_cleaned([(r["doc_id"], r["text"], r["source"]) for r in left.collect()]) if kept]
    first: dict[str, int] = {}
    for i, t in sorted(rows):
        first.setdefault(SPACE.sub(" ", t), i)
    rows = [(i, t) for i, t in sorted(rows) if i in set(first.values())]
    stay = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    want = [(i, len(ids)) for i, ids in expected_ids([x for x in rows if x[0] in stay], "byte_bpe_50k.json", 0)]
    got = corpus_pipeline.run(spark, SF01).groupBy("doc_id").agg(F.max("doc_tokens").alias("n"), F.sum("length").alias("sum"))
    assert sorted((r["doc_id"], r["n"]) for r in got.collect() if r["n"] == r["sum"]) == want


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF01), "empty")
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_their_sql(spark, name):
    df = QUERIES[name](spark, SF01)
    result = duck(SF01).execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(result.fetchall(), columns)
