"""Exact de-duplication by sorting contents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rentscope.llm.common import pick, sent_if_bounded, written

#: White space that one space replaces; leading characters that the splitters compare.
SPACE = r"[\x20\x09-\x0D]+"
LEADING = 64


def _runs(batches):
    """For each sorted row its run of equal texts and whether it repeats the row before; at a run's end, its record.

    Neighbours are equal when their whole texts are. ``text`` is kept only
    where a run may go on in another partition: of its first and last run.
    """
    part = TaskContext.get().partitionId()
    run = size = head = before = -1
    text = sha = None

    def ended(last: bool) -> dict:
        edge = last or run == 0
        return {"doc_id": None, "sha": sha, "part": part, "run": run, "again": None, "head": head, "size": size, "first": run == 0, "last": last, "text": text if edge else None}

    for batch in batches:
        norm = batch.column(1)
        same = np.zeros(len(norm), bool)
        if len(norm):
            same[1:] = pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
            same[0] = text is not None and norm[0].as_py() == text
        records = []
        runs, begins = np.empty(len(norm), np.int64), np.flatnonzero(~same)
        at = np.append(begins, len(norm))
        runs[: at[0]] = run
        if at[0]:
            size += int(at[0])
        for k, begin in enumerate(begins):
            if run >= 0:
                records.append(ended(False))
            run, size = run + 1, int(at[k + 1] - begin)
            text, sha, head = norm[begin].as_py(), batch.column(2)[begin].as_py(), batch.column(0)[begin].as_py()
            runs[begin : at[k + 1]] = run
        n, ids = len(norm), batch.column(0).to_numpy()
        again = same & (np.r_[before, ids[:-1]] == ids) if n else same
        before = ids[-1] if n else before
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(np.full(n, part)), pa.array(runs), pa.array(again), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()))], schema=_SCHEMA
        )
        if records:
            yield pa.RecordBatch.from_pylist(records, schema=_SCHEMA)
    if run >= 0:
        yield pa.RecordBatch.from_pylist([ended(True)], schema=_SCHEMA)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("part", pa.int64()), ("run", pa.int64()), ("again", pa.bool_()), ("head", pa.int64()), ("size", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("text", pa.string())])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are equal when identical after each run of ASCII white space is
    replaced by one space; the smallest doc_id of equal texts stays.

    The rows are range-partitioned by sampled splitters over (leading bytes,
    digest, doc_id) and sorted there, which Spark does externally: equal texts
    lie side by side, and a group of any size spreads over as many partitions
    as it fills, since doc_id is part of the key. Whole texts of neighbours are
    compared; the first and last run of a partition are compared with those of
    the partitions beside it. No group is ever held in memory.

    Null text counts as empty. Rows that repeat both doc_id and text lie in one
    partition, side by side; they count each in group_size, and the first of
    them stays if any does. Rows without doc_id are left out; other columns are
    ignored; an empty table gives none.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text.alias("norm")).select("doc_id", "norm", F.sha2("norm", 256).alias("sha"))
    key = F.substring("norm", 1, LEADING)
    rows = rows.repartitionByRange(key, "sha", "doc_id").sortWithinPartitions(key, "sha", "norm", "doc_id")
    told = written(rows.mapInArrow(_runs, "doc_id long, sha string, part long, run long, again boolean, head long, size long, first boolean, last boolean, text string"), "runs")

    runs = told.where(F.col("head").isNotNull())
    # One or two runs a partition may go on beside it. Partitions that have rows are numbered without their texts.
    edge = runs.where("first or last").select("part", "run", "head", "size", "first", "last", "text")
    nth = edge.select("part").distinct().select("part", F.row_number().over(W.orderBy("part")).alias("nth"))
    edge = edge.join(nth, "part")
    before = edge.where("last").select((F.col("nth") + 1).alias("nth"), F.col("text").alias("text_before"))
    goes_on = F.col("first") & F.coalesce(F.col("text") == F.col("text_before"), F.lit(False))
    fresh = edge.join(before, "nth", "left").select("part", "run", "head", "size", (~goes_on).cast("long").alias("fresh"))
    chained = fresh.select("part", "run", "head", "size", F.sum("fresh").over(W.orderBy("part", "run")).alias("chain"))
    chains = chained.groupBy("chain").agg(F.min("head").alias("keep_id"), F.sum("size").alias("group_size"))
    sized = runs.where("not (first or last)").select("part", "run", F.col("head").alias("keep_id"), F.col("size").alias("group_size"))
    sized = sized.unionByName(chained.join(chains, "chain").select("part", "run", "keep_id", "group_size"))

    out = told.where(F.col("doc_id").isNotNull()).select("doc_id", "sha", "part", "run", "again").join(sized, ["part", "run"])
    kept = (F.col("doc_id") == F.col("keep_id")) & ~F.col("again")
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs``, all columns: of rows with equal texts one of those with the smallest doc_id stays.

    Ids none of whose rows stays go by id. Where an id has rows that stay and
    rows that go (it names several texts, or a row is repeated) its rows meet
    the verdicts by digest; of repeated rows that differ in other columns any
    one stays.
    """
    verdicts = written(exact_duplicates(docs), "verdicts")
    ids = verdicts.groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("some"), F.min("kept").alias("every"))
    ids = written(ids.where("not every"), "not-all-kept")
    here = docs.where(F.col("doc_id").isNotNull())
    out = here.join(sent_if_bounded(ids.select("_id")), F.col("doc_id") == F.col("_id"), "left_anti")
    mixed = ids.where("some").select("_id")
    if mixed.isEmpty():
        return out
    stays = verdicts.where("kept").join(mixed, F.col("doc_id") == F.col("_id")).select("_id", F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "), 256)
    parts = here.join(stays, (F.col("doc_id") == F.col("_id")) & (sha == F.col("_sha"))).dropDuplicates(["_id", "_sha"])
    return out.unionByName(parts.select(*docs.columns))
