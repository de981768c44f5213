"""Similarity self-join of documents on word n-grams; of 3 words and a Jaccard of 0.9 or more unless told otherwise.

Rare-first prefix filtering with length, positional and suffix (parity bitmap)
filters; pairs are joined on prefix grams and verified on whole sets, each once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rentscope.llm.common import Words, in_worker, keeping, pick, segments, sent_if_bounded, written
from rentscope.llm.components import connected_components

#: Words in a gram (five at most); least similarity in percent: the query's.
GRAM, PERCENT = 3, 90
#: Cells of the frequency sketch that orders grams (4 bytes each; sent to every task), and its row blocks.
CELL_BITS, BLOCKS = 21, 64
#: Bits of a set's parity bitmap.
BITMAP = 1024
#: Sets of one gram that are compared in one go; pairs looked at together.
BUCKET, PAIRS = 1024, 200_000

#: Words whose hashes a worker remembers.
KEPT = 100_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _hash_words(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[3]
    x = (x ^ (x >> np.uint64(27))) * _MIX[4]
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: list[str | None], gram: int = GRAM) -> Iterator[np.ndarray]:
    """The sorted distinct gram hashes of each text.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a
    text of fewer words than a gram has is one gram, one without words none.
    """
    words = in_worker("gram words", lambda: Words(_hash_words, KEPT))
    waiting: list[np.ndarray] = []
    at = 0

    def made() -> np.ndarray:
        h = np.concatenate(waiting) if waiting else np.empty(0, np.uint64)
        waiting.clear()
        if len(h) < gram:
            return _mixed((h * np.array(_MIX[: len(h)], np.uint64)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h))) if len(h) else h
        n = len(h) - gram + 1
        return np.unique(_mixed(sum(h[k : k + n] * _MIX[k] for k in range(gram))))

    for part in segments(["" if t is None else t for t in texts]):
        pieces = [piece.encode().lower().split() for _, piece in part]
        hashes = words.of([w for p in pieces for w in p])
        ends = np.cumsum([len(p) for p in pieces])
        for (i, _), own in zip(part, np.split(hashes, ends[:-1])):
            while at < i:
                yield made()
                at += 1
            waiting.append(own)
    if texts:
        yield made()


def least_overlap(total, percent: int = PERCENT):
    """Grams that two sets of ``total`` grams together must share."""
    return -((-percent * total) // (100 + percent))


def _rows(doc_ids: pa.Array, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids, *columns.values()], ["doc_id", *columns])


def frequency_sketch(docs: DataFrame, gram: int = GRAM) -> np.ndarray:
    """How many documents hold the grams of each hash cell, as a logarithm in 16 bits: a fixed size for any input.

    It only orders grams, rare ones first; any order gives the same result.
    """
    size = (1 << CELL_BITS) // BLOCKS

    def count(batches):
        cells, held, n = np.zeros(1 << CELL_BITS, np.int64), [], 0
        for batch in batches:
            for s in gram_sets(batch.column(0).to_pylist(), gram):
                held.append((s >> np.uint64(64 - CELL_BITS)).astype(np.int64))
                n += len(s)
                if n > 1 << 20:
                    cells += np.bincount(np.concatenate(held), minlength=len(cells))
                    held, n = [], 0
        if held:
            cells += np.bincount(np.concatenate(held), minlength=len(cells))
        for k in range(BLOCKS):
            yield pa.RecordBatch.from_pylist([{"block": k, "cells": cells[k * size : (k + 1) * size].tobytes()}])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["cells"], np.int64)
                total[row["block"]] = total.get(row["block"], 0) + own
        for k, own in total.items():  # all of a block is here: only its logarithms go to the driver
            yield pa.RecordBatch.from_pylist([{"block": k, "cells": (np.log2(1 + own) * 1024).astype(np.uint16).tobytes()}])

    schema = "block long, cells binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros(1 << CELL_BITS, np.uint16)
    for row in parts.toArrow().to_pylist():
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["cells"], np.uint16)
    return out


def describe(docs: DataFrame, sketch: np.ndarray, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, set_id, prefix, bitmap of each document.

    ``set_id`` names the set, so equal sets have one. ``prefix`` holds the
    grams, rarest first, of which two linked sets share one at least. Bit b of
    ``bitmap`` is the parity of the grams with hash b: the bits in which two
    bitmaps differ are never more than the grams in which the sets do.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def each(batches):
        order = shared.value
        for batch in batches:
            n, ids, prefixes, maps = [], [], [], []
            for s in gram_sets(batch.column(1).to_pylist(), gram):
                n.append(len(s))
                if not len(s):
                    ids.append(None), prefixes.append([]), maps.append(None)
                    continue
                key = (order[s >> np.uint64(64 - CELL_BITS)].astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16))
                most = len(s) - (percent * len(s) + 99) // 100 + 1
                ids.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                prefixes.append(s[np.argsort(key, kind="stable")[:most]].view(np.int64))
                odd = np.bincount((s & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1
                maps.append(np.packbits(odd.astype(bool)).tobytes())
            yield _rows(batch.column(0), n=pa.array(n, pa.int64()), set_id=pa.array(ids, pa.int64()), prefix=pa.array(prefixes, pa.list_(pa.int64())), bitmap=pa.array(maps, pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, n long, set_id long, prefix array<long>, bitmap binary")


def _buckets(batches) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a bucket (gram, i) does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        if table.num_rows < 4 * BUCKET:
            continue
        g, i = (table.column(k).to_numpy() for k in ("gram", "i"))
        last = np.flatnonzero((g != g[-1]) | (i != i[-1]))
        if len(last):
            yield table.slice(0, last[-1] + 1)
            held = table.slice(last[-1] + 1).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _likely(table: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (a, b) of one bucket that the length, positional and bitmap filters let pass.

    ``a`` comes before ``b`` in the bucket. There is nothing to look for within
    a label, or between two sets that are both guests from other blocks.
    """
    g, i, block, n, at, label = (table.column(k).to_numpy() for k in ("gram", "i", "block", "n", "at", "label"))
    native = i == block
    maps = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(len(g), BITMAP // 64)
    fresh = np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(g))[np.cumsum(fresh) - 1]
    partners = ends - np.arange(len(g)) - 1
    until = np.cumsum(partners)
    row = 0
    while row < len(g):
        stop = max(row + 1, int(np.searchsorted(until, (until[row - 1] if row else 0) + PAIRS, "right")))
        own = partners[row:stop]
        a = np.repeat(np.arange(row, stop), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        row = stop
        pass_ = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (label[a] != label[b])
        pass_ &= native[a] | native[b]
        a, b = a[pass_], b[pass_]
        need = least_overlap(n[a] + n[b], percent)
        pass_ = np.minimum(n[a] - at[a], n[b] - at[b]) >= need  # at the first gram that both prefixes hold
        a, b, need = a[pass_], b[pass_], need[pass_]
        pass_ = np.bitwise_count(maps[a] ^ maps[b]).sum(axis=1, dtype=np.int64) <= n[a] + n[b] - 2 * need
        yield a[pass_], b[pass_]


_ROWS = "gram long, i int, block int, blocks int, set_id long, n long, at int, bitmap binary, label long"
_KEPT = [x.split()[0] for x in _ROWS.split(", ")]
#: What is written of a bucket's rows; bitmaps come back to those that meet again.
_WRITTEN = ["gram", "block", "blocks", "set_id", "n", "at", "hook"]


def _hook(batches, percent: int):
    """The rows that have a likely partner, or that other blocks of the bucket may have, each with the first such set."""
    for table in _buckets(batches):
        ids = table.column("set_id").to_numpy()
        first = np.full(len(ids), len(ids))
        useful = table.column("blocks").to_numpy() > 1
        for a, b in _likely(table, percent):
            np.minimum.at(first, b, a)
            useful[a] = useful[b] = True
        hook = pa.array(ids[np.minimum(first, len(ids) - 1)], mask=first == len(ids)) if len(ids) else pa.nulls(0, pa.int64())
        yield from table.append_column("hook", hook).filter(pa.array(useful)).combine_chunks().to_batches()


def _pairs(batches, percent: int):
    for table in _buckets(batches):
        ids = table.column("set_id").to_numpy()
        for a, b in _likely(table, percent):
            x, y = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
            own = np.unique(np.stack([x, y], axis=1), axis=0) if len(x) else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], ["x", "y"])


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.select(*_KEPT).repartition("gram", "i").sortWithinPartitions("gram", "i", "set_id")


def bitmaps(sets: DataFrame) -> DataFrame:
    """set_id, bitmap: one row a set, however often a document is repeated."""
    return sets.select("set_id", "bitmap").dropDuplicates(["set_id"])


def buckets(sets: DataFrame) -> DataFrame:
    """The postings of grams that more than one set has in its prefix, hot grams dealt over blocks of sets.

    Postings are the bulk of what is shuffled: they move once, and are counted where they arrive.
    """
    postings = sets.select("set_id", "n", F.posexplode("prefix").alias("at", "gram"))
    shared = postings.withColumn("n_sets", F.count(F.lit(1)).over(W.partitionBy("gram"))).where("n_sets > 1")
    rows = shared.join(bitmaps(sets), "set_id")
    blocks = F.ceil(F.col("n_sets") / BUCKET).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    return rows.withColumns({"i": F.col("block"), "label": F.col("set_id")})


def relabelled(rows: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one label.

    The sets of a bucket's most frequent label stay in their own block; the
    others are guests in every other block too. So two sets of different labels
    meet in a block, and a group that is one component already costs a row a set.
    """
    rows = rows.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left")
    rows = rows.withColumn("label", F.coalesce("label", "set_id"))
    held = rows.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("n_held"))
    mixed = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n_labels"), F.max_by("label", F.struct("n_held", "label")).alias("main"))
    rows = rows.join(mixed.where("n_labels > 1"), "gram").join(bitmaps(sets), "set_id")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    return rows.withColumn("i", F.explode(F.when(F.col("label") == F.col("main"), F.array("block")).otherwise(every)))


def verified(docs: DataFrame, first_docs: DataFrame, pairs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Those of the distinct ``pairs`` (x, y) whose whole sets are similar enough."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("set_id")).distinct()
    wanted = written(first_docs.join(ids, "set_id"), "wanted")

    def sets(batches):
        for batch in batches:
            own = list(gram_sets(batch.column(0).to_pylist(), gram))
            ids = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["set_id", "grams"])

    texts = docs.join(sent_if_bounded(wanted.select(F.col("first_doc").alias("doc_id")).distinct()), "doc_id", "left_semi").select("text")
    grams = written(texts.mapInArrow(sets, "set_id long, grams binary").where("set_id is not null"), "grams")
    grams = grams.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"])

    def compare(batches):
        for batch in batches:
            links = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(a) + len(b) - len(np.union1d(a, b))
                links.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(links, pa.bool_()))

    rows = pairs.join(grams.select(F.col("set_id").alias("x"), F.col("grams").alias("of_x")), "x").join(grams.select(F.col("set_id").alias("y"), F.col("grams").alias("of_y")), "y")
    return written(rows.select("x", "y", "of_x", "of_y").mapInArrow(compare, "x long, y long"), "links")


def similar_documents(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each document.

    Two documents link when 100 * intersection >= ``percent`` * union of their
    sets of grams of ``gram`` words; component_id is the smallest doc_id reachable by links.

    Equal sets are one node. Sets are dealt by their prefix grams; a bucket's
    likely pairs are found by the filters. First each set is verified against
    one likely partner a bucket, twice over, which joins nearly all of a large
    group of near copies without its pairs; then every likely pair that still
    lies in two components is verified. So no link between components is lost
    and the pairs within one are never made. A gram that very many sets hold is
    dealt over blocks of sets, first each by itself; then sets outside the
    gram's largest component visit every block.

    Null and empty texts and those of white space alone have no grams and are
    components of their own. Rows without doc_id are left out; a doc_id that
    repeats has a row for each; other columns are ignored; an empty table gives
    none.
    """
    if not 1 <= gram <= len(_MIX):
        raise ValueError("no hashes for grams of so many words")

    def hook(batches):
        return _hook(batches, percent)

    def likely(batches):
        return _pairs(batches, percent)

    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    told = written(describe(docs, frequency_sketch(docs, gram), gram, percent), "sets")
    known = told.where("set_id is not null")
    first = written(known.groupBy("set_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs")), "first")
    copied = first.where("n_docs > 1").select("set_id", "first_doc")
    copies = known.select("set_id", "doc_id").join(copied, "set_id").where("doc_id > first_doc").select("set_id", "doc_id").distinct()
    sets = known.join(sent_if_bounded(copies), ["set_id", "doc_id"], "left_anti").select("set_id", "n", "prefix", "bitmap")
    first_docs = first.select("set_id", "first_doc")

    rows = written(_by_bucket(buckets(sets)).mapInArrow(hook, f"{_ROWS}, hook long").select(*_WRITTEN), "buckets")
    tried = written(rows.where("hook is not null").select(F.least("set_id", "hook").alias("x"), F.greatest("set_id", "hook").alias("y")).distinct(), "pairs")
    labels = connected_components(verified(docs, first_docs, tried, gram, percent))
    for again in (True, False):
        mixed = _by_bucket(relabelled(rows.drop("hook"), labels, sets))
        if again:
            found = mixed.mapInArrow(hook, f"{_ROWS}, hook long").where("hook is not null").select(F.least("set_id", "hook").alias("x"), F.greatest("set_id", "hook").alias("y"))
        else:
            found = mixed.mapInArrow(likely, "x long, y long")
        found = written(found.distinct().join(tried, ["x", "y"], "left_anti"), "pairs")
        if found.isEmpty():
            continue
        links = verified(docs, first_docs, found, gram, percent)
        tried = tried.unionByName(found)
        if not links.isEmpty():  # what is connected already goes on as stars, which settle in fewer rounds
            labels = connected_components(links.unionByName(labels.select(F.col("node").alias("x"), F.col("label").alias("y"))))

    joined = labels.join(first_docs.select(F.col("set_id").alias("node"), "first_doc"), "node")
    least = joined.groupBy("label").agg(F.min("first_doc").alias("least"))
    component = joined.join(least, "label").select(F.col("node").alias("set_id"), "least")
    out = told.select("doc_id", "n", "set_id").join(first_docs, "set_id", "left").join(component, "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "first_doc", "doc_id").alias("component_id"))


def without_near_duplicates(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """``docs`` less all but the smallest doc_id of each component; all columns stay."""
    return keeping(docs, similar_documents(docs, gram, percent).select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("kept")))


SQL = r"""
    with recursive split as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') as w
      from documents where doc_id is not null),
    grams as (
      select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
               else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g
      from split),
    sizes as (select doc_id, count(*) as n from grams group by doc_id),
    shared as (
      select a.doc_id as x, b.doc_id as y, count(*) as k
      from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
    links as (
      select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y
      where 100 * k >= 90 * (a.n + b.n - k)),
    reached as (
      select doc_id, doc_id as r from split
      union
      select doc_id, y from reached join links on x = r)
    select doc_id, coalesce(n, 0) as n_shingles, min(r) as component_id
    from reached left join sizes using (doc_id) group by doc_id, n"""
