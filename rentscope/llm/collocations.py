"""Phrase collocations from a weighted de Bruijn graph.

Nodes are phrases of LONGEST - 1 words, edges those of LONGEST; an edge's weight
is its count. Only edges are counted, and what of a piece has no edge to go on:
a node's flow is the weight of its edges out plus the pieces that end there, and
so on down to single words. Paths without branches are compacted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.llm.common import segments, written
from rentscope.plans import top_k_per_group

#: Words of the longest phrase; least count of a candidate; percent of its count that drops what a longer one holds; rows a language.
LONGEST, LEAST, PERCENT, FIRST = 3, 10, 50, 2000
#: Characters of text handled at a time; windows whose hashes are counted together.
CHUNK, WINDOWS = 1 << 21, 1 << 22
#: Bits of a phrase's cell; cells are counted in blocks by the leading BLOCK_BITS.
CELL_BITS, BLOCK_BITS = 32, 10
#: Bits of a filter sent to every task: so many for each frequent cell, and most of all.
FILTER_SHARE, FILTER_MOST = 32, 1 << 27

#: Ends a piece, a text: bytes that no UTF-8 text holds.
STOP = b"\xff"
#: Where a long text may be cut: no word crosses it.
_WHITE = re.compile(r"[\x20\x09-\x0D]")
_SPLIT = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class Numbers(dict):
    """Numbers words in the order seen."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Windows:
    """The words of a chunk of texts: number, language and distance to the piece's end of each.

    ``starts`` tells the words whose windows are this chunk's: the last words of
    a text that goes on in the next chunk open that one.
    """

    def __init__(self, words: list[bytes], langs: np.ndarray, goes_on: bool, longest: int):
        number = Numbers()
        number[STOP]  # number 0
        self.ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        self.names, self.langs = list(number), langs
        n = len(words)
        stops = np.append(np.flatnonzero(self.ids == 0), n)
        self.left = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
        self.starts = (self.ids != 0) & (np.arange(n) < n - (longest - 1 if goes_on else 0))
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.names], np.uint64)
        self.hash = hashes[self.ids]

    def cells(self, at: np.ndarray, size: int, lang_hash: np.ndarray) -> np.ndarray:
        """The cell of the phrase of ``size`` words at each of ``at``."""
        x = lang_hash[self.langs[at]] + sum(self.hash[at + k] * _MIX[k] for k in range(size))
        x = (x ^ (x >> np.uint64(31))) * _MIX[3]
        x = (x ^ (x >> np.uint64(30))) * _MIX[4]
        return (x >> np.uint64(64 - CELL_BITS)).astype(np.uint32)

    def keys(self, at: np.ndarray, size: int) -> np.ndarray:
        """A number for each phrase, equal for equal ones and different for others."""
        out = self.langs[at].astype(np.int64)
        for k in range(size):
            _, dense = np.unique(out, return_inverse=True)
            out = dense * len(self.names) + self.ids[at + k]
        return out


def windows(langs: Iterable[str], texts: list[str], longest: int) -> Iterator[tuple[Windows, list[str]]]:
    """(words, names of languages) of the texts, a chunk at a time."""
    langs = list(langs)
    known = sorted(set(langs))
    number = {x: k for k, x in enumerate(known)}
    parts = segments(texts, CHUNK, _WHITE)
    held: list[bytes] = []
    part = next(parts, None)
    while part:
        after = next(parts, None)
        goes_on = after is not None and after[0][0] == part[-1][0]
        words, sizes = held, []
        for k, (i, piece) in enumerate(part):
            before = len(words) if k else 0
            words += piece.encode().lower().translate(_SPLIT).replace(b"\n", b" \xff ").split()
            if not (goes_on and k == len(part) - 1):
                words.append(STOP)
            sizes.append((number[langs[i]], len(words) - before))
        codes, n = np.array(sizes, np.int64).T
        yield Windows(words, np.repeat(codes, n), goes_on, longest), known
        held, part = words[len(words) - longest + 1 :] if goes_on else [], after


def _hashes(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in names], np.uint64)


class Filter:
    """Whether a cell may be a frequent phrase's: never no for one that is."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint32(CELL_BITS - (8 * len(bits)).bit_length() + 1)

    def has(self, cells: np.ndarray) -> np.ndarray:
        at = cells >> self.shift
        return (self.bits[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & 1).astype(bool)


def _passing(w: Windows, names: list[str], filters: list[Filter]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each size that has a filter, whether a frequent phrase of it may start at each word; hashes of languages."""
    lang_hash = _hashes(names)
    n = len(w.ids)
    out = [np.ones(n + 1, bool)]
    out[0][:n] = w.ids != 0
    out[0][n] = False
    for size, f in enumerate(filters, 1):
        ok = np.zeros(n + 1, bool)
        # Both parts that are a word shorter must be frequent, and the piece long enough.
        at = np.flatnonzero(out[-1][:n] & (w.left >= size) & (out[-1][1:] if size > 1 else True))
        ok[at] = f.has(w.cells(at, size, lang_hash))
        out.append(ok)
    return out, lang_hash


def frequent_cells(docs: DataFrame, filters: list, least: int, longest: int) -> Filter:
    """The filter of the phrases of one word more than ``filters`` are for.

    A task counts cells WINDOWS at a time and hands on the sorted distinct ones,
    a row a block; a block has a fixed number of cells, which one task adds up
    in an array. The driver receives the filter's bits alone.
    """
    spark, least = docs.sparkSession, min(least, 100)  # counts are bytes; a lower limit passes more, never less
    sent = [spark.sparkContext.broadcast(f.bits) for f in filters]
    size, inside = len(filters) + 1, CELL_BITS - BLOCK_BITS

    def count(batches):
        own, held, n = [Filter(b.value) for b in sent], [], 0

        def told():
            cells, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            counts = np.minimum(counts, least).astype(np.uint8)
            cuts = np.searchsorted(cells, np.arange(1 << BLOCK_BITS, dtype=np.uint64) << np.uint64(inside)).tolist() + [len(cells)]
            rows = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in rows], pa.int64()), pa.array([cells[a:b].tobytes() for _, a, b in rows], pa.binary()), pa.array([counts[a:b].tobytes() for _, a, b in rows], pa.binary())], ["block", "cells", "counts"]
            )

        for batch in batches:
            for w, names in windows(batch.column(0).to_pylist(), batch.column(1).to_pylist(), longest):
                passing, lang_hash = _passing(w, names, own)
                ok = w.starts & (w.left >= size) & passing[-1][:-1]
                if size > 1:
                    ok &= passing[-1][1:]
                held.append(w.cells(np.flatnonzero(ok), size, lang_hash))
                n += len(held[-1])
                if n > WINDOWS:
                    yield told()
                    n = 0
        if n:
            yield told()

    def add(batches):
        block, total = None, None

        def told():
            some = np.flatnonzero(total >= least).astype(np.uint32)
            return pa.RecordBatch.from_pylist([{"block": block, "n": len(some), "cells": some.tobytes()}])

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    if block is not None:
                        yield told()
                    block, total = row["block"], np.zeros(1 << inside, np.uint8)
                at = np.frombuffer(row["cells"], np.uint32) & np.uint32((1 << inside) - 1)
                total[at] = np.minimum(total[at] + np.frombuffer(row["counts"], np.uint8), least)
        if block is not None:
            yield told()

    chunks = docs.mapInArrow(count, "block long, cells binary, counts binary")
    blocks = chunks.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, n long, cells binary")
    blocks = written(blocks, "frequent-cells")
    n = blocks.agg(F.sum("n")).first()[0] or 0
    size_bits = max(1 << (BLOCK_BITS + 3), min(FILTER_MOST, 1 << max(0, FILTER_SHARE * n - 1).bit_length()))
    each = size_bits >> BLOCK_BITS  # bits of a block's part

    def fold(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bits = np.zeros(each, np.uint8)
                bits[np.frombuffer(row["cells"], np.uint32) >> np.uint32(inside - each.bit_length() + 1)] = 1
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "bits": np.packbits(bits, bitorder="little").tobytes()}])

    out = np.zeros(size_bits // 8, np.uint8)
    for row in blocks.mapInArrow(fold, "block long, bits binary").toLocalIterator():
        out[row["block"] * each // 8 :][: each // 8] = np.frombuffer(row["bits"], np.uint8)
    return Filter(out)


def graph_counts(docs: DataFrame, filters: list[Filter], longest: int) -> DataFrame:
    """lang, phrase, size, n: for each word of a text the longest phrase that starts there and may be frequent.

    Phrases of ``longest`` words are edges; shorter ones end a piece, or go on
    to a phrase that is surely rare, which is taken for its end. The row with
    size 0 has the words of a language.
    """
    sent = [docs.sparkSession.sparkContext.broadcast(f.bits) for f in filters]

    def count(batches):
        own = [Filter(b.value) for b in sent]
        for batch in batches:
            for w, names in windows(batch.column(0).to_pylist(), batch.column(1).to_pylist(), longest):
                passing, _ = _passing(w, names, own)
                some = np.flatnonzero(w.starts)
                totals = np.bincount(w.langs[some], minlength=len(names))
                out = [[names[k], "", 0, int(totals[k])] for k in np.flatnonzero(totals)]
                lang, phrase, sizes, n = (list(x) for x in zip(*out)) if out else ([], [], [], [])
                best = np.zeros(len(w.ids), np.int64)
                for size in range(1, longest + 1):
                    best[passing[size][:-1]] = size
                for size in range(1, longest + 1):
                    at = np.flatnonzero(w.starts & (best == size))
                    _, first, counts = np.unique(w.keys(at, size), return_index=True, return_counts=True)
                    at = at[first]
                    parts = [[w.names[i] for i in w.ids[at + k].tolist()] for k in range(size)]
                    phrase += [b" ".join(x).decode() for x in zip(*parts)]
                    lang += [names[i] for i in w.langs[at].tolist()]
                    sizes += [size] * len(at)
                    n += counts.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(sizes, pa.int32()), pa.array(n, pa.int64())], ["lang", "phrase", "size", "n"])

    counts = docs.mapInArrow(count, "lang string, phrase string, size int, n long")
    return counts.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def _head(n: int, phrase: str = "phrase"):
    return F.substring_index(phrase, " ", n)


def _tail(n: int, phrase: str = "phrase"):
    return F.substring_index(phrase, " ", -n)


class PhraseGraph:
    """The frequent part of the graph of ``docs`` (text, lang): counts that reach ``least`` are exact.

    ``totals``: lang, n, the words of a language. ``words``: lang, phrase, f of
    single words. ``nodes``: lang, phrase, f of phrases of LONGEST - 1 words.
    ``edges``: lang, phrase, f of LONGEST words, with source, target and their
    flows source_f, target_f.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST, longest: int = LONGEST):
        if longest != 3:
            raise ValueError("phrases have three words at most")
        rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
        filters: list[Filter] = []
        for _ in range(longest):
            filters.append(frequent_cells(rows, filters, least, longest))
        counts = written(graph_counts(rows, filters, longest), "phrase-counts")
        self.least, self.longest = least, longest
        self.totals = counts.where("size = 0").select("lang", "n")
        self.words = self._flow(counts, 1)
        self.nodes = written(self._flow(counts, longest - 1), "phrase-nodes")
        edges = counts.where((F.col("size") == longest) & (F.col("n") >= least)).select("lang", "phrase", F.col("n").alias("f"), _head(longest - 1).alias("source"), _tail(longest - 1).alias("target"))
        for side in ("source", "target"):
            edges = edges.join(self.nodes.select("lang", F.col("phrase").alias(side), F.col("f").alias(f"{side}_f")), ["lang", side])
        self.edges = written(edges, "phrase-edges")

    def _flow(self, counts: DataFrame, size: int) -> DataFrame:
        """Counts of the phrases of ``size`` words: of all that starts with them, edge or end."""
        own = counts.where(F.col("size") >= size).groupBy("lang", _head(size).alias("phrase")).agg(F.sum("n").alias("f"))
        return own.where(F.col("f") >= self.least)

    def paths(self) -> DataFrame:
        """lang, phrase, f, n_edges, source, target: edges whose joints don't branch, put together.

        A node is inside a path if one edge in and one edge out have its whole
        flow: all of its occurrences come from one and go on to the other.
        Every occurrence of a path lies in one piece, so a path is no longer
        than a piece, and none is closed. Edges find the head of their path by
        doubling steps.
        """
        e = self.edges
        out = e.where("f = source_f").select("lang", F.col("source").alias("node"), F.col("phrase").alias("edge"))
        into = e.where("f = target_f").select("lang", F.col("target").alias("node"), F.col("phrase").alias("up"))
        step = written(out.join(into, ["lang", "node"]).select("lang", "edge", "up", F.lit(1).cast("long").alias("steps")), "path-steps")
        while True:
            on = step.select("lang", F.col("edge").alias("up"), F.col("up").alias("top"), F.col("steps").alias("more"))
            moved = step.join(on, ["lang", "up"], "left")
            moved = written(moved.select("lang", "edge", F.coalesce("top", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("top").isNotNull().alias("moved")), "path-steps")
            step = moved.drop("moved")
            if moved.where("moved").isEmpty():
                break
        placed = e.join(step.withColumnRenamed("edge", "phrase"), ["lang", "phrase"], "left")
        placed = placed.select("lang", F.coalesce("up", "phrase").alias("head"), F.coalesce("steps", F.lit(0)).alias("steps"), "phrase", "f", "target")
        whole = placed.groupBy("lang", "head").agg(F.min("f").alias("f"), F.count(F.lit(1)).alias("n_edges"), F.sort_array(F.collect_list(F.struct("steps", _tail(1).alias("word")))).alias("steps"), F.max_by("target", "steps").alias("target"))
        words = F.concat_ws(" ", _head(self.longest - 1, "head"), F.transform("steps", lambda s: s["word"]))
        return whole.select("lang", words.alias("phrase"), "f", "n_edges", _head(self.longest - 1, "head").alias("source"), "target")

    def candidates(self, percent: int = PERCENT) -> DataFrame:
        """lang, phrase, a and the counts around each cut: edges, and nodes that no heavy edge holds.

        Nodes inside a path have its weight and go without more ado; the rest,
        ends of paths, meet the heaviest edge beside them, which is the first
        or the last of a path.
        """
        paths = written(self.paths(), "paths")
        beside = paths.select("lang", F.explode(F.array("source", "target")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("heaviest"))
        inside = self.inside(paths)
        nodes = self.nodes.join(inside, ["lang", "phrase"], "left_anti").join(beside, ["lang", "phrase"], "left")
        nodes = nodes.where(F.col("heaviest").isNull() | (100 * F.col("heaviest") < percent * F.col("f")))
        one = self.words.select("lang", F.col("phrase").alias("word"), F.col("f").alias("word_f"))
        # Cut 1 leaves the first word alone, the last cut the last one.
        nodes = nodes.select("lang", "phrase", F.col("f").alias("a"), F.lit(None).cast("long").alias("source_f"), F.lit(None).cast("long").alias("target_f"))
        found = self.edges.select("lang", "phrase", F.col("f").alias("a"), "source_f", "target_f").unionByName(nodes)
        for end, word in (("first_f", _head(1)), ("last_f", _tail(1))):
            found = found.withColumn("word", word).join(one.withColumnRenamed("word_f", end), ["lang", "word"]).drop("word")
        return found

    def inside(self, paths: DataFrame) -> DataFrame:
        """lang, phrase: the nodes between the edges of a path."""
        words = F.split("phrase", " ")
        node = F.transform(F.sequence(F.lit(2), F.col("n_edges").cast("int")), lambda i: F.concat_ws(" ", F.slice("words", i, self.longest - 1)))
        return paths.where("n_edges > 1").withColumn("words", words).select("lang", F.explode(node).alias("phrase"))


def scored(candidates: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score by the cut that scores lowest (ties: the first); exact in decimals of 38 digits."""
    exact = lambda c: F.col(c).cast("decimal(15,0)")

    def cut(k: int, left: str, right: str):
        top = exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")
        score = F.call_function("div", top, exact(left) * exact(right))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    pair, triple = cut(1, "first_f", "last_f"), F.least(cut(1, "first_f", "target_f"), cut(2, "source_f", "last_f"))
    best = F.when(F.col("source_f").isNull(), pair).otherwise(triple)
    return candidates.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the collocations of each language that score highest.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces and
    those at spaces and tabs into words; a null lang is 'und', a null text
    empty. Candidates are phrases of two or three words that occur LEAST times
    in their language; one that a longer candidate holds and that occurs at most
    twice as often is dropped. ``l`` and ``r`` are the counts of the parts of
    the lowest-scoring cut, n the words of the language.

    No doc_id is needed: rows without one count, rows that repeat one count
    each; other columns are ignored; an empty table gives no row. Texts and
    pieces of any length are handled in chunks; words of any length are kept.
    """
    graph = PhraseGraph(docs)
    rows = scored(graph.candidates())
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    top = top_k_per_group(rows, ["lang"], order, first, salt_cols=["phrase"])
    out = top.join(graph.totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = """
    with texts as (
      select coalesce(lang, 'und') as lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
      from documents),
    pieces as (
      select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from texts),
    numbered as (
      select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from pieces),
    grams as (
      select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, w[i:i + k - 1] as parts
      from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i
            from numbered, (values (1), (2), (3)) as sizes(k) where len(w) >= k)),
    f as (select lang, k, phrase, any_value(parts) as parts, count(*) as f from grams group by lang, k, phrase),
    totals as (select lang, sum(f) as n from f where k = 1 group by lang),
    frequent as (select * from f where f >= 10),
    longer as (
      select lang, phrase, max(f) as heaviest from (
        select lang, array_to_string(parts[1:2], ' ') as phrase, f from frequent where k = 3
        union all select lang, array_to_string(parts[2:3], ' '), f from frequent where k = 3) group by lang, phrase),
    candidates as (
      select c.* from frequent c left join longer using (lang, phrase)
      where c.k = 3 or c.k = 2 and (heaviest is null or 100 * heaviest < 50 * c.f)),
    cuts as (
      select c.lang, c.phrase, c.f as a, cut, l.f as l, r.f as r,
             1000000::hugeint * c.f * c.f // (l.f::hugeint * r.f) as score
      from candidates c, (values (1), (2)) as cuts(cut), frequent l, frequent r
      where cut < c.k and l.lang = c.lang and l.phrase = array_to_string(c.parts[1:cut], ' ')
        and r.lang = c.lang and r.phrase = array_to_string(c.parts[cut + 1:c.k], ' ')),
    best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
    select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score
    from ranked join totals using (lang) where rank <= 2000"""
