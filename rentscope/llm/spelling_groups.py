"""Spelling variants: words one edit apart, found through pivotal grams.

Every word picks two disjoint rare bigrams, its pivots. One edit spares one of
them, so of two near words one has a pivot among the other's rarest grams, at
most one place away.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.llm.common import SEGMENT, pick, ragged, segments, written

#: Least code points and occurrences of a word, one run in how many is changed, what makes a form.
LEAST, TWICE, DIVISOR, FACTOR = 7, 2, 31, 10
#: Letters in a gram, edits, grams in a prefix.
Q, EDITS = 2, 1
PREFIX = Q * EDITS + 1
#: Words of this length and more share a length class; it bounds the table of class sizes.
LENGTHS = 64
#: Rows of each side that meet in one cell; rows and pairs that a task looks at together; words it counts before it hands on.
CELL, ROWS, PAIRS, HELD = 2000, 100_000, 1 << 19, 400_000

#: Words are Latin-1 bytes: a byte a code point, in code-point order.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Where a long text may be cut: no run crosses it.
_OUTSIDE = re.compile("[^A-Za-z\u00C0-\u00FF]")
_BIT = np.array([1 << (c - 97) if 97 <= c <= 122 else 1 << (26 + (c - 0xC0) % 38) if c >= 0xC0 else 0 for c in range(256)], np.uint64)


def runs(text: str) -> list[bytes]:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased."""
    return text.encode("latin-1", "replace").lower().translate(_LETTERS).split()


def variant(run: bytes, start: int) -> bytes:
    """``run``, or, where the checksum of '<doc_id>:<run>' says so, less one letter; ``start``: that of '<doc_id>:'."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % DIVISOR:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (Latin-1 bytes), n: every distinct word that is long and frequent enough, counted over all texts.

    A task hands on its counts whenever it holds HELD words; Spark adds them up.
    """

    def count(batches):
        held: dict[bytes, int] = {}

        def told():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            starts = [zlib.crc32(b"%d:" % i) for i in batch.column(0).to_pylist()]
            for part in segments(["" if t is None else t for t in batch.column(1).to_pylist()], SEGMENT, _OUTSIDE):
                for i, piece in part:
                    for run, n in Counter([x for x in runs(piece) if len(x) >= LEAST]).items():
                        word = variant(run, starts[i])
                        if len(word) >= LEAST:
                            held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield told()
        if held:
            yield told()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    counts = rows.mapInArrow(count, "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TWICE)


class Grams:
    """The bigrams of some words: code, position and word of each, in order."""

    def __init__(self, words: list[bytes]):
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.letters = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(self.lengths) - self.lengths
        at = ragged(starts, self.lengths - 1)
        self.owner = np.repeat(np.arange(len(words)), self.lengths - 1)
        self.pos = at - starts[self.owner]
        self.code = self.letters[at].astype(np.int64) << 8 | self.letters[at + 1]


def gram_frequencies(words: DataFrame) -> np.ndarray:
    """Occurrences of each bigram in ``words``; the alphabet bounds it to 65,536 numbers."""

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(Grams(batch.column(0).to_pylist()).code, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    out = np.zeros(1 << 16, np.int64)
    for row in words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row["gram"]] = row["n"]
    return out


def pivots(pos: list[int], weight: list[int], n: int = EDITS + 1) -> tuple[int, ...]:
    """Which ``n`` disjoint grams have the least total weight; ``pos`` ascends.

    Dynamic programming: the best choice of j among the first i grams either
    leaves out the i-th or adds it to the best j - 1 among those that end before it.
    """
    best: list[tuple[float, tuple[int, ...]]] = [(0, ())] * (len(pos) + 1)
    for _ in range(n):
        new: list[tuple[float, tuple[int, ...]]] = [(float("inf"), ())]
        free = 0  # grams that end before the i-th
        for i, p in enumerate(pos):
            while pos[free] <= p - Q:
                free += 1
            new.append(min(new[-1], (best[free][0] + weight[i], best[free][1] + (i,))))
        best = new
    return best[-1][1]


_POSTING = "gram long, class long, pivot boolean, pos long, word binary, n long, last long, first_gram long, first_pos long"
_NAMES = [x.split()[0] for x in _POSTING.split(", ")]


def postings(words: DataFrame, frequency: np.ndarray) -> DataFrame:
    """A row for each gram of a word's prefix, and for each of its pivots.

    Grams are ordered rare first; a prefix is a word's first PREFIX grams and
    what ties with the last of them, ``last`` that gram's place in the order.
    ``first_gram``, ``first_pos``: the pivot before this one (-1 for the first).
    """
    order = np.empty(len(frequency), np.int64)
    order[np.lexsort((np.arange(len(frequency)), frequency))] = np.arange(len(frequency))

    def post(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(0).to_pylist()
            g = Grams(words)
            place = order[g.code]
            by = np.lexsort((place, g.owner))
            first = np.cumsum(g.lengths - 1) - (g.lengths - 1)
            last = place[by][first + PREFIX - 1]
            kept = np.flatnonzero(place <= last[g.owner])
            owner, pos, code = g.owner[kept], g.pos[kept], g.code[kept]
            bounds = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
            places, weights = pos.tolist(), frequency[code].tolist()
            chosen, before = [], []
            for a, b in zip(bounds, bounds[1:]):
                picked = [a + k for k in pivots(places[a:b], weights[a:b])]
                chosen += picked
                before += [-1, *picked[:-1]]
            chosen, before = np.array(chosen, np.int64), np.array(before, np.int64)
            at = np.r_[np.arange(len(kept)), chosen]
            none, is_pivot = np.full(len(kept), -1), np.arange(len(at)) >= len(kept)
            own = owner[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(code[at]), pa.array(np.minimum(g.lengths[own], LENGTHS)), pa.array(is_pivot), pa.array(pos[at]), batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(last[own]),
                    pa.array(np.r_[none, np.where(before < 0, -1, code[before])]), pa.array(np.r_[none, np.where(before < 0, -1, pos[before])]),
                ],
                _NAMES,
            )

    return words.select("word", "n").mapInArrow(post, _POSTING)


def cells(posted: DataFrame) -> DataFrame:
    """The postings dealt into cells (gram, class, i, j) in which pivots meet prefix grams of their length, give or take one.

    A pivot goes to the classes beside its own. Where a gram and class have more
    than CELL rows of a side, that side is dealt by the word's hash, and the
    other side's rows go to each of its parts: every two rows meet in one cell.
    """
    prefix = posted.where("not pivot")
    beside = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.least(F.col("class") + d, F.lit(LENGTHS))))
    asked = posted.where("pivot").withColumn("class", F.explode(beside))
    by = ["gram", "class"]
    parts = lambda name: F.ceil(F.count(F.lit(1)) / CELL).cast("long").alias(name)
    # At most a row for each bigram of the alphabet and length class: small for any input.
    sizes = F.broadcast(prefix.groupBy(*by).agg(parts("rows")).join(asked.groupBy(*by).agg(parts("columns")), by))
    own = lambda n: F.pmod(F.xxhash64("word"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = prefix.join(sizes, by).withColumn("i", own("rows")).withColumn("j", every("columns"))
    dealt = dealt.unionByName(asked.join(sizes, by).withColumn("j", own("columns")).withColumn("i", every("rows")))
    key = [*by, "i", "j"]
    return dealt.select(*key, *[c for c in _NAMES if c not in by]).repartition(*key).sortWithinPartitions(*key)


def _near(a: bytes, b: bytes) -> bool:
    """Whether two different words are one edit apart."""
    n = min(len(a), len(b))
    k = next((i for i in range(n) if a[i] != b[i]), n)
    return a[k + 1 :] == b[k + (len(a) == len(b)) :] if len(a) >= len(b) else a[k:] == b[k + 1 :]


class Meeting:
    """Rows of whole cells, of which it tells the near pairs."""

    def __init__(self, rows: pa.Table):
        col = {name: rows.column(name).to_numpy() for name in rows.column_names if name not in ("word", "pivot")}
        self.words: list[bytes] = rows.column("word").to_pylist()
        self.gram, self.first_gram, self.first_pos = col["gram"], col["first_gram"], col["first_pos"]
        key = np.stack([col[c] for c in ("gram", "class", "i", "j")])
        self.cell = np.r_[0, np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))]
        number = {w: k for k, w in enumerate(sorted(set(self.words)))}
        self.number = np.array([number[w] for w in self.words], np.int64)
        self.pos, self.last = col["pos"], col["last"]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        letters = np.frombuffer(b"".join(self.words), np.uint8)
        starts = np.cumsum(self.lengths) - self.lengths
        self.parity = np.bitwise_xor.reduceat(_BIT[letters], starts)
        self.ahead, self.back = (np.zeros((len(self.words), LENGTHS), np.uint8) for _ in range(2))
        n = np.minimum(self.lengths, LENGTHS)
        at, row = ragged(np.zeros(len(n), np.int64), n), np.repeat(np.arange(len(n)), n)
        self.ahead[row, at] = letters[starts[row] + at]
        self.back[row, at] = letters[(starts + self.lengths)[row] - 1 - at]
        pivot = rows.column("pivot").to_numpy()
        self.asking, self.listed = np.flatnonzero(pivot), np.flatnonzero(~pivot)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pivot rows, prefix rows) of a cell whose grams lie one place apart at most; PAIRS or so at a time."""
        width = int(self.pos.max(initial=0)) + 3
        key = self.cell * width + self.pos + 1
        listed = self.listed[np.argsort(key[self.listed], kind="stable")]
        low = np.searchsorted(key[listed], key[self.asking] - EDITS, "left")
        n = np.searchsorted(key[listed], key[self.asking] + EDITS, "right") - low
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            yield np.repeat(self.asking[at:to], n[at:to]), listed[ragged(low[at:to], n[at:to])]
            at = to

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of near words, each pair of words once in all cells."""
        found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in self.candidates():
            ok = np.bitwise_count(self.parity[a] ^ self.parity[b]) <= 2 * EDITS  # an edit changes two letters' parity at most
            a, b = a[ok], b[ok]
            # The word whose prefix ends first in the order asks; if both end alike, the smaller one.
            ok = (self.last[a] < self.last[b]) | (self.last[a] == self.last[b]) & (self.number[a] < self.number[b])
            ok &= np.abs(self.lengths[a] - self.lengths[b]) <= EDITS
            a, b = a[ok], b[ok]
            shorter, longer = np.minimum(self.lengths[a], self.lengths[b]), np.maximum(self.lengths[a], self.lengths[b])
            same = sum(np.minimum(self.equal(m[a], m[b]), shorter) for m in (self.ahead, self.back))
            ok = same >= longer - 1
            for k in np.flatnonzero(longer > LENGTHS):
                ok[k] = _near(self.words[a[k]], self.words[b[k]])
            a, b = a[ok], b[ok]
            # A pair that the word's first pivot finds too is told in that one's cell.
            again = np.zeros(len(a), bool)
            for k in np.flatnonzero((self.first_gram[a] >= 0) & (self.first_gram[a] != self.gram[a])):
                gram, at = int(self.first_gram[a[k]]).to_bytes(2, "big"), int(self.first_pos[a[k]])
                again[k] = gram in self.words[b[k]][max(0, at - EDITS) : at + EDITS + Q]
            found_a.append(a[~again])
            found_b.append(b[~again])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        _, one = np.unique(np.stack([self.cell[a], self.number[a], self.number[b]]), axis=1, return_index=True)
        return a[one], b[one]

    @staticmethod
    def equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Leading equal letters of the rows."""
        differ = x != y
        return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


def _whole_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of about ROWS, none of which ends inside a cell."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = np.stack([table.column(c).to_numpy() for c in ("gram", "class", "i", "j")])
        inside = np.flatnonzero((key[:, :-1] == key[:, -1:]).all(axis=0))
        cut = int(inside[0]) if len(inside) else len(key[0]) - 1
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        n = table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: both directions of every pair of ``words`` (word, n) that one edit sets apart, each once."""
    posted = written(postings(words, gram_frequencies(words)), "postings")

    def meet(batches):
        for table in _whole_cells(batches):
            m = Meeting(table)
            a, b = m.near()
            left, right = (pa.array(np.r_[x, y]) for x, y in ((a, b), (b, a)))
            word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
            yield pa.RecordBatch.from_arrays([word.take(left), word.take(right), n.take(right)], ["word", "near", "near_n"])

    return cells(posted).mapInArrow(meet, "word binary, near binary, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that forms (word, form) lead to from each.

    A form is FACTOR times as frequent, so a path has a few words; every round
    halves what is left of it.
    """
    found = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = found.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        stepped = written(stepped, "roots")
        found = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return found


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts of ``docs``.

    Words: maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, some
    less one letter as ``variant`` says, of LEAST code points that occur TWICE
    or more in all texts together. n_near counts the words one insertion,
    deletion or replacement away; the one of largest n (ties: the smallest) is
    the form if it is FACTOR times as frequent; root is the end of the forms.

    Text that is null or has no such run gives no word; rows without doc_id are
    left out; rows that repeat a doc_id count each; other columns are ignored;
    an empty table gives no row. Words of any length are compared whole. Work
    after counting grows with the pairs of words that share a rare gram at the
    same place, memory of a task with CELL.
    """
    words = written(word_counts(docs), "words")
    # Smallest struct: largest n, then smallest word.
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= FACTOR * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    joined = written(joined, "forms")
    out = joined.join(_roots(joined.where("form is not null")), "word", "left")
    spelled = lambda c: F.decode(c, "ISO-8859-1")
    return out.select(spelled(F.col("word")).alias("word"), spelled(F.col("form")).alias("form"), spelled(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")
