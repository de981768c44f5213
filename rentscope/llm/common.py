"""Shared pieces: scratch tables, the worker cache, bounded text segments, interned words."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentscope.session import configure, ensure_checkpoint_dir

#: Characters of text handled at a time inside a task.
SEGMENT = 1 << 20
#: Distinct words a worker remembers before it starts afresh.
WORDS_KEPT = 600_000
#: New words whose rows are made in one go, which takes far more memory than the rows do.
FILLED = 4096

_BREAK = re.compile(r" (?=\S)")


#: Rows of text that go to a Python worker at a time, where the session doesn't say.
ARROW_ROWS = "500"


def configured(spark: SparkSession) -> SparkSession:
    """The session with the library's settings, and ARROW_ROWS where it has none of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if configure(spark).conf.get(key, None) is None:
        spark.conf.set(key, ARROW_ROWS)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configured(spark).read.parquet(f"{sf_dir}/documents.parquet")


def pick(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of the rows that have a doc_id; other columns are left behind."""
    return docs.select(*columns).where(F.col("doc_id").isNotNull())


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later jobs read it, lost executors recompute nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand what the allocators keep for later back to the machine: an executor's workers share its memory with the JVM."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def in_worker(key, make: Callable):
    """What ``make`` returns, kept by the Python worker process until another key is asked for.

    A worker outlives its task and serves other operators; it holds the tables of one at a time,
    and gives the memory of the others back before it makes new ones.
    """
    held = sys.modules.setdefault("_llm_worker", types.ModuleType("_llm_worker"))
    if getattr(held, "key", None) != key:
        held.key = held.value = None
        gc.collect()  # tables and what fills them refer to each other
        give_back()
        held.key, held.value = key, make()
    return held.value


def held_out(divisor: int, remainder: int):
    """crc32(doc_id as text) mod ``divisor`` = ``remainder``."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor == remainder


def segments(texts: Iterable[str], limit: int = SEGMENT, cut_at: re.Pattern = _BREAK) -> Iterator[list[tuple[int, str]]]:
    """(text number, piece) in lists of about ``limit`` characters.

    A longer text is cut before a match of ``cut_at``: a single space that a
    non-space follows, unless told otherwise, so no word is split; a word longer
    than ``limit`` stays whole.
    """
    out: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            cut = cut_at.search(text, at + limit) if len(text) - at > limit else None
            piece = text[at:cut.start()] if cut else text[at:]
            out.append((i, piece))
            size += len(piece)
            if size >= limit:
                yield out
                out, size = [], 0
            if not cut:
                break
            at = cut.start()
    if out:
        yield out


class Words(dict):
    """Numbers words in the order seen and keeps one row of figures for each.

    ``fill`` takes a list of new words and returns their rows, an array whose
    first axis is the words. The first ``kept`` words are remembered, which are
    the frequent ones; others are filled anew by each call. When many of a
    call's words are others, the text has changed and numbering starts afresh.
    """

    def __init__(self, fill: Callable[[list[str]], np.ndarray], kept: int = WORDS_KEPT):
        super().__init__()
        self.fill, self.kept, self.new, self.rows, self.used = fill, kept, [], None, 0

    def __missing__(self, word):
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def of(self, words: list) -> np.ndarray:
        """The row of each word."""
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if not self.new and self.rows is None:
            return self.fill([])
        for k in range(0, len(self.new), FILLED):
            made = self.fill(self.new[k : k + FILLED])
            need = self.used + len(made)
            if self.rows is None or need > len(self.rows):
                grown = np.empty((need + need // 2 + 1024, *made.shape[1:]), made.dtype)
                if self.used:
                    grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : need] = made
            self.used = need
        out = self.rows[ids]
        if self.new:
            if len(self.new) > FILLED:
                give_back()
            self.trim(len(words))
        return out

    def trim(self, n_words: int) -> None:
        """After a call: forget what goes beyond ``kept``, or all if that was a third of the call's words."""
        self.used = len(self)
        if len(self) > self.kept:
            if 3 * len(self.new) > n_words:
                self.clear()
            else:
                for word in self.new[len(self.new) - (len(self) - self.kept) :]:
                    del self[word]
            self.used = len(self)
        self.new = []


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs (start, length), one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def sums_by(ids: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` (rows) by id."""
    if values.ndim == 1:
        return np.bincount(ids, weights=values, minlength=n)
    return np.stack([np.bincount(ids, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of ``rows`` at most, those whose hashed doc_id is smallest; all if there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.xxhash64("doc_id") < F.lit(int((most / n - 0.5) * 2**64)))


#: Ids that are sent to every task at most; beyond it Spark joins by shuffle.
SENT_IDS = 1_000_000


def sent_if_bounded(ids: DataFrame, most: int = SENT_IDS) -> DataFrame:
    """``ids`` marked for broadcast if a count shows ``most`` rows at most."""
    return F.broadcast(ids) if ids.count() <= most else ids


def keeping(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``docs``, all columns, less the doc_ids that ``verdicts`` (doc_id, kept) reject.

    Rows that repeat a doc_id stay together if one of them is kept; rows
    without doc_id go.
    """
    gone = written(verdicts.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("_gone")), "gone")
    return docs.where(F.col("doc_id").isNotNull()).join(sent_if_bounded(gone), F.col("doc_id") == F.col("_gone"), "left_anti")
