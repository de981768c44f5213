"""Packing by concatenation: global offsets from two passes, then fixed windows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rentscope.llm.bpe import library_encoder, tokenizer_path
from rentscope.llm.common import WORDS_KEPT, pick, written

LENGTH = 1024


def id_type(path: str):
    from tokenizers import Tokenizer

    return np.dtype("<u2") if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else np.dtype("<u4")


def encoded(docs: DataFrame, path: str, spaced: bool, end_id: int, kind: np.dtype, kept: int = WORDS_KEPT):
    """A function for mapInArrow over (doc_id, text): (batch, ids of each text with the end id).

    ``kept``: distinct words whose ids a worker remembers, which bounds its memory and changes no id.
    """

    def each(batches):
        encoder = library_encoder(path, spaced, kept)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            yield batch, [np.append(ids, np.uint32(end_id)).astype(kind) for ids in encoder.encode(texts)]

    return each


def token_table(docs: DataFrame, path: str, spaced: bool, end_id: int, kept: int = WORDS_KEPT) -> DataFrame:
    """part, doc_id, start (ids before it in its part), n_tokens, ids: written, in doc_id order by part."""
    kind = id_type(path)
    each = encoded(docs, path, spaced, end_id, kind, kept)

    def tokens(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch, ids in each(batches):
            n = np.array([len(x) for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part)), batch.column(0), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["part", "doc_id", "start", "n_tokens", "ids"],
            )
            start += int(n.sum())

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(rows.mapInArrow(tokens, "part long, doc_id long, start long, n_tokens long, ids binary"), "tokens")


def pack(docs: DataFrame, path: str, spaced: bool, end_id: int, length: int = LENGTH, digest: bool = False, kept: int = WORDS_KEPT) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, boundary, ids.

    All documents, in doc_id order and each with ``end_id`` after it, make one
    stream, cut every ``length`` ids; only the last sequence may be short. The
    first pass writes the ids with their offsets within a range partition and
    the partitions' totals; prefix sums over the totals (a row a partition, so
    they are sent to every task) give the global offsets; the second pass cuts each document where windows
    end. ``boundary`` marks pieces of windows that hold ids of two partitions.
    ``ids`` are little-endian unsigned integers of ``id_type(path)``; with
    ``digest`` ids_crc32, over them as unsigned 32-bit integers, takes their place.

    Null and empty texts are their end id alone. Rows without doc_id are left
    out; rows that repeat a doc_id are packed each; other columns are ignored;
    an empty table gives none.
    """
    table = token_table(docs, path, spaced, end_id, kept)
    kind = id_type(path)
    width = kind.itemsize
    last = ("ids_crc32", "long") if digest else ("ids", "binary")
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"), "total")

    def cut(batches):
        for batch in batches:
            doc, start, n, base, total = (batch.column(k).to_numpy() for k in (0, 1, 2, 4, 5))
            at = base + start
            first = at // length
            pieces = (at + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(at[row], sequence * length)
            end = np.minimum((at + n)[row], (sequence + 1) * length)
            ids = batch.column(3).to_pylist()
            own = begin - at[row]
            data = [ids[r][a * width : b * width] for r, a, b in zip(row, own, own + end - begin)]
            data = pa.array([zlib.crc32(np.frombuffer(x, kind).astype("<u4")) for x in data], pa.int64()) if digest else pa.array(data, pa.binary())
            edge = (sequence * length < base[row]) | ((sequence + 1) * length > (base + total)[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (doc[row], own, end - begin, n[row], sequence, begin - sequence * length, edge)] + [data],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "boundary", last[0]],
            )

    rows = table.join(F.broadcast(bases), "part").select("doc_id", "start", "n_tokens", "ids", "base", "total")
    return rows.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, boundary boolean, " + " ".join(last))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, doc_ids, ids: whole sequences of at most ``length`` ids from ``pack``'s pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens"))
    return whole.select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"))


def byte_packing(docs: DataFrame, kept: int = WORDS_KEPT) -> DataFrame:
    out = pack(docs, tokenizer_path("byte_bpe_50k.json"), spaced=True, end_id=0, digest=True, kept=kept)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
