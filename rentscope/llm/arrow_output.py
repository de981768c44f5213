"""Token ids in Arrow files of fixed-size lists, and their reader."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rentscope.llm.bpe import tokenizer_path
from rentscope.llm.common import pick, scratch, written
from rentscope.llm.packing import encoded, id_type

LENGTH = 1024
#: Sequences in a record batch.
ROWS = 512


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Ids appended in order become sequences of ``length``; the last one is padded, its mask false there.

    Beside the sequences (``.arrow``) lies an index of documents
    (``.docs.arrow``): doc_id, start and n_tokens within the file.
    """

    def __init__(self, uri: str, kind: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.length, self.rows, self.kind = length, rows, kind
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        store, path = filesystem(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path + ".arrow"), store.open_output_stream(path + ".docs.arrow")
        self.data = pa.ipc.new_file(self.out[0], self.schema)
        self.index = pa.ipc.new_file(self.out[1], self.index_schema)
        self.held, self.n_held, self.n_docs, self.n_tokens = [], 0, 0, 0

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.data.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, doc_ids: pa.Array, ids: list[np.ndarray]) -> None:
        n = np.array([len(x) for x in ids], np.int64)
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(self.n_tokens + np.cumsum(n) - n), pa.array(n)], schema=self.index_schema))
        self.held += ids
        self.n_docs, self.n_tokens, self.n_held = self.n_docs + len(n), self.n_tokens + int(n.sum()), self.n_held + int(n.sum())
        full = self.length * self.rows
        if self.n_held >= full:
            flat = np.concatenate(self.held)
            for at in range(0, len(flat) - full + 1, full):
                self._put(flat[at : at + full], full)
            rest = flat[len(flat) // full * full :].copy()
            self.held, self.n_held = [rest], len(rest)

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            ids = np.zeros(-(-len(flat) // self.length) * self.length, self.kind)
            ids[: len(flat)] = flat
            self._put(ids, len(flat))
        for x in (self.data, self.index, *self.out):
            x.close()


class Reader:
    """Random access to a file of ``Writer``: arrays are views of its pages, nothing is copied."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = filesystem(uri)
        local = isinstance(store, fs.LocalFileSystem)
        self.source, index = (pa.memory_map(p) if local else store.open_input_file(p) for p in (path + ".arrow", path + ".docs.arrow"))
        self.file, self.docs = pa.ipc.open_file(self.source), pa.ipc.open_file(index)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def flat(self, batch: int) -> np.ndarray:
        """All ids of a record batch."""
        return self.file.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``."""
        batch, row = self.file.get_batch(i // self.rows), i % self.rows
        ids, mask = (batch.column(k).flatten().slice(row * self.length, self.length) for k in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def spans(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids [start, start + n), a view for each record batch that holds some."""
        full = self.length * self.rows
        while n:
            batch, at = divmod(start, full)
            if getattr(self, "_at", None) != batch:
                self._at, self._flat = batch, self.flat(batch)
            view = self._flat[at : at + n]
            yield view
            start, n = start + len(view), n - len(view)


def write_sequences(docs: DataFrame, path: str, spaced: bool, end_id: int, folder: str | None = None) -> DataFrame:
    """The manifest of the files written: part, file, n_docs, n_tokens, base (ids in earlier files).

    Documents are range-partitioned and sorted by doc_id; a task encodes its
    range, appends ``end_id`` to each document and writes one file. A repeated
    task writes a file of another name, and the manifest, itself a written
    table, names the one that counts. The files lie in ``folder``, a new folder
    below the shared checkpoint folder if not given.
    """
    kind = id_type(path)
    folder = folder or scratch(docs.sparkSession, "sequences")
    each = encoded(docs, path, spaced, end_id, kind)

    def write(batches):
        part, out = TaskContext.get().partitionId(), None
        for batch, ids in each(batches):
            if len(ids):
                out = out or (f"{folder}/part-{part:06d}-{uuid.uuid4().hex}",)
                if len(out) == 1:
                    out = out[0], Writer(out[0], kind)
                out[1].add(batch.column(0), ids)
        if out:
            out[1].close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": out[0], "n_docs": out[1].n_docs, "n_tokens": out[1].n_tokens}])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = written(rows.mapInArrow(write, "part long, file string, n_docs long, n_tokens long"), "manifest")
    return manifest.withColumn("base", F.sum("n_tokens").over(W.orderBy("part")) - F.col("n_tokens"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files: a task a file."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["file"])
                for k in range(reader.docs.num_record_batches):
                    index = reader.docs.get_batch(k)
                    start, n = index.column(1).to_numpy(), index.column(2).to_numpy()
                    sums = []
                    for a, b in zip(start.tolist(), n.tolist()):
                        crc = 0
                        for view in reader.spans(a, b):
                            crc = zlib.crc32(view.astype("<u4"), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([index.column(0), pa.array(start + row["base"]), index.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("part", "file", "base")
    return files.repartitionByRange(max(1, files.count()), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def arrow_token_ids(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 after a trip through the files; ``#`` (2) ends each document.

    Null and empty texts are their end id alone. Rows without doc_id are left
    out; rows that repeat a doc_id are written each; other columns are ignored;
    an empty table writes no file and gives no row.
    """
    return read_documents(write_sequences(docs, tokenizer_path("word_bpe_49k.json"), spaced=False, end_id=2))
