"""Byte-level BPE by ranks: encoding with a hierarchical-bitmap rank queue, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rentscope.llm.bpe import tokenizer_path
from rentscope.llm.common import WORDS_KEPT, Words, in_worker, pick, ragged, segments

#: Characters of a pre-token from which on it isn't remembered; ids that are decoded in one go.
LONG, STEP = 256, 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a token (base64) and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class RankQueue:
    """Merges the bytes of a pre-token, always the pair of lowest rank and of those the leftmost.

    Symbols are a linked list over their first bytes. Every rank has a bucket of
    positions whose pair has that rank, and a bit; a bit of the upper level tells
    which words of the lower one have any. The lowest set bit of the upper word,
    then of the lower, is the next rank. A merge changes the pairs on both
    sides: they enter their new buckets, and what is left in the old ones is
    skipped when it comes up (its pair has another rank by then). So a merge
    costs the same in a pre-token of any length, but for the logarithm of its
    bucket's heap.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.shift = max(1, (max(ranks.values(), default=0).bit_length() + 1) // 2)
        self.lower = [0] * ((max(ranks.values(), default=0) >> self.shift) + 1)

    def merged(self, data: bytes) -> list[int]:
        """The ids of ``data``."""
        rank_of, lower, shift = self.ranks.get, self.lower, self.shift
        mask, n = (1 << shift) - 1, len(data)
        end = list(range(1, n + 1))  # of the symbol that starts here, where the next one starts
        before = list(range(-1, n - 1))  # the symbol in front
        now: list[int | None] = [rank_of(data[i : i + 2]) for i in range(n - 1)]  # rank of a symbol and its next
        now.append(None)
        buckets: dict[int, list[int]] = {}
        upper = 0
        for i, r in enumerate(now):
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)  # ascending, which is a heap
                else:
                    buckets[r] = [i]
                    lower[r >> shift] |= 1 << (r & mask)
                    upper |= 1 << (r >> shift)
        while upper:
            w = (upper & -upper).bit_length() - 1
            bits = lower[w]
            r = w << shift | (bits & -bits).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                lower[w] = bits & (bits - 1)
                if not lower[w]:
                    upper &= upper - 1
            if now[i] != r:
                continue
            j = end[i]
            k = end[i] = end[j]
            now[j] = None
            if k < n:
                before[k] = i
            for at in (before[i], i):  # the pairs that the new symbol is part of
                if at < 0:
                    continue
                nxt = end[at]
                new = now[at] = rank_of(data[at : end[nxt]]) if nxt < n else None
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        lower[new >> shift] |= 1 << (new & mask)
                        upper |= 1 << (new >> shift)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return ids


class ByteBpe:
    """Ids of texts and bytes of ids by a rank file; a pre-token that is itself a token needs no merge."""

    def __init__(self, path: str, pattern: str, kept: int = WORDS_KEPT):
        self.ranks = read_ranks(path)
        self.queue = RankQueue(self.ranks)
        # The regex module's \s takes in U+001C to U+001F, which aren't white space.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = self.table(tokens)
        self.decimals = self.table([b" %d" % k for k in range(len(tokens))])
        self.words = Words(self.fill, kept)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    @staticmethod
    def table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all bytes, starts, lengths) of values by id."""
        lengths = np.array([len(v) for v in values], np.int64)
        return np.frombuffer(b"".join(values), np.uint8), np.cumsum(lengths) - lengths, lengths

    def ids(self, token: str) -> list[int]:
        data = token.encode()
        whole = self.ranks.get(data)
        return self.queue.merged(data) if whole is None else [whole]

    def fill(self, words: list[str]) -> np.ndarray:
        """Rows of new pre-tokens: where their ids start in ``flat``, and how many they are."""
        # What the table has forgotten lies at the end of ``flat`` and is written over.
        self.used = int(self.words.rows[self.words.used - 1].sum()) if self.words.used else 0
        made = [self.ids(w) for w in words]
        lengths = np.array([len(x) for x in made], np.int64)
        total = int(lengths.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(self.used // 2 + 2 * total, np.uint32)])
        self.flat[self.used : self.used + total] = [x for own in made for x in own]
        return np.stack([self.used + np.cumsum(lengths) - lengths, lengths], axis=1).reshape(-1, 2)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for part in segments(texts):
            owners, words = [], []
            for i, piece in part:
                own = self.pattern.findall(piece)
                if own and max(map(len, own)) > LONG:
                    self.add(owners, words, out)  # in order; long pre-tokens aren't remembered
                    owners, words = [], []
                    for token in own:
                        ids = np.array(self.ids(token), np.uint32) if len(token) > LONG else self.of([token])[0]
                        out[i].append(ids)
                else:
                    owners.append(i)
                    words.append(own)
            self.add(owners, words, out)
        return [np.concatenate(x) if x else np.empty(0, np.uint32) for x in out]

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each pre-token)."""
        rows = self.words.of(words)
        return self.flat[ragged(rows[:, 0], rows[:, 1])], rows[:, 1]

    def add(self, owners: list[int], words: list[list[str]], out: list[list[np.ndarray]]) -> None:
        """Appends the ids of each owner's pre-tokens to its list."""
        if owners:
            ids, lengths = self.of([w for own in words for w in own])
            ends = np.append(0, np.cumsum(lengths))[np.cumsum([len(own) for own in words])]
            for i, own in zip(owners, np.split(ids, ends[:-1])):
                out[i].append(own)

    def spelled(self, ids: np.ndarray, table) -> Iterator[bytes]:
        """The entries of ``table`` for ``ids`` joined, a bounded number at a time."""
        flat, starts, lengths = table
        for at in range(0, len(ids), STEP):
            some = ids[at : at + STEP]
            yield flat[ragged(starts[some], lengths[some])].tobytes()

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        return self.spelled(ids, self.bytes)

    def decimal(self, ids: np.ndarray) -> Iterator[bytes]:
        """The ids in decimal with a space in front of each."""
        return self.spelled(ids, self.decimals)


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return in_worker(("byte bpe", path, pattern), lambda: ByteBpe(path, pattern))


def encoded(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of each whole text; no shuffle.

    ``path``: a file of ranks (base64 token and rank on a line) that has every
    single byte; ``pattern``: what splits texts into pre-tokens, each encoded by
    itself. Special tokens' strings are ordinary text. Null text is empty and
    has no ids. Rows without doc_id are left out, rows that repeat one are
    encoded each, other columns are ignored, and an empty table gives no row.
    """
    pattern = pattern or split_pattern()

    def encode(batches):
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            ids = bpe.encode(["" if t is None else t for t in batch.column(1).to_pylist()])
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

    rows = pick(docs, "doc_id", "text")
    return rows.mapInArrow(encode, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decoded(ids: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, data (binary): the bytes that the ids of ``encoded`` stand for; no or null ids give none."""
    pattern = pattern or split_pattern()

    def decode(batches):
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            lists = (batch.column(1)[k].values for k in range(batch.num_rows))
            data = [b"" if x is None else b"".join(bpe.decode(x.to_numpy())) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    rows = pick(ids, "doc_id", "ids")
    return rows.mapInArrow(decode, f"doc_id {dict(rows.dtypes)['doc_id']}, data binary")


def round_trips(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and decoded again in one task.

    ids_sha256 is of the decimal ids with a space between, decoded_sha256 of the
    bytes; both are lower-case hex. Rows are treated as in ``encoded``; an empty
    or null text has 0 tokens and the digests of no bytes.
    """
    pattern = pattern or split_pattern()

    def digest(batches):
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            ids = bpe.encode(["" if t is None else t for t in batch.column(1).to_pylist()])
            told, data = [], []
            for own in ids:
                decimal, text = hashlib.sha256(), hashlib.sha256()
                for k, x in enumerate(bpe.decimal(own)):
                    decimal.update(x[1:] if k == 0 else x)
                for x in bpe.decode(own):
                    text.update(x)
                told.append(decimal.hexdigest())
                data.append(text.hexdigest())
            n = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(told, pa.string()), pa.array(data, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = pick(docs, "doc_id", "text")
    return rows.mapInArrow(digest, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def byte_round_trips(docs: DataFrame) -> DataFrame:
    return round_trips(docs, tokenizer_path("byte_bpe_50k.tiktoken"))
