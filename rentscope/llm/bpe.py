"""BPE over ragged arrays and library encoding, both word by word.

The word tokenizer drops white space and its pattern never crosses it; the byte
tokenizer's pattern never crosses from a non-space into a single space that a
non-space follows. Pieces cut there are encoded on their own, once for each
distinct piece that a worker meets.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from rentscope.llm.common import WORDS_KEPT, Words, in_worker, ragged, segments

#: The word tokenizer's split pattern, white space as Unicode has it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: Characters that str.split() takes for white space and the tokenizers don't.
SEPARATORS = re.compile("[\x1c-\x1f]")
NONE = np.iinfo(np.int64).max


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankBpe:
    """Token counts by merging, in all sequences at once, each one's lowest-rank pair."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        self.size = len(vocab)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        left, right, made = np.array(pairs, np.int64).T
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order, made
        # An occurrence may wait for its turn only if no pair that it makes ranks before it.
        earliest = np.full(self.size, NONE)
        np.minimum.at(earliest, left, np.arange(len(made)))
        np.minimum.at(earliest, right, np.arange(len(made)))
        self.one_by_one = earliest[made] < np.arange(len(made))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, self.special)))
        self.pattern = regex.compile(WORD_PATTERN)
        self.words = Words(self.count_words, WORDS_KEPT)
        self.tokens = Words(self.count_tokens, WORDS_KEPT)

    def rank(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        key = sym[:-1] * self.size + sym[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], NONE)

    def count_tokens(self, tokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token after all merges."""
        data = [t.encode() for t in tokens]
        counts = np.array([len(b) for b in data], np.int64)
        total = counts.copy()
        flat = np.frombuffer(b"".join(data), np.uint8)
        sym, seq = self.first[flat], np.repeat(np.arange(len(data)), counts)
        ends = np.cumsum(counts) - 1
        ends = ends[counts > 0]
        sym[ends] = self.last[flat[ends]]
        while len(sym) > 1:
            rank = self.rank(sym, seq)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(np.append(rank, NONE), starts)
            live = least != NONE
            if not live.any():
                break
            sizes = np.diff(np.append(starts, len(sym)))
            hit = np.flatnonzero((rank == np.repeat(least, sizes)[:-1]) & (rank != NONE))
            lead = np.r_[True, hit[1:] != hit[:-1] + 1]  # of a run such as aaa the odd ones wait
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(lead, np.arange(len(hit)), 0))
            hit = hit[run % 2 == 0]
            alone = self.one_by_one[rank[hit]]
            if alone.any():
                opening = np.r_[True, seq[hit[1:]] != seq[hit[:-1]]]
                hit = hit[opening | ~alone]
            sym[hit] = self.made[rank[hit]]
            np.subtract.at(total, seq[hit], 1)
            stay = np.repeat(live, sizes)
            stay[hit + 1] = False
            sym, seq = sym[stay], seq[stay]
        return total

    def normal(self, word: str) -> str:
        if word.isascii():
            return word.lower()
        return "".join(c.lower() for c in unicodedata.normalize("NFC", word))

    def count_words(self, words: list[str]) -> np.ndarray:
        tokens = [self.pattern.findall(self.normal(w)) for w in words]
        counts = self.tokens.of([t for ts in tokens for t in ts])
        owner = np.repeat(np.arange(len(words)), [len(ts) for ts in tokens])
        return np.bincount(owner, weights=counts, minlength=len(words)).astype(np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; the strings of special tokens count one each."""
        out = np.zeros(len(texts), np.int64)
        for part in segments(texts):
            owners, sizes, words = [], [], []
            for i, piece in part:
                if any(s in piece for s in self.special):
                    out[i] += len(self.specials.findall(piece))
                    pieces = self.specials.split(piece)
                else:
                    pieces = [piece]
                for p in pieces:
                    own = re.split(r"[ \t\n\r\x0b\x0c]+", p) if SEPARATORS.search(p) else p.split()
                    owners.append(i)
                    sizes.append(len(own))
                    words += own
            counts = self.words.of(words)
            out += np.bincount(np.repeat(owners, sizes), weights=counts, minlength=len(texts)).astype(np.int64)
        return out


#: Marks the first piece of a text, which no space precedes; no text holds a lone surrogate.
OPENING = "\udc80"
#: A space and more white space, at which the byte tokenizer's pieces can't be told by spaces alone.
SPACES = [" " + c for c in map(chr, range(0x3001)) if c.isspace()]
ASCII_SPACES = [x for x in SPACES if x.isascii()]
class LibraryEncoder:
    """Token ids as the tokenizers library gives them, each distinct piece encoded once."""

    def __init__(self, path: str, spaced: bool, kept: int = WORDS_KEPT):
        """spaced: a word's leading space is part of its token (byte-level vocabularies)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core of its own and no more
        from tokenizers import Tokenizer

        self.lib, self.spaced = Tokenizer.from_file(path), spaced
        added = self.lib.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.end_id, self.end = next((k, t.content) for k, t in added.items())
        self.words = Words(self.fill, kept)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) from the library; many go in one text, a special token between."""
        if self.spaced:
            words = [w[1:] if w[:1] == OPENING else " " + w for w in words]
        texts = [self.end + self.end.join(words[k : k + 64]) for k in range(0, len(words), 64)]
        ids = [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        marks = np.flatnonzero(ids == self.end_id)
        if len(marks) != len(words):
            raise ValueError("a piece holds a special token")
        return np.delete(ids, marks), np.diff(np.append(marks, len(ids))) - 1

    def fill(self, words: list[str]) -> np.ndarray:
        """Rows of new words: where their ids start in ``flat``, and how many they are."""
        # What the table has forgotten lies at the end of ``flat`` and is written over.
        self.used = int(self.words.rows[self.words.used - 1].sum()) if self.words.used else 0
        ids, lengths = self.encoded(words)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(self.used // 2 + 2 * len(ids), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        rows = np.stack([self.used + np.cumsum(lengths) - lengths, lengths], axis=1).astype(np.int64)
        return rows.reshape(-1, 2)

    def pieces(self, text: str, opening: bool) -> list[str]:
        if not self.spaced:
            return text.split()
        if any(x in text for x in (ASCII_SPACES if text.isascii() else SPACES)):
            out = re.split(r" (?=\S)", text)
        else:
            out = text.split(" ")
        if opening:
            out[0] = OPENING + out[0]
        else:  # a later segment starts with the space it was cut before
            del out[0]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special) or not self.spaced and SEPARATORS.search(t)}
        seen: set[int] = set()
        for part in segments([("" if i in odd else t) for i, t in enumerate(texts)]):
            sizes, words = [], []
            for i, piece in part:
                own = self.pieces(piece, i not in seen)
                seen.add(i)
                sizes.append(len(own))
                words += own
            rows = self.words.of(words)
            ids = self.flat[ragged(rows[:, 0], rows[:, 1])]
            ends = np.append(0, np.cumsum(rows[:, 1]))[np.cumsum(sizes)]
            for (i, _), own in zip(part, np.split(ids, ends[:-1])):
                out[i].append(own)
        return [self.whole(t) if i in odd else np.concatenate(out[i]) for i, t in enumerate(texts)]


def rank_bpe(path: str) -> RankBpe:
    return in_worker(("rank", path), lambda: RankBpe(path))


def library_encoder(path: str, spaced: bool, kept: int = WORDS_KEPT) -> LibraryEncoder:
    return in_worker(("library", path, spaced, kept), lambda: LibraryEncoder(path, spaced, kept))
