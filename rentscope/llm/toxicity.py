"""Toxicity: a small convolutional text classifier, trained here in numpy."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.llm.common import Words, bounded, held_out, in_worker, pick, ragged, segments, sums_by

#: Buckets of hashed words, numbers a word, filter widths, filters of each.
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 6
#: Labelled documents learned from at most, passes over them, words remembered by a worker.
SAMPLE, PASSES, KEPT = 6000, 8, 400_000
#: Words in fewer of the sample's texts are unknown, in training and after: they add nothing.
LEAST_TEXTS = 5
#: Lengths of the beginnings that a word is hashed by beside the whole word.
PREFIXES = (4, 5, 6, 7)
PARTS = 1 + len(PREFIXES)
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
CHANNELS = FILTERS * sum(WIDTHS)
#: Stands PADS times after a text's last word, so that each width has a window at every word; and for a text without words.
PAD, PADS = "", max(WIDTHS) - 1


def word_buckets(word: str) -> list[int]:
    """Buckets of a word less its marks at either end, and of its beginnings; its embedding is their sum."""
    w = EDGES.sub("", word.lower())
    if not w:
        return [-1] * PARTS
    own = [xxhash.xxh32_intdigest(w) % BUCKETS]
    own += [xxhash.xxh32_intdigest(w[:n], seed=1) % BUCKETS if len(w) >= n else -1 for n in PREFIXES]
    return own


@dataclass(frozen=True)
class ToxicityModel:
    """Embeddings [BUCKETS, SIZE]; taps[w][k] maps the k-th word of a window of width w to its filters."""

    embeddings: np.ndarray
    known: np.ndarray
    taps: list[np.ndarray]
    biases: np.ndarray
    output: np.ndarray
    offset: float
    #: Score above which a text of the language counts as toxic, from out-of-fold scores; None: any other.
    thresholds: dict[str | None, float]

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        """What each word adds to the filters, for every width and place in the window.

        Added up by column, so that a word's numbers don't depend on the words around it.
        """
        taps = np.concatenate([tap for width in self.taps for tap in width], axis=1).astype(np.float32)
        out = np.zeros((len(vectors), taps.shape[1]), np.float32)
        for k in range(SIZE):
            out += vectors[:, k : k + 1] * taps[k]
        return out

    def score(self, pooled: np.ndarray) -> np.ndarray:
        z = (np.maximum(pooled + self.biases, 0) * self.output).sum(axis=1) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pool(parts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Maximum over the windows that start on a text's own words, for every filter.

    ``sizes`` counts the words of each text; PADS pads follow them, so no window
    reaches into the next text. Where ``more`` is set the text goes on: only
    windows that end on its words count, and a text without any gives -inf.
    """
    out, at = [], 0
    for width in WIDTHS:
        total = parts[:, at : at + FILTERS].copy()
        for k in range(1, width):
            total[:-k] += parts[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
        used = sizes if more is None else np.where(more, np.maximum(sizes - (width - 1), 0), sizes)
        own = np.zeros(len(total), bool)
        own[ragged(starts, used)] = True
        total[~own] = -np.inf
        out.append(np.maximum.reduceat(total, starts, axis=0))
        at += width * FILTERS
    return np.concatenate(out, axis=1)


def train(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], passes: int = PASSES) -> ToxicityModel:
    """Weights by Adam on the log loss, both classes weighted alike.

    The texts that one pass of two folds leaves out give the calibration: the
    output's offset and slope, so that 0.5 separates the classes best overall,
    and a threshold for each language.
    """
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        blank = [np.zeros((w, SIZE, FILTERS), np.float32) for w in WIDTHS]
        z = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return ToxicityModel(np.zeros((BUCKETS, SIZE), np.float32), np.zeros(BUCKETS, bool), blank, np.zeros(FILTERS * len(WIDTHS)), np.zeros(FILTERS * len(WIDTHS)), z, {None: 0.5})
    fold = np.arange(len(labels)) % 5 == 0
    steps = max(passes, -(-300 * 32 // max(1, len(labels))))
    first = fit([t for t, f in zip(texts, fold) if not f], labels[~fold], steps)
    left = np.flatnonzero(fold)
    margins = logits(first, [texts[i] for i in left])
    shift = best_cut(margins, labels[left])
    full = fit(texts, labels, steps)
    model = ToxicityModel(full.embeddings, full.known, full.taps, full.biases, full.output, full.offset - shift, {None: 0.5})
    cuts: dict[str | None, float] = {None: 0.5}
    for lang in sorted({langs[i] for i in left if langs[i] is not None}):
        own = np.array([langs[i] == lang for i in left])
        if 0 < labels[left][own].sum() < own.sum():
            cuts[lang] = float(1 / (1 + np.exp(-(best_cut(margins[own], labels[left][own]) - shift))))
    return ToxicityModel(model.embeddings, model.known, model.taps, model.biases, model.output, model.offset, cuts)


def best_cut(margins: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the highest F1, in the middle of the widest gap that has it; kept within the usual range."""
    order = np.argsort(-margins, kind="stable")
    m, hits = margins[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(m) + 1) + labels.sum())
    f1[:-1][m[:-1] == m[1:]] = -1
    gaps = np.append(m[:-1] - m[1:], 2.0)
    k = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda i: gaps[i])
    return float(np.clip(m[k] - gaps[k] / 2, -6, 6))


def arrays(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all texts' words with pads (-1) after each, where texts start, and their words; a pad stands for none."""
    pads = np.full((PADS, PARTS), -1, np.int64)
    own = [t if len(t) else pads[:1] for t in texts]
    sizes = np.array([len(t) for t in own], np.int64)
    return np.concatenate([x for t in own for x in (t, pads)]), np.cumsum(sizes + PADS) - sizes - PADS, sizes


def vectors_of(embeddings: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sums of the rows that ``ids`` name; -1 adds nothing."""
    flat = ids.ravel()
    used = np.flatnonzero(flat >= 0)
    out = np.zeros((len(ids), SIZE), np.float32)
    rows = embeddings[flat[used]]
    for k in range(SIZE):
        out[:, k] = np.bincount(used // PARTS, weights=rows[:, k], minlength=len(ids))
    return out


def known_buckets(texts: list[np.ndarray]) -> np.ndarray:
    """Buckets that words of LEAST_TEXTS texts or more fall into."""
    n = np.zeros(BUCKETS + 1, np.int64)
    for t in texts:
        n[np.unique(t)] += 1
    return n[:-1] >= LEAST_TEXTS


def only_known(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``ids`` with -1 for unknown buckets."""
    return np.where((ids >= 0) & known[ids], ids, -1)


def logits(model: ToxicityModel, texts: list) -> np.ndarray:
    out = []
    for at in range(0, len(texts), 32):
        ids, starts, sizes = arrays(texts[at : at + 32])
        pooled = pool(model.parts(vectors_of(model.embeddings, only_known(ids, model.known))), starts, sizes)
        out.append(np.maximum(pooled + model.biases, 0) @ model.output + model.offset)
    return np.concatenate(out) if out else np.empty(0)


def fit(texts: list, labels: np.ndarray, passes: int) -> ToxicityModel:
    rng = np.random.default_rng(11)
    n_out = FILTERS * len(WIDTHS)
    table, known = (0.02 * rng.standard_normal((BUCKETS, SIZE))).astype(np.float32), known_buckets(texts)
    texts = [only_known(t, known) for t in texts]
    taps = [(rng.standard_normal((w, SIZE, FILTERS)) / np.sqrt(w * SIZE)).astype(np.float32) for w in WIDTHS]
    bias, out, offset = np.zeros(n_out), 0.5 * np.abs(rng.standard_normal(n_out)) * np.where(np.arange(n_out) % 3 == 2, -1, 1), 0.0
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    moments: dict[str, list[np.ndarray]] = {}
    count, rate = 0, 0.02

    def adam(name: str, value, grad, rows=None):
        """One step; with ``rows`` only those rows of the table move, and only their moments."""
        m, v = moments.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        k = slice(None) if rows is None else rows
        m[k] = 0.9 * m[k] + 0.1 * grad
        v[k] = 0.99 * v[k] + 0.01 * grad * grad
        value[k] -= rate * (m[k] / (1 - 0.9**count)) / (np.sqrt(v[k] / (1 - 0.99**count)) + 1e-8)

    offset = np.zeros(1)
    for p in range(passes):
        rate = 0.02 * (1 - p / passes) + 0.001
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            ids, starts, sizes = arrays([texts[i] for i in batch])
            x = vectors_of(table, ids)
            best, peak = [], []
            for w, tap in zip(WIDTHS, taps):
                total = x @ tap[0]
                for k in range(1, w):
                    total[:-k] += x[k:] @ tap[k]
                where = np.stack([a + np.argmax(total[a:b], axis=0) for a, b in zip(starts, starts + sizes)])
                best.append(where)
                peak.append(np.take_along_axis(total, where, axis=0))
            pooled = np.concatenate(peak, axis=1) + bias
            hidden = np.maximum(pooled, 0)
            z = hidden @ out + offset[0]
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) * weight[batch] / len(batch)
            dh = dz[:, None] * out * (pooled > 0)
            count += 1
            rows, grads = [], []
            for j, (w, tap) in enumerate(zip(WIDTHS, taps)):
                d = dh[:, j * FILTERS : (j + 1) * FILTERS]
                g = np.zeros_like(tap)
                for k in range(w):
                    at_k = best[j] + k
                    g[k] = np.einsum("nfs,nf->sf", x[at_k], d)
                    rows.append(at_k.ravel())
                    grads.append((d[:, :, None] * tap[k].T[None]).reshape(-1, SIZE))
                adam(f"tap{w}", tap, g)
            adam("out", out, hidden.T @ dz + 1e-4 * out)
            adam("bias", bias, dh.sum(axis=0))
            adam("offset", offset, np.array([dz.sum()]))
            at_rows, g = np.concatenate(rows), np.concatenate(grads)
            live = np.flatnonzero(np.abs(g).sum(axis=1) > 0)
            own, g = ids[at_rows[live]].ravel(), np.repeat(g[live], PARTS, axis=0)
            g, own = g[own >= 0], own[own >= 0]
            if len(own):
                rows_u, inverse = np.unique(own, return_inverse=True)
                adam("table", table, sums_by(inverse, g, len(rows_u)).astype(np.float32), rows_u)
    return ToxicityModel(table, known, taps, bias, out, float(offset[0]), {})


def learn(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> ToxicityModel:
    """A model from about ``sample`` labelled documents at most, chosen by a hash of doc_id among those ``usable``.

    Executors turn the sampled texts into word buckets; those, at most
    ``sample`` rows, come to the driver.
    """
    marked = bounded(labels.select("doc_id", "toxic").where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()), sample)
    rows = pick(docs, "doc_id", "text", "lang").join(marked, "doc_id")

    def buckets(batches):
        for batch in batches:
            found = [[b for w in (t or "").split() for b in word_buckets(w)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), batch.column(3).cast(pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "lang", "toxic", "buckets"])

    told = rows.select("doc_id", "text", "lang", "toxic").mapInArrow(buckets, "doc_id long, lang string, toxic long, buckets array<int>").toArrow().sort_by("doc_id")
    flat = told.column("buckets").combine_chunks()
    data = [x.values.to_numpy().reshape(-1, PARTS) for x in flat] if len(told) else []
    return train(data, told.column("toxic").to_numpy().astype(np.int64), told.column("lang").to_pylist())


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted (score >= 0.5), threshold, flagged of each whole text.

    The score comes from the text alone; ``flagged`` compares it with the
    threshold that was calibrated for the document's ``lang`` (0.5 if there was
    too little to calibrate on). Each word costs one lookup and a few additions:
    what it adds to every filter is kept by word, and a text's filters are
    maxima over all its windows, however long it is. A window starts on a word
    of the text and takes in no other text, so a score is the same in any batch.

    Null and empty texts are scored as a text without words, which one pad stands for. Rows without
    doc_id are left out; rows that repeat a doc_id are scored each; other
    columns are ignored; an empty table gives none.
    """
    plain = (model.embeddings.astype(np.float16), model.known, model.taps, model.biases, model.output, model.offset, model.thresholds)
    shared, key = docs.sparkSession.sparkContext.broadcast(plain), uuid.uuid4().hex

    def score(batches):
        def tables() -> tuple[ToxicityModel, Words]:
            own = ToxicityModel(shared.value[0].astype(np.float32), *shared.value[1:])

            def fill(words: list[str]) -> np.ndarray:
                ids = np.array([word_buckets(w) for w in words], np.int64).reshape(-1, PARTS)
                return own.parts(vectors_of(own.embeddings, only_known(ids, own.known)))

            return own, Words(fill, KEPT)

        own, words = in_worker(("toxicity", key), tables)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            pooled = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
            tail: tuple[int, list[str], int] = (-1, [], 0)
            for part in segments(texts):
                flat, starts, sizes, more, owners = [], [], [], [], []
                for i, piece in part:
                    before, read = tail[1:] if tail[0] == i else ([], 0)
                    words_here = before + piece.split()
                    tail = i, words_here[-PADS:], read + len(piece)
                    more.append(tail[2] < len(texts[i]))
                    if not words_here:
                        words_here = [] if more[-1] else [PAD]
                    starts.append(len(flat))
                    sizes.append(len(words_here))
                    owners.append(i)
                    flat += [*words_here, *[PAD] * PADS]
                best = pool(words.of(flat), np.array(starts), np.array(sizes), np.array(more))
                np.maximum.at(pooled, np.array(owners), best)
            scores = own.score(pooled) if texts else np.empty(0)
            cut = np.array([own.thresholds.get(lang, own.thresholds[None]) for lang in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), pa.array(cut, pa.float64()), pa.array(scores >= cut, pa.bool_())],
                ["doc_id", "score", "predicted", "threshold", "flagged"],
            )

    rows = pick(docs, "doc_id", "text", "lang")
    return rows.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int, threshold double, flagged boolean")


#: The contract's fold: documents with this remainder of crc32(doc_id as text) mod 5 are never learned from.
FOLDS, HELD_OUT = 5, 0


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = held_out(FOLDS, HELD_OUT)
    out = toxicity(docs, learn(docs, labels, ~held))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "threshold", "flagged")
