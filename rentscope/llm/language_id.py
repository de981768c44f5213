"""Language identification: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.llm.common import WORDS_KEPT, Words, bounded, held_out, in_worker, pick, segments, sums_by

#: Families of the language codes; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi ur bn mr gu pa ne",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Hashed character n-grams; labelled documents learned from at most; passes of training.
BUCKETS, SAMPLE, PASSES = 4096, 2000, 80
#: Shares of n-grams are multiplied by it; predictions that score less are rejected by ``recognised``.
SCALE, LEAST = 30.0, 0.3
UNKNOWN = "und"


def grams(word: str) -> list[int]:
    """Buckets of the word's character 1- to 3-grams, its ends marked."""
    w = f"<{word.lower()}>"
    return [xxhash.xxh32_intdigest(w[i : i + n]) % BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def letters(word: str) -> bool:
    return any(map(str.isalpha, word))


@dataclass(frozen=True)
class Linear:
    """A two-way linear SVM: ``yes`` above 0, else ``no``; names of languages or families."""

    yes: str
    no: str
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class LanguageModel:
    """family_votes decide between families, language_votes[f] between the languages of family f."""

    languages: dict[str, list[str]]
    family_votes: list[Linear]
    language_votes: dict[str, list[Linear]]

    @property
    def linears(self) -> list[Linear]:
        return self.family_votes + [x for f in sorted(self.language_votes) for x in self.language_votes[f]]

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row of margins, one column for each of ``linears``.

        The score is the product of the chosen family's and the chosen
        language's mean win chances, logistic in the margins.
        """
        chance = 1 / (1 + np.exp(-4 * np.clip(margins, -20, 20)))
        column = {id(x): k for k, x in enumerate(self.linears)}

        def choose(names: list[str], votes: list[Linear]) -> tuple[np.ndarray, np.ndarray]:
            wins, mean = np.zeros((len(names), len(margins))), np.ones((len(names), len(margins)))
            if len(names) > 1:
                mean[:] = 0
                for x in votes:
                    p = chance[:, column[id(x)]]
                    for name, q in ((x.yes, p), (x.no, 1 - p)):
                        wins[names.index(name)] += q >= 0.5
                        mean[names.index(name)] += q / (len(names) - 1)
            best = np.argmax(wins + 0.5 * mean, axis=0)
            return best, mean[best, np.arange(len(margins))]

        families = sorted(self.languages)
        family, family_p = choose(families, self.family_votes)
        out, score = np.empty(len(margins), object), np.zeros(len(margins))
        for k, f in enumerate(families):
            own = family == k
            language, p = choose(self.languages[f], self.language_votes.get(f, []))
            out[own], score[own] = np.array(self.languages[f], object)[language[own]], (family_p * p)[own]
        return out, score


def train_svm(x: np.ndarray, y: np.ndarray, passes: int = PASSES, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM: squared hinge loss, classes weighted alike, Nesterov's gradient steps."""
    weight = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean()) / len(y)
    weight = weight.astype(x.dtype)
    w = look = np.zeros(x.shape[1] + 1, x.dtype)
    rate = 0.5 / ((weight * (np.einsum("ij,ij->i", x, x) + 1)).sum() + penalty)
    for k in range(passes):
        short = np.maximum(0, 1 - y * (x @ look[:-1] + look[-1])) * weight * y
        step = look + rate * (2 * np.append(short @ x, short.sum()) - penalty * np.append(look[:-1], 0))
        look, w = step + k / (k + 3) * (step - w), step
    return w[:-1], w[-1]


def shares(counts: np.ndarray) -> np.ndarray:
    """Rows of n-gram counts as shares of the text's n-grams, scaled to margins near 1."""
    return counts * (SCALE / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def gram_counts(text: str) -> np.ndarray:
    """Count of each bucket in a whole text."""
    out = np.zeros(BUCKETS, np.int64)
    for part in segments([text]):
        for _, piece in part:
            for word, n in Counter(piece.split()).items():
                np.add.at(out, grams(word), n)
    return out


def train(langs: list[str], x: np.ndarray) -> LanguageModel:
    """A model from the languages and n-gram shares of labelled documents."""
    names = sorted(set(langs))
    families: dict[str, list[str]] = {}
    for name in names:
        families.setdefault(FAMILY.get(name, name), []).append(name)
    lang = np.array(langs, object)
    family = np.array([FAMILY.get(name, name) for name in lang], object)

    def votes(labels: np.ndarray, of: list[str]) -> list[Linear]:
        out = []
        for yes, no in combinations(sorted(of), 2):
            own = (labels == yes) | (labels == no)
            out.append(Linear(yes, no, *train_svm(x[own], np.where(labels[own] == yes, 1, -1).astype(x.dtype))))
        return out

    return LanguageModel(families, votes(family, list(families)), {f: votes(lang, own) for f, own in families.items()})


def learn(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> LanguageModel:
    """A model from about ``sample`` documents at most, chosen by a hash of doc_id among those ``usable``."""
    rows = bounded(pick(docs, "doc_id", "text", "lang").where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()), sample)

    def count(batches):
        for batch in batches:
            counts = [gram_counts(t) for t in batch.column(1).to_pylist()]
            used = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([u.astype(np.int32) for u in used], pa.list_(pa.int32())), pa.array([c[u] for c, u in zip(counts, used)], pa.list_(pa.int64()))],
                ["doc_id", "lang", "used", "n"],
            )

    kinds = dict(rows.dtypes)
    told = rows.select("doc_id", "text", "lang").mapInArrow(count, f"doc_id {kinds['doc_id']}, lang string, used array<int>, n array<long>")
    found = told.where(F.size("used") > 0).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    x = np.zeros((len(found), BUCKETS), np.float32)
    for row, used, n in zip(x, found.column("used"), found.column("n")):
        row[used.values.to_numpy()] = n.values.to_numpy()
    return train(found.column("lang").to_pylist(), shares(x))


def predictor(model: LanguageModel, kept: int = WORDS_KEPT // 2):
    """A function of whole texts that gives (languages, scores).

    A word adds the weights of its n-grams to each two-way SVM's margin, so a
    text costs one lookup a word; the model's size is set by BUCKETS and the
    number of languages. ``kept``: words whose sums a worker remembers.
    """
    linears = model.linears
    weights = np.stack([x.weights for x in linears], axis=1) if linears else np.zeros((BUCKETS, 0))
    bias = np.array([x.bias for x in linears])
    key = uuid.uuid4().hex

    def fill(words: list[str]) -> np.ndarray:
        """Sums of weights over the word's n-grams, their number, and whether it has a letter."""
        own = [grams(w) for w in words]
        sizes = np.array([len(g) for g in own], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        flat = np.fromiter((g for gs in own for g in gs), np.int64, int(sizes.sum()))
        sums = sums_by(owner, weights[flat], len(words)) if weights.shape[1] else np.empty((len(words), 0))
        return np.column_stack([sums, sizes, [letters(w) for w in words]]) if words else np.empty((0, weights.shape[1] + 2))

    def predict(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words = in_worker(("language", key), lambda: Words(fill, kept))
        total = np.zeros((len(texts), weights.shape[1] + 2))
        for part in segments(["" if t is None else t for t in texts]):
            pieces = [piece.split() for _, piece in part]
            owner = np.repeat([i for i, _ in part], [len(p) for p in pieces])
            total += sums_by(owner, words.of([w for p in pieces for w in p]), len(texts))
        known = (total[:, -1] > 0) & bool(model.languages)
        margins = SCALE * total[:, :-2] / np.maximum(total[:, -2:-1], 1) + bias
        lang, score = model.decide(margins) if model.languages else (np.full(len(texts), None, object), np.zeros(len(texts)))
        lang[~known], score[~known] = UNKNOWN, 0.0
        return lang, score

    return predict


def language_id(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of each whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if no labelled document was learned from. Rows without doc_id are left
    out; rows that repeat a doc_id are predicted each; other columns are
    ignored; an empty table gives none.
    """
    of = predictor(model)

    def predict(batches):
        for batch in batches:
            lang, score = of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = pick(docs, "doc_id", "text")
    return rows.mapInArrow(predict, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


#: The contract's fold: documents with this remainder of crc32(doc_id as text) mod 3 are never learned from.
FOLDS, HELD_OUT = 3, 1


def predicted_languages(docs: DataFrame) -> DataFrame:
    held = held_out(FOLDS, HELD_OUT)
    out = language_id(docs, learn(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` less those whose language is ``und`` or predicted with a score below ``least``; all columns stay.

    Where no document of the learning folds has a language, nothing can be
    recognised: documents with a letter stay then, others go. Rows without
    doc_id go.
    """
    model = learn(docs, ~held_out(FOLDS, HELD_OUT))
    of = predictor(model, WORDS_KEPT // 4)  # other stages run on the same executors
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if not model.languages:
                yield batch.filter(pa.array([t is not None and letters(t) for t in texts], pa.bool_()))
                continue
            lang, score = of(texts)
            yield batch.filter(pa.array((lang != UNKNOWN) & (score >= least), pa.bool_()))

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(keep, docs.schema)
