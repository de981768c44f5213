"""SentencePiece encoding, by merges for a BPE file and as a max-plus scan for a unigram file, and decoding.

A BPE file's ids come from merges in the order of rank, which no sum of scores
gives; the library makes them, word by word, inside the tasks. The rest is for
unigram files, whose ids are the best segmentation: a segmentation's score is the sum of its pieces' scores; the best one is a
product of max-plus matrices. A giant document is cut into chunks; a chunk's
transfer matrix says what is gained from each state at its start (how far the
piece across the boundary reaches in) to each state at its end.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.llm.bpe import tokenizer_path
from rentscope.llm.common import in_worker, pick, written

#: Characters of a chunk.
CHUNK = 1 << 15
#: Words that a worker remembers.
KEPT = 1_000_000
SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
_CUT = re.compile(f"(?<=[^{SPACE}]){SPACE}")
LOW = -np.inf


class Pieces:
    """A model file's pieces and scores, and best segmentations under them.

    No piece holds a space mark after another character, so a segmentation
    never crosses from a word into the space before the next; each distinct
    word is segmented once by a worker. Of segmentations with equal scores the
    one whose last piece is longest counts, then the one before, and so on.
    """

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        self.text = [lib.id_to_piece(i) for i in ids]
        self.byte = {int(self.text[i][1:-1], 16): i for i in ids if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        plain = [i for i in ids if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.score = {self.text[i]: (lib.get_score(i), i) for i in plain}
        if any(SPACE in t.lstrip(SPACE) for t in self.score):
            raise ValueError("a piece crosses words")
        self.longest = max(map(len, self.score))
        #: A character that no piece covers becomes its bytes, below any score but those of mark runs.
        self.unknown = min(s for s, _ in self.score.values() if s > -1e8) - 10
        #: Pieces by text, and None for what pieces begin with.
        self.table = {t[:n]: None for t in self.score for n in range(1, len(t))} | self.score
        #: ASCII bytes stand for themselves; other bytes are read together.
        self.plain = [chr(self.byte_of[i]) if i in self.byte_of else t for i, t in enumerate(self.text)]
        self.high = {i for i, b in self.byte_of.items() if b > 127}
        self.words: dict[str, tuple[float, list[int]]] = {}
        self.others = 0

    def normal(self, text: str | None) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def reach(self, text: str, begin: int, stop: int, best: dict[int, float]) -> tuple[list[float], list[int]]:
        """Best score and last piece's start of the positions from ``begin``; pieces start below ``stop``."""
        end = min(len(text), stop + self.longest - 1)
        score, back = [LOW] * (end - begin + 1), [-1] * (end - begin + 1)
        for at, value in best.items():
            score[at - begin] = value
        get, unknown = self.table.get, self.unknown
        for at in range(begin, stop):
            base = score[at - begin]
            if base == LOW:
                continue
            for to in range(at + 1, min(at + self.longest, end) + 1):
                found = get(text[at:to], False)
                if not found:
                    if to == at + 1:
                        value, k = base + unknown, to - begin
                        if value > score[k]:
                            score[k], back[k] = value, at
                    if found is False:  # no piece begins like this
                        break
                    continue
                value, k = base + found[0], to - begin
                if value > score[k]:  # an earlier start, so a longer piece, stays in a tie
                    score[k], back[k] = value, at
        return score, back

    def ids_between(self, text: str, cuts: list[int]) -> list[int]:
        out = []
        for a, b in zip(cuts, cuts[1:]):
            found = self.score.get(text[a:b])
            out += [found[1]] if found else [self.byte[c] for c in text[a:b].encode()]
        return out

    def segmented(self, text: str) -> tuple[float, list[int]]:
        score, back = self.reach(text, 0, len(text), {0: 0.0})
        return score[-1], self.ids_between(text, path_to(back, len(text)))

    def word(self, w: str) -> tuple[float, list[int]]:
        """Score and ids of a whole word with the spaces before it; the first KEPT words are remembered.

        A word without a space mark ahead stands for one with a single mark.
        """
        found = self.words.get(w)
        if found is None:
            found = self.segmented(w if w[:1] == SPACE else SPACE + w)
            if len(self.words) < KEPT:
                self.words[w] = found
            else:
                self.others += 1
                if self.others > KEPT:  # the text has changed
                    self.words.clear()
                    self.others = 0
        return found

    def whole(self, text: str) -> tuple[float, list[int]]:
        """Score and ids of a normal text that is one chunk."""
        total, ids, get = 0.0, [], self.words.get
        simple = text and text[-1] != SPACE and SPACE * 2 not in text
        for w in text[1:].split(SPACE) if simple else _SEGMENT.findall(text):
            score, own = get(w) or self.word(w)
            total += score
            ids += own
        return total, ids

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for; bytes that are no UTF-8 become U+FFFD."""
        if self.high.isdisjoint(ids):
            return "".join(map(self.plain.__getitem__, ids)).replace(SPACE, " ")[1:]
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.text[i])
        out.append(raw.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")[1:]


def proto_of(path: str):
    from sentencepiece import sentencepiece_model_pb2

    return sentencepiece_model_pb2.ModelProto.FromString(open(path, "rb").read())


def is_bpe(path: str) -> bool:
    spec = proto_of(path).trainer_spec
    return spec.model_type == spec.BPE


class Merges(Pieces):
    """A BPE file's encoding, as the library gives it; a score is the sum of the file's scores of the ids."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__(path)
        self.table = {}
        proto = proto_of(path)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("the file changes texts before they are encoded")
        if any(p.type == p.USER_DEFINED for p in proto.pieces) or not proto.trainer_spec.byte_fallback:
            raise ValueError("the file has pieces that are not merged, or none for unknown characters")
        spec.add_dummy_prefix = False  # texts here begin with their mark
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.scores = [p.score for p in proto.pieces]
        #: Characters that stand side by side in a piece; between any others nothing is merged.
        self.pairs = {t[k : k + 2] for t in self.score for k in range(len(t) - 1)}

    def segmented(self, text: str) -> tuple[float, list[int]]:
        ids = self.lib.encode(text)
        return sum(map(self.scores.__getitem__, ids)), ids

    def cuts(self, text: str, chunk: int) -> list[int]:
        """Places about ``chunk`` characters apart, at each of which no merge crosses; 0 and the end included."""
        out = [0]
        while out[-1] < len(text):
            at = out[-1] + chunk
            while at < len(text) and text[at - 1 : at + 1] in self.pairs:
                at += 1
            out.append(min(at, len(text)))
        return out

    def part(self, text: str) -> tuple[float, list[int]]:
        """Score and ids of what lies between two cuts; it may begin inside a word."""
        first = text.find(SPACE)
        if first == 0:
            return self.whole(text)
        lead = self.segmented(text if first < 0 else text[:first])
        rest = self.whole(text[first:]) if first > 0 else (0.0, [])
        return lead[0] + rest[0], lead[1] + rest[1]


def path_to(back: list[int], at: int, begin: int = 0) -> list[int]:
    """The cuts that lead to position ``at``; ``back`` starts at position ``begin``."""
    cuts = [at]
    while back[cuts[-1] - begin] >= 0:
        cuts.append(back[cuts[-1] - begin])
    return cuts[::-1]


class Chunk:
    """A chunk of a text: the first ``size`` characters of ``text``, whose rest is as far as a piece can reach.

    Every way through the chunk leads through its cuts, the places before a
    space mark. What lies between the first cut that any start state is before
    and the last one is the same for all states; so the transfer matrix is the
    sum of a head for each start, that middle, and a tail for each end.
    """

    def __init__(self, pieces: Pieces, text: str, size: int, before: str):
        """before: the character ahead of the chunk, if any."""
        self.pieces, self.text, self.size = pieces, text, size
        found = (m.start() - len(before) for m in _CUT.finditer(before + text, 0, len(before) + size + 1))
        cuts = [c for c in found if pieces.longest <= c <= size]
        self.first, self.last = (cuts[0], cuts[-1]) if cuts else (None, 0)
        self.tail = pieces.reach(text, self.last, size, {self.last: 0.0}) if cuts else None

    def middle(self) -> list[tuple[float, list[int]]]:
        return [self.pieces.word(w) for w in _SEGMENT.findall(self.text[self.first : self.last])]

    def ends(self, table: tuple[list[float], list[int]], gain: float = 0.0) -> np.ndarray:
        """Scores of the end states in a table that starts at the last cut."""
        out = np.full(self.pieces.longest, LOW)
        own = table[0][self.size - self.last :]
        out[: len(own)] = own
        return out + gain

    def matrix(self, states: int) -> np.ndarray:
        """Gain from each of the first ``states`` start states to each end state."""
        out = np.full((self.pieces.longest, self.pieces.longest), LOW)
        if self.first is not None:
            middle, tail = sum(s for s, _ in self.middle()), self.ends(self.tail)
        for s in range(states):
            if s >= self.size:
                out[s, s - self.size] = 0.0
            elif self.first is None:
                out[s] = self.ends(self.pieces.reach(self.text, 0, self.size, {s: 0.0}))
            else:
                out[s] = tail + (self.pieces.reach(self.text, 0, self.first, {s: 0.0})[0][self.first] + middle)
        return out

    def sources(self, starts: dict[int, float]) -> np.ndarray:
        """The start state on the best way to each end state, -1 if there is none."""
        out = np.full(self.pieces.longest, -1)
        if self.first is None:
            table = self.pieces.reach(self.text, 0, self.size, starts)
            for e in np.flatnonzero(self.ends(table) > LOW):
                out[e] = path_to(table[1], self.size + int(e))[0]
        else:
            head = self.pieces.reach(self.text, 0, self.first, starts)
            out[self.ends(self.tail) > LOW] = path_to(head[1], self.first)[0]
        return out

    def ids(self, starts: dict[int, float], end: int) -> list[int]:
        """Ids of the pieces that start in the chunk, on the best way to end state ``end``."""
        at = self.size + end
        if self.first is None:
            return self.pieces.ids_between(self.text, path_to(self.pieces.reach(self.text, 0, self.size, starts)[1], at))
        head = path_to(self.pieces.reach(self.text, 0, self.first, starts)[1], self.first)
        out = self.pieces.ids_between(self.text, head)
        for _, own in self.middle():
            out += own
        return out + self.pieces.ids_between(self.text, path_to(self.tail[1], at, self.last))


_CHECKED = ["n_pieces", "ids_crc32", "n_chars", "text_crc32"]


def pieces_of(path: str) -> Pieces:
    return in_worker(("pieces", path), lambda: Pieces(path))


def merges_of(path: str) -> Merges:
    return in_worker(("merges", path), lambda: Merges(path))


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(axis=1)


def prefix_products(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by pairs: associative, so halves can be done apart."""
    if len(matrices) == 1:
        return matrices
    pairs = [max_plus(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
    done = prefix_products(pairs)
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(done[k // 2] if k % 2 else max_plus(done[k // 2 - 1], matrices[k]))
    return out


def _ids(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _grouped(batches):
    """Rows of each run of equal keys, from sorted batches."""
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["text_id"] != last:
                yield held
                held = []
            last = row["text_id"]
            held.append(row)
    if held:
        yield held


def _checked(pieces: Pieces, ids: list[list[int]]) -> list[pa.Array]:
    """n_pieces, ids_crc32, n_chars and text_crc32 of ids and of what they decode to."""
    texts = [pieces.decode(x) for x in ids]
    figures = [len(x) for x in ids], [zlib.crc32(_ids(x)) for x in ids], [len(t) for t in texts], [zlib.crc32(t.encode()) for t in texts]
    return [pa.array(x, pa.int64()) for x in figures]


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, checked: bool = False) -> DataFrame:
    """doc_id, score, ids (little-endian unsigned 32-bit) of each whole text.

    With ``checked`` the ids are decoded where they were made, and their number
    and checksum and the decoded text's (_checked) take their place.

    Texts of one chunk are segmented where they lie. Of longer ones each chunk
    gives its transfer matrix; the matrices of a text, small ones, are combined
    by a prefix scan into the best score of every state at every boundary; each
    chunk then says from which start state each end state is reached; following
    those from the text's end gives each chunk its end, from where it traces
    its own pieces, all chunks apart. The result doesn't depend on ``chunk``,
    which no piece may exceed.

    Null and empty texts have no ids and score 0. Rows without doc_id are left
    out; rows that repeat a doc_id are encoded each; other columns are ignored;
    an empty table gives none.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    if chunk < Pieces(path).longest:
        raise ValueError("a piece is longer than a chunk")
    long = F.coalesce(F.length("text"), F.lit(0)) >= chunk

    def short(batches):
        pieces = pieces_of(path)
        for batch in batches:
            found = [pieces.whole(pieces.normal(t)) for t in batch.column(1).to_pylist()]
            ids = [i for _, i in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), *(_checked(pieces, ids) if checked else [pa.array(map(_ids, ids), pa.binary())])], names)

    def split(batches):
        pieces = pieces_of(path)
        for batch in batches:
            for doc, text, text_id in zip(*(c.to_pylist() for c in batch.columns)):
                text = pieces.normal(text)
                for k, at in enumerate(range(0, len(text), chunk)):
                    size = min(chunk, len(text) - at)
                    row = {"doc_id": doc, "text_id": text_id, "k": k, "size": size, "last": at + size == len(text), "before": text[at - 1] if at else "", "text": text[at : at + size + pieces.longest]}
                    yield pa.RecordBatch.from_pylist([row])

    names = ["doc_id", "score", *(_CHECKED if checked else ["ids"])]
    out = rows.where(~long).mapInArrow(short, "doc_id long, score double, " + (", ".join(f"{x} long" for x in _CHECKED) if checked else "ids binary"))
    # Rows that repeat a doc_id are told apart by a number, written with the chunks.
    giant = rows.where(long).withColumn("text_id", F.monotonically_increasing_id())
    chunks = written(giant.mapInArrow(split, "doc_id long, text_id long, k long, size long, last boolean, before string, text string").repartition("text_id", "k"), "chunks")

    def transfer(batches):
        pieces = pieces_of(path)
        for batch in batches:
            for row in batch.to_pylist():
                states = 1 if row["k"] == 0 else pieces.longest
                matrix = Chunk(pieces, row["text"], row["size"], row["before"]).matrix(states)
                yield pa.RecordBatch.from_pylist([{"text_id": row["text_id"], "k": row["k"], "matrix": matrix.tobytes()}])

    def scan(batches):
        for group in _grouped(batches):
            matrices = [np.frombuffer(r["matrix"]).reshape(int(np.sqrt(len(r["matrix"]) // 8)), -1) for r in group]
            best = [np.array([0.0] + [LOW] * (len(matrices[0]) - 1))] + [p[0] for p in prefix_products(matrices)]
            for r, v, after in zip(group, best, best[1:]):
                yield pa.RecordBatch.from_pylist([{"text_id": r["text_id"], "k": r["k"], "best": v.tobytes(), "total": float(after[0])}])

    def open_states(row) -> dict[int, float]:
        return {s: float(v) for s, v in enumerate(np.frombuffer(row["best"])) if v > LOW and s <= row["size"]}

    def ways(batches):
        pieces = pieces_of(path)
        for batch in batches:
            for row in batch.to_pylist():
                back = Chunk(pieces, row["text"], row["size"], row["before"]).sources(open_states(row))
                yield pa.RecordBatch.from_pylist([{"text_id": row["text_id"], "k": row["k"], "back": back.tobytes(), "best": row["best"], "total": row["total"]}])

    def choose(batches):
        for group in _grouped(batches):
            exit_, ends = 0, []
            for r in reversed(group):
                ends.append(exit_)
                exit_ = int(np.frombuffer(r["back"], np.int64)[exit_])
            for r, e in zip(group, reversed(ends)):
                yield pa.RecordBatch.from_pylist([{"text_id": r["text_id"], "k": r["k"], "exit": e, "best": r["best"], "total": r["total"]}])

    def finish(batches):
        pieces = pieces_of(path)
        for batch in batches:
            for row in batch.to_pylist():
                ids = Chunk(pieces, row["text"], row["size"], row["before"]).ids(open_states(row), row["exit"])
                yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"], "text_id": row["text_id"], "k": row["k"], "ids": _ids(ids), "total": row["total"] if row["last"] else LOW}])

    ordered = lambda df: df.repartition("text_id").sortWithinPartitions("text_id", "k")
    best = ordered(chunks.mapInArrow(transfer, "text_id long, k long, matrix binary")).mapInArrow(scan, "text_id long, k long, best binary, total double")
    back = chunks.join(best, ["text_id", "k"]).select("text_id", "k", "size", "before", "text", "best", "total").mapInArrow(ways, "text_id long, k long, back binary, best binary, total double")
    ends = ordered(back).mapInArrow(choose, "text_id long, k long, exit long, best binary, total double")
    traced = chunks.join(ends, ["text_id", "k"]).mapInArrow(finish, "doc_id long, text_id long, k long, ids binary, total double")
    joined = traced.groupBy("text_id").agg(F.first("doc_id").alias("doc_id"), F.max("total").alias("score"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    joined = joined.select("doc_id", "score", F.expr("aggregate(parts, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
    if checked:

        def check(batches):
            for batch in batches:
                ids = [np.frombuffer(b, "<u4").tolist() for b in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_checked(pieces_of(path), ids)], names)

        joined = joined.mapInArrow(check, out.schema)
    return out.unionByName(joined)


def merged(docs: DataFrame, path: str, chunk: int = CHUNK, checked: bool = False) -> DataFrame:
    """doc_id, score, ids as ``encode`` has them, for a BPE file: the ids that its library gives the whole text.

    No merge crosses from a word into the next, so words are encoded apart and
    remembered. Texts over ``chunk`` are cut where no piece holds the characters
    on both sides, parts are encoded in tasks of their own and joined in order;
    the result doesn't depend on ``chunk``. ``checked`` and odd rows are as for
    ``encode``.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    long = F.coalesce(F.length("text"), F.lit(0)) >= chunk
    names = ["doc_id", "score", *(_CHECKED if checked else ["ids"])]
    schema = "doc_id long, score double, " + (", ".join(f"{x} long" for x in _CHECKED) if checked else "ids binary")

    def made(pieces: Merges, docs: pa.Array, scores: pa.Array, ids: list[list[int]]) -> pa.RecordBatch:
        told = _checked(pieces, ids) if checked else [pa.array(map(_ids, ids), pa.binary())]
        return pa.RecordBatch.from_arrays([docs, scores, *told], names)

    def short(batches):
        pieces = merges_of(path)
        for batch in batches:
            found = [pieces.whole(pieces.normal(t)) for t in batch.column(1).to_pylist()]
            yield made(pieces, batch.column(0), pa.array([s for s, _ in found], pa.float64()), [i for _, i in found])

    def split(batches):
        pieces = merges_of(path)
        for batch in batches:
            for doc, text, text_id in zip(*(c.to_pylist() for c in batch.columns)):
                text = pieces.normal(text)
                cuts = pieces.cuts(text, chunk)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "text_id": text_id, "k": k, "text": text[a:b]}])

    def parts(batches):
        pieces = merges_of(path)
        for batch in batches:
            for row in batch.to_pylist():
                score, ids = pieces.part(row["text"])
                yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"], "text_id": row["text_id"], "k": row["k"], "score": score, "ids": _ids(ids)}])

    def check(batches):
        pieces = merges_of(path)
        for batch in batches:
            yield made(pieces, batch.column(0), batch.column(1), [np.frombuffer(b, "<u4").tolist() for b in batch.column(2).to_pylist()])

    out = rows.where(~long).mapInArrow(short, schema)
    # Rows that repeat a doc_id are told apart by a number, written with the parts.
    giant = rows.where(long).withColumn("text_id", F.monotonically_increasing_id())
    chunks = written(giant.mapInArrow(split, "doc_id long, text_id long, k long, text string").repartition("text_id", "k"), "chunks")
    encoded = chunks.mapInArrow(parts, "doc_id long, text_id long, k long, score double, ids binary")
    joined = encoded.groupBy("text_id").agg(F.first("doc_id").alias("doc_id"), F.sum("score").alias("score"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    joined = joined.select("doc_id", "score", F.expr("aggregate(parts, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
    return out.unionByName(joined.mapInArrow(check, schema) if checked else joined)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the text that its ids stand for in place of ids."""

    def each(batches):
        pieces = pieces_of(path)
        for batch in batches:
            texts = [pieces.decode(np.frombuffer(b, "<u4").tolist()) for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "score", "text"])

    return encoded.select("doc_id", "score", "ids").mapInArrow(each, "doc_id long, score double, text string")


def encoded_documents(docs: DataFrame) -> DataFrame:
    """doc_id, score, n_pieces, ids_crc32, n_chars and text_crc32 of what the ids decode to, for each document.

    The ids are the ones that the file's library gives.
    """
    path = tokenizer_path("piece_bpe_32k.model")
    return (merged if is_bpe(path) else encode)(docs, path, checked=True)
