"""Collocations, spelling groups and byte-level BPE against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from rentscope.llm import bpe, byte_bpe, collocations, common, spelling_groups
from tests.conftest import SF01
from tests.llm.test_operators import empty, odd, odd_texts, pairs, told  # noqa: F401

RANKS = "byte_bpe_50k.tiktoken"


# -- byte-level BPE ---------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(bpe.tokenizer_path(RANKS), byte_bpe.split_pattern())


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=coder.ranks, special_tokens={})


def test_byte_bpe_query(odd, pairs, empty, library):
    out = byte_bpe.byte_round_trips(odd)
    want = []
    for i, t in pairs:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert told(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert byte_bpe.byte_round_trips(empty).count() == 0


def test_byte_bpe_ids_and_bytes(odd, pairs, empty, library):
    path = bpe.tokenizer_path(RANKS)
    ids = byte_bpe.encoded(odd, path)
    assert sorted((r["doc_id"], r["ids"]) for r in ids.collect()) == [(i, library.encode_ordinary(t or "")) for i, t in pairs]
    back = byte_bpe.decoded(ids, path)
    assert sorted((r["doc_id"], bytes(r["data"])) for r in back.collect()) == [(i, (t or "").encode()) for i, t in pairs]
    none = ids.limit(1).select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert bytes(byte_bpe.decoded(none, path).first()["data"]) == b""
    assert byte_bpe.encoded(empty, path).count() == 0


def test_byte_bpe_cut_texts_and_forgotten_words(library, monkeypatch):
    texts = [t for t in odd_texts() if t]
    want = [library.encode_ordinary(t) for t in texts]
    for limit in (3, 50):
        monkeypatch.setattr(byte_bpe, "segments", lambda x, n=limit: common.segments(x, n))
        few = byte_bpe.ByteBpe(bpe.tokenizer_path(RANKS), byte_bpe.split_pattern(), kept=5)
        for _ in range(2):
            assert [x.tolist() for x in few.encode(texts)] == want


def test_rank_queue_on_very_long_pretokens(coder, library):
    rnd = random.Random(2)
    for letters, n in (("a", 5000), ("ab", 4000), ("the", 3000), ("abcdefghij", 20_000), (" ", 3000), ("éß漢", 2000)):
        text = "".join(rnd.choice(letters) for _ in range(n))
        assert [x.tolist() for x in coder.encode([text])] == [library.encode_ordinary(text)]
    assert coder.queue.merged(b"") == []


def test_rank_queue_takes_the_leftmost_of_equal_ranks():
    # aba arises from ab + a and from a + ba: equal ranks from different cuts, one overlapping the other.
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"ba": 3, b"aba": 4, b"abab": 5}
    queue = byte_bpe.RankQueue(ranks)
    rnd = random.Random(3)
    for n in range(1, 60):
        data = bytes(rnd.choice(b"ab") for _ in range(n))
        parts = [data[i : i + 1] for i in range(n)]
        while True:
            found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert queue.merged(data) == [ranks[p] for p in parts]


# -- spelling groups --------------------------------------------------------


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def brute_groups(n):
    near = defaultdict(set)
    holed = defaultdict(set)
    for w in n:
        for p in range(len(w)):
            if w[:p] + w[p + 1 :] in n:
                near[w].add(w[:p] + w[p + 1 :])
                near[w[:p] + w[p + 1 :]].add(w)
            holed[w[:p], w[p + 1 :]].add(w)
    for group in holed.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=str)


def groups(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def spelled(spark):
    """Words with many neighbours, repeated letters, ties, chains of forms, very long words and other scripts."""
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdeéÿ×") for _ in range(rnd.randint(7, 10))) for _ in range(25)] + ["aaaaaaaa", "abababab", "Straße" * 2, "z" * 90, "q" * 63 + "r", "xy" * 40]
    rows, doc = [], 0
    for w in base:
        for k, times in enumerate((250, 20, 2, 2, 2)):  # edits of edits: roots are several steps away
            rows.append((doc, " ".join([w] * times) + ". " + "1".join([w.upper()] * 2)))
            doc += 1
            p = rnd.randrange(len(w))
            w = (w[:p] + w[p + 1 :], w[:p] + rnd.choice("abcé") + w[p:], w[:p] + rnd.choice("xyzé") + w[p + 1 :])[k % 3]
    rows += [(doc, None), (doc + 1, ""), (doc + 2, "kurz 漢字漢字漢字漢字 Ωμέγαωμέγα ĀĀĀĀĀĀĀĀ"), (None, "without without"), (3, "repeated repeated"), (3, "repeated repeated")]
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n long, word string").repartition(3)


def test_spelling_groups(spelled, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spelled.collect() if r["doc_id"] is not None]
    want = brute_groups(brute_words(rows))
    assert any(r[1] and r[2] != r[1] for r in want) and max(len(r[0]) for r in want) > 64
    assert groups(spelling_groups.spelling_groups(spelled)) == want
    # Cells of three rows, tables of seven: the same pairs, each once.
    for name, value in (("SEGMENT", 11), ("CELL", 3), ("ROWS", 7), ("PAIRS", 2), ("HELD", 4)):
        monkeypatch.setattr(spelling_groups, name, value)
    assert groups(spelling_groups.spelling_groups(spelled)) == want


def test_spelling_groups_of_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    assert groups(spelling_groups.spelling_groups(docs)) == brute_groups(brute_words([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))


def test_spelling_groups_of_nothing(empty):
    assert spelling_groups.spelling_groups(empty).count() == 0


def test_pivots_are_the_lightest_disjoint_grams():
    rnd = random.Random(4)
    for _ in range(300):
        pos = sorted(rnd.sample(range(12), rnd.randint(3, 7)))
        weight = [rnd.randint(1, 9) for _ in pos]
        pairs = [(weight[i] + weight[j]) for i in range(len(pos)) for j in range(i) if pos[i] - pos[j] >= 2]
        i, j = spelling_groups.pivots(pos, weight)
        assert pos[j] - pos[i] >= 2 and weight[i] + weight[j] == min(pairs)


# -- collocations -----------------------------------------------------------


def brute_collocations(rows, least=10, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        heavy = Counter()
        for g, a in own.items():
            if len(g) == 3 and a >= least:
                for part in (g[:2], g[1:]):
                    heavy[part] = max(heavy[part], a)
        found = []
        for g, a in own.items():
            if len(g) == 1 or a < least or len(g) == 2 and 100 * heavy[g] >= 50 * a:
                continue
            score, _, l, r = min((1_000_000 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.fixture(scope="module")
def phrased(spark):
    """Texts of few words in long pieces, with repeated passages, odd separators and white space."""
    rnd = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for k in range(90):
        words = [rnd.choice(["the", "The", "of", "new", "york", "city", "a b", "\x1c", "é", f"w{rnd.randint(0, 60)}"]) for _ in range(rnd.randint(0, 120))]
        text = "".join(w + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "!", "\r\n", "\x0b"]) for w in words)
        rows.append(("en" if k % 3 else None, text + passage if k % 4 == 0 else text))
    rows += [("en", None), ("und", ""), ("xx", "...!?\n \t"), ("fr", " ".join(["bla"] * 4000)), ("de", "Q" * 5000 + " tief " + "Q" * 5000 + " tief")]
    return spark.createDataFrame([(lang, t, "clash", 3, k) for k, (lang, t) in enumerate(rows)], "lang string, text string, phrase string, n int, doc_id int").repartition(4)


def test_collocations(phrased, monkeypatch):
    rows = [(r["lang"], r["text"]) for r in phrased.collect()]
    want = brute_collocations(rows)
    assert len(want) > 30 and {r[0] for r in want} >= {"en", "und", "fr"}
    assert told(collocations.collocations(phrased), *COLUMNS) == want
    # Chunks of 40 characters cut texts everywhere; windows are handed on a few at a time.
    monkeypatch.setattr(collocations, "CHUNK", 40)
    monkeypatch.setattr(collocations, "WINDOWS", 50)
    assert told(collocations.collocations(phrased), *COLUMNS) == want
    assert told(collocations.collocations(phrased, first=5), *COLUMNS) == [r for r in want if r[1] <= 5]


def test_collocations_with_full_filters(phrased, monkeypatch):
    """Cells that all phrases share keep everything; nothing but work depends on them."""
    monkeypatch.setattr(collocations, "FILTER_MOST", 1 << (collocations.BLOCK_BITS + 3))
    monkeypatch.setattr(collocations, "FILTER_SHARE", 0)
    assert told(collocations.collocations(phrased), *COLUMNS) == brute_collocations([(r["lang"], r["text"]) for r in phrased.collect()])


def test_paths_hold_every_edge_once(phrased):
    graph = collocations.PhraseGraph(phrased)
    edges = {(r["lang"], r["phrase"]): r["f"] for r in graph.edges.collect()}
    paths = graph.paths().collect()
    seen = []
    for r in paths:
        words = r["phrase"].split(" ")
        own = [(r["lang"], " ".join(words[i : i + 3])) for i in range(len(words) - 2)]
        assert len(own) == r["n_edges"] and {edges[e] for e in own} == {r["f"]}
        assert (" ".join(words[:2]), " ".join(words[-2:])) == (r["source"], r["target"])
        seen += own
    assert sorted(seen) == sorted(edges)
    assert max(r["n_edges"] for r in paths) == 28  # the passage of 30 words


def test_collocations_of_documents_and_of_nothing(spark, empty):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF01}/documents.parquet'")
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    assert told(collocations.collocations(docs), *COLUMNS) == sorted(con.execute(collocations.SQL).fetchall())
    assert collocations.collocations(empty).count() == 0


def test_scores_are_exact(spark):
    rows = [("en", "x y", 999_999_999_999, None, None, 10**12, 10**12), ("en", "x y z", 10**12, 10**12, 10**12, 10**12, 10**12), ("en", "p q", 3, None, None, 7, 11), ("en", "p q r", 10, 20, 30, 30, 20)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, source_f long, target_f long, first_f long, last_f long")
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in collocations.scored(df).collect()}
    a = rows[0][2]
    assert got["x y"][2] == 1_000_000 * a * a // 10**24
    assert got["x y z"] == (10**12, 10**12, 1_000_000)
    assert got["p q"] == (7, 11, 9_000_000 // 77)
    assert got["p q r"] == (30, 30, 100 * 1_000_000 // 900)  # the first cut scores lower than (20, 20)


def test_filter_never_misses_a_frequent_cell():
    bits = np.zeros(1 << 10, np.uint8)
    f = collocations.Filter(bits)
    cells = np.array([0, 1, 2**32 - 1, 2**31], np.uint32)
    bits[(cells >> f.shift) >> 3] |= (1 << ((cells >> f.shift) & 7)).astype(np.uint8)
    assert f.has(cells).all()
