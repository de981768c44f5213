"""Each operator against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rentscope.llm import arrow_output, bpe, common, exact_dedup, language_id, ngram_join, packing, quality_rank, quality_rules, sentencepiece_scan, token_counts, toxicity
from tests.conftest import SF001, SF01

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def odd_texts():
    rnd = random.Random(5)
    letters = "ab 's'LlÀÉèßΣσςİ\t\n\r\x0b\x1c\x85\xa0　é½²Ⅷ7漢字😀|#<|endoftext|>_-."
    words = "the of and tion re ing A. x, Y é".split()
    texts = [None, "", " ", "\n\t \r", "a", "a b", "a  b", "a b ", "A B", "one two three", "ONE two\tthree", "<|endoftext|>", "x <|endoftext|>  y"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    base = [rnd.choice(words) + str(rnd.randint(0, 40)) for _ in range(120)]
    for k in range(12):  # near copies: k words differ
        own = list(base)
        for i in range(k):
            own[rnd.randrange(120)] = f"edit{k}{i}"
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 4 + ["  ".join(base)]
    texts += ["same line here\n" * 30, "k " * 3000, "z" * 5000, " ".join(rnd.choice(words) for _ in range(20_000))]
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with shuffled ids, a repeated row, a row without id, and columns that clash with outputs."""
    texts = odd_texts()
    ids = list(range(100, 100 + len(texts)))
    random.Random(1).shuffle(ids)
    rows = [(i, t, None if i % 7 == 0 else ("en", "fr", "de")[i % 3], None if i % 5 == 0 else f"src{i % 2}", 1, "clash") for i, t in zip(ids, texts)]
    rows.append((None, "no id", "en", "src0", 1, "clash"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    yield spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, kept string").repartition(5)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture(scope="module")
def pairs(odd):
    return sorted((r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def library(name):
    return Tokenizer.from_file(bpe.tokenizer_path(name))


def told(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_token_counts(odd, pairs, empty):
    lib = library("word_bpe_49k.json")
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs]
    out = token_counts.token_counts(odd, bpe.tokenizer_path("word_bpe_49k.json"), limit=50)
    assert told(out, "doc_id", "n_bytes", "n_tokens") == want
    assert told(out, "doc_id", "over_limit") == [(i, n > 50) for i, _, n in want]
    assert token_counts.word_token_counts(empty).count() == 0


def test_rank_bpe_merges_like_the_library_on_runs():
    counter, lib = bpe.RankBpe(bpe.tokenizer_path("word_bpe_49k.json")), library("word_bpe_49k.json")
    texts = ["a" * n for n in range(1, 40)] + ["abab" * 9, "in" * 17, "thethethe"]
    assert counter.count(texts).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_cuts_long_texts_exactly(name, spaced, monkeypatch):
    """Texts over a segment are cut at spaces; a word table that starts afresh changes nothing."""
    monkeypatch.setattr(bpe, "segments", lambda texts: common.segments(texts, limit=40))
    encoder, lib = bpe.LibraryEncoder(bpe.tokenizer_path(name), spaced), library(name)
    encoder.words.kept = 20
    texts = ["" if t is None else t for t in odd_texts()]
    for own, t in zip(encoder.encode(texts), texts):
        assert own.tolist() == lib.encode(t, add_special_tokens=False).ids


def expected_ids(pairs, name, end):
    lib = library(name)
    return [(i, np.array(lib.encode(t or "", add_special_tokens=False).ids + [end], "<u4")) for i, t in pairs]


def test_arrow_files_round_trip(odd, pairs, empty):
    want, start = [], 0
    for i, ids in expected_ids(pairs, "word_bpe_49k.json", 2):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert told(arrow_output.arrow_token_ids(odd), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert arrow_output.arrow_token_ids(empty).count() == 0


def test_arrow_sequences_are_views_with_masks(tmp_path):
    ids = [np.arange(k, k + 700, dtype="<u2") for k in range(0, 7000, 700)]
    import pyarrow as pa

    writer = arrow_output.Writer(f"{tmp_path}/part", np.dtype("<u2"), length=64, rows=3)
    for k, own in enumerate(ids):
        writer.add(pa.array([k]), [own])
    writer.close()
    reader, flat = arrow_output.Reader(f"{tmp_path}/part"), np.concatenate(ids)
    for i in (0, 5, 3, 100, 109):
        view, mask = reader.sequence(i)
        real = min(64, len(flat) - 64 * i)
        assert view[:real].tolist() == flat[64 * i : 64 * i + real].tolist() and mask.to_pylist() == [True] * real + [False] * (64 - real)
        assert not view.flags.owndata
    assert np.concatenate(list(reader.spans(123, 500))).tolist() == flat[123:623].tolist()


@pytest.mark.parametrize("length", [16, 1024])
def test_packing(odd, pairs, empty, length):
    want, at = [], 0
    whole = []
    for i, ids in expected_ids(pairs, "byte_bpe_50k.json", 0):
        start = 0
        while start < len(ids):
            n = min(len(ids) - start, length - at % length)
            want.append((i, start, n, len(ids), at // length, at % length, zlib.crc32(ids[start : start + n].tobytes())))
            start, at = start + n, at + n
        whole += ids.tolist()
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    columns = "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"
    assert told(packing.pack(odd, path, True, 0, length, digest=True), *columns) == want
    sequences = packing.sequences(packing.pack(odd, path, True, 0, length)).orderBy("sequence_id").collect()
    assert [x for r in sequences for x in np.frombuffer(r["ids"], "<u2").tolist()] == whole
    assert all(r["n_tokens"] == length for r in sequences[:-1])
    assert packing.byte_packing(empty).count() == 0


def test_exact_duplicates(odd, pairs, empty):
    groups: dict[str, list[int]] = {}
    for i, t in pairs:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    want = sorted((i, min(own), len(own), i == min(own), hashlib.sha256(t.encode()).hexdigest()) for t, own in groups.items() for i in own)
    columns = "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    assert told(exact_dedup.exact_duplicates(odd), *columns) == want
    kept = exact_dedup.without_exact_duplicates(odd)
    assert kept.columns == odd.columns and told(kept, "doc_id") == [(i,) for i, _, _, k, _ in want if k]
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_duplicates_over_many_partitions(spark):
    """A group of half of the rows fills several partitions; a repeated row counts, but one of the group stays."""
    rows = [(i, "copy of a text" if i % 2 else f"text {i}") for i in range(400)] + [(7, "copy of a text")]
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        out = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        got = out.groupBy("keep_id", "group_size").agg(F.count("*"), F.sum(F.col("kept").cast("int"))).where("group_size > 1").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [tuple(r) for r in got] == [(1, 201, 201, 1)]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_one_of_repeated_rows_stays(spark, partitions):
    """Ids that name two texts and rows that repeat: of equal texts one row with the smallest id stays."""
    rows = [(7, "t"), (7, "t"), (9, "t"), (1, "a"), (2, "a"), (2, "b"), (2, "b"), (3, "b"), (4, None), (4, ""), (5, "u  v"), (5, "u v"), (6, "u\tv"), (8, "alone"), (None, "t"), (None, "t")]
    rows += [(50 + k, "long text " * 30) for k in range(30)] + [(50, "long  text " * 30)] * 3
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, keep_id string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        out = exact_dedup.exact_duplicates(docs).collect()
        left = exact_dedup.without_exact_duplicates(docs)
        stay = sorted((r["doc_id"], SPACE.sub(" ", r["text"] or "")) for r in left.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    first: dict[str, int] = {}
    for i, t in sorted((i, SPACE.sub(" ", t or "")) for i, t in rows if i is not None):
        first.setdefault(t, i)
    assert sorted((r["doc_id"], r["text_sha256"]) for r in out if r["kept"]) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for t, i in first.items())
    assert len(out) == len(rows) - 2 and stay == sorted((i, t) for t, i in first.items())
    assert left.columns == docs.columns


def test_exact_edges_are_numbered_without_texts(spark):
    """What meets in one task to be numbered are partition numbers and sizes, not texts."""
    plan = exact_dedup.exact_duplicates(spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    below = [lines[k + 1] for k, line in enumerate(lines) if "Window [" in line]
    assert below and not any(re.search(r"(\[|, )(text|norm)#", line) for line in below)


def brute_rules(pairs):
    out = []
    for i, t in pairs:
        t = t or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows: dict[tuple, list[int]] = {}
        for k in range(len(words) - 4):
            windows.setdefault(tuple(words[k : k + 5]), []).append(k)
        covered = {p + d for own in windows.values() if len(own) > 1 for p in own for d in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed))
    return out


def brute_cleaned(rows, share=quality_rules.HOST_SHARE, least=quality_rules.HOST_DOCUMENTS, most=quality_rules.HOST_MOST):
    """(doc_id, text less the lines its host repeats, kept) of rows (doc_id, text, source) by plain counting."""
    normal = lambda x: SPACE.sub(" ", x).strip(" ").lower()
    lines = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    held, texts = {}, {}
    for _, t, host in rows:
        for x in lines(t):
            held.setdefault((host or "", normal(x)), set()).add(t)
            texts.setdefault(host or "", set()).add(t)
    gone = set()
    for (host, x), own in held.items():
        n = len(own)
        if n > least and n > share * len(texts[host]) or n > most and len(x.split(" ")) >= quality_rules.LINE_WORDS:
            gone.add((host, x))
    bad = {i for i, *_, failed in brute_rules([(i, t) for i, t, _ in rows]) if failed}
    out = []
    for i, t, host in rows:
        left = t if t is None else "\n".join(x for x in t.split("\n") if not (WORD.search(x) and (host or "", normal(x)) in gone))
        before, after = len(WORD.findall(t or "")), len(WORD.findall(left or ""))
        depleted = after < before and (100 * after < quality_rules.LEFT_PERCENT * before or after < quality_rules.LEFT_WORDS)
        out.append((i, left, i not in bad and not depleted))
    return out


def test_quality_figures(odd, pairs, empty):
    columns = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    assert told(quality_rules.quality_rules(odd), *columns) == brute_rules(pairs)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_count_distinct_texts_by_host(spark):
    """A line of many documents of a host goes, and with it documents that are little else; copies count once."""
    filler = lambda k: " ".join(f"w{k}x{j}" for j in range(14))
    menu = "Home  About us and our twelve other pages for all of you"
    rows = [(k, f"{menu}\n{filler(k)}", "a") for k in range(10)]
    rows += [(10, f"{menu} \none more", "a"), (11, f"{menu}\n{filler(11)}", "b"), (12, menu, "b")]
    rows += [(20 + k, filler(99), "c") for k in range(30)] + [(60, f"{menu}\n{menu.upper()}", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, share=0.5, least=5).collect()}
    assert got[3]["n_removed_words"] == 12 and got[3]["kept"]
    assert got[10]["n_removed_words"] == 12 and not got[10]["kept"] and not got[10]["base_failed"]
    assert got[11]["kept"] and got[12]["kept"] and got[12]["n_removed_words"] == 0
    assert all(got[20 + k]["kept"] for k in range(30)) and got[60]["n_removed_words"] == 0


def test_quality_rules_of_a_large_host(spark):
    """A long line far below the share goes above the absolute limit; a short one and one below it stay."""
    filler = lambda k: " ".join(f"w{k}x{j}" for j in range(14))
    long, short, rare = "all rights are reserved by the owner of this site", "read more here", "a line of nine words that few documents hold"
    most = quality_rules.HOST_MOST
    rows = [(k, filler(k), "big") for k in range(1000)]
    rows += [(2000 + k, f"{long}\nonly {k} two three four five", "big") for k in range(most + 1)]
    rows += [(3000 + k, f"{short}\n{filler(3000 + k)}", "big") for k in range(most + 1)]
    rows += [(4000 + k, f"{rare}\nonly {k} two three four five", "big") for k in range(most)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, most=most).collect()}
    assert all(got[2000 + k]["n_removed_words"] == 10 and not got[2000 + k]["kept"] for k in range(most + 1))
    assert all(r["kept"] and not r["n_removed_words"] for i, r in got.items() if not 2000 <= i < 3000)
    assert told(quality_rules.passing(docs), "doc_id") == [(i,) for i, *_ in rows if not 2000 <= i < 3000]


def test_cleaned_texts_lack_the_removed_lines(spark):
    """What goes is what the query counts: lines of the document's own host, in every spelling; the rest stays as it is."""
    filler = lambda k: " ".join(f"w{k}x{j}" for j in range(14))
    menu = "Home  About us and our twelve other pages for all of you"
    rows = [(k, f"{menu}\n\n {filler(k)}  \n{menu.upper()}\t", "a", k) for k in range(10)]
    rows += [(11, f"{menu}\n{filler(11)}", "b", 0), (12, menu, "a", 0), (13, None, "a", 0), (14, "", None, 0)]
    rows += [(3, f"{menu}\n{filler(3)}", "b", 0), (None, menu, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host long")
    out = quality_rules.cleaned(docs, share=0.5, least=5)
    assert out.columns == docs.columns and "Python" not in out._jdf.queryExecution().toString()
    want = [(k, f"\n {filler(k)}  ", "a", k) for k in range(10)] + [r for r in rows if r[0] in (11, 13, 14) or r[0] == 3 and r[2] == "b"] + [(12, "", "a", 0)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    words = lambda df: {r["doc_id"]: r["n"] for r in df.where("doc_id is not null").groupBy("doc_id").agg(F.sum(F.size(quality_rules.words_of(F.coalesce("text", F.lit(""))))).alias("n")).collect()}
    before, after = words(docs), words(out)
    told_ = {r["doc_id"]: r["n_removed_words"] for r in quality_rules.quality_rules(docs, share=0.5, least=5).collect()}
    assert {i: before[i] - after[i] for i in before} == told_ and told_[3] == 24


def gram_set(text, n=3):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_components(pairs, gram=3, percent=90):
    sets = {i: gram_set(t, gram) for i, t in pairs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            sizes = len(sets[a]), len(sets[b])
            if not min(sizes) or 100 * min(sizes) < percent * max(sizes):
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), root(i)) for i in ids]


def test_ngram_join(odd, pairs, empty):
    want = brute_components(pairs)
    assert told(ngram_join.similar_documents(odd), "doc_id", "n_shingles", "component_id") == want
    kept = ngram_join.without_near_duplicates(odd)
    assert kept.columns == odd.columns and told(kept, "doc_id") == [(i,) for i, _, c in want if i == c]
    assert ngram_join.similar_documents(empty).count() == 0


def test_ngram_join_of_a_large_group_in_blocks(spark, monkeypatch):
    """Near copies around and below the threshold, in buckets dealt over several blocks."""
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rnd.choice((0, 1, 1, 2, 3))):
            own[rnd.randrange(90)] = f"e{i}x{rnd.randrange(3)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(ngram_join, "BUCKET", 40)
    out = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert told(out, "doc_id", "n_shingles", "component_id") == brute_components(rows)


def near_pair(changed):
    """Two texts of 100 words; ``changed`` words of the second, far apart, are others."""
    words = [f"w{k}" for k in range(100)]
    return " ".join(words), " ".join(f"e{k}" if k and k % 30 == 0 and k <= 30 * changed else w for k, w in enumerate(words))


def test_ngram_join_by_other_lengths_and_limits(spark):
    """Of five words and 0.8: two changed words of 100 (86 of 106 grams) link, three (81 of 111) don't; 3 and 0.9 links neither."""
    rows = [(1, near_pair(2)[0]), (2, near_pair(2)[1])] + [(k, f"x{t}".replace(" ", " x")) for k, t in zip((3, 4), near_pair(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(ngram_join.similar_documents(docs, 5, 80), "doc_id", "n_shingles", "component_id") == [(1, 96, 1), (2, 96, 1), (3, 96, 3), (4, 96, 4)]
    assert told(ngram_join.without_near_duplicates(docs, 5, 80), "doc_id") == [(1,), (3,), (4,)]
    assert told(ngram_join.similar_documents(docs), "doc_id", "component_id") == [(k, k) for k in range(1, 5)]


def test_ngram_join_goes_on_only_with_what_is_new(spark, monkeypatch):
    """One pair to verify: no more rounds of it. Where later rounds find links, what is connected already goes on as stars."""
    calls, stars, verified, components = [], [], ngram_join.verified, ngram_join.connected_components
    monkeypatch.setattr(ngram_join, "verified", lambda *a: calls.append(a) or verified(*a))
    monkeypatch.setattr(ngram_join, "connected_components", lambda links: stars.append(components(links)) or stars[-1])
    rows = [(1, near_pair(1)[0]), (2, near_pair(1)[1]), (3, "another text of its own"), (4, None)]
    out = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert told(out, "doc_id", "n_shingles", "component_id") == brute_components(rows, 5, 80)
    assert len(calls) == 1 and len(stars) == 1

    rnd = random.Random(4)
    rows = []
    for g in range(6):  # walks: each text differs a little from one before it
        texts = [[f"g{g}w{k}" for k in range(60)]]
        for i in range(40):
            own = list(rnd.choice(texts[-6:]))
            own[rnd.randrange(60)] = f"g{g}e{i}"
            texts.append(own)
        rows += [(g * 100 + i, " ".join(own)) for i, own in enumerate(texts)]
    rnd.shuffle(rows)
    calls.clear(), stars.clear()
    monkeypatch.setattr(ngram_join, "BUCKET", 8)
    out = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert told(out, "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert len(stars) > 1


def test_frequency_sketch_counts_documents(spark):
    texts = ["a b c d", "a b c", "a b c a b c", None, "", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = np.zeros(1 << ngram_join.CELL_BITS, np.int64)
    for s in ngram_join.gram_sets(texts):
        np.add.at(want, (s >> np.uint64(64 - ngram_join.CELL_BITS)).astype(np.int64), 1)
    got = ngram_join.frequency_sketch(docs)
    assert got.dtype == np.uint16 and (got == (np.log2(1 + want) * 1024).astype(np.uint16)).all() and want.max() == 3


def test_ngram_bitmap_never_exceeds_the_difference():
    rnd = random.Random(2)
    sets = list(ngram_join.gram_sets([" ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.randint(3, 300))) for _ in range(40)]))
    odd_bits = [np.bincount((s & np.uint64(1023)).astype(int), minlength=1024) & 1 for s in sets]
    for a in range(40):
        for b in range(a):
            assert (odd_bits[a] != odd_bits[b]).sum() <= len(np.setxor1d(sets[a], sets[b]))


@pytest.mark.parametrize("chunk", [16, 23, 200, sentencepiece_scan.CHUNK])
def test_sentencepiece_scan(odd, pairs, empty, chunk):
    """Chunked encoding equals the sequential best path, and decodes to the text."""
    path = bpe.tokenizer_path("piece_bpe_32k.model")
    pieces = sentencepiece_scan.Pieces(path)

    def brute(text):
        if not text:
            return 0.0, []
        score, back = pieces.reach(text, 0, len(text), {0: 0.0})
        cuts = [len(text)]
        while cuts[-1]:
            cuts.append(int(back[cuts[-1]]))
        return float(score[-1]), pieces.ids_between(text, cuts[::-1])

    short = odd.where(F.length("text").isNull() | (F.length("text") < 6000))
    want = [(i, *brute(pieces.normal(t))) for i, t in pairs if t is None or len(t) < 6000]
    encoded = sentencepiece_scan.encode(short, path, chunk)
    assert sorted((r["doc_id"], r["score"], np.frombuffer(r["ids"], "<u4").tolist()) for r in encoded.collect()) == want
    if chunk == 23:
        texts = {i: t for i, t in pairs}
        assert all(r["text"] == (texts[r["doc_id"]] or "").replace("▁", " ") for r in sentencepiece_scan.decode(encoded, path).collect())
        assert sentencepiece_scan.encode(empty, path, chunk).count() == 0


@pytest.mark.parametrize("chunk", [16, 200, sentencepiece_scan.CHUNK])
def test_sentencepiece_ids_are_the_library_s(odd, pairs, empty, chunk):
    import sentencepiece

    path = bpe.tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(i, sum(map(lib.get_score, lib.encode(t or ""))), lib.encode(t or "")) for i, t in pairs]
    encoded = sentencepiece_scan.merged(odd, path, chunk)
    assert sorted((r["doc_id"], r["score"], np.frombuffer(r["ids"], "<u4").tolist()) for r in encoded.collect()) == want
    assert sentencepiece_scan.merged(empty, path, chunk).count() == 0


def test_sentencepiece_query_gives_the_library_s_ids(spark, odd, pairs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path("piece_bpe_32k.model"))
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    for df, rows in ((odd, pairs), (spark.createDataFrame(docs, "doc_id long, text string"), sorted(docs))):
        want = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(lib.decode(ids))) for i, ids in ((i, lib.encode(t or "")) for i, t in rows)]
        assert told(sentencepiece_scan.encoded_documents(df), "doc_id", "n_pieces", "ids_crc32", "n_chars") == want


def test_sentencepiece_decodes_as_the_library(pairs):
    import sentencepiece

    path = bpe.tokenizer_path("piece_bpe_32k.model")
    lib, pieces = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_scan.Pieces(path)
    for _, t in pairs:
        ids = lib.encode(t or "")
        assert pieces.decode(ids) == lib.decode(ids)


def labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language_id_held_out_accuracy(spark):
    docs, _ = labelled(spark, SF01)
    rows = language_id.predicted_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_language_id_of_odd_texts(odd, pairs, empty):
    texts = dict(pairs)
    out = language_id.predicted_languages(odd).collect()
    assert len(out) == len(pairs)
    for r in out:
        lettered = any(map(str.isalpha, texts[r["doc_id"]] or ""))
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1
    kept = language_id.recognised(odd, least=0.0)
    assert kept.columns == odd.columns and kept.count() == sum(r["lang_pred"] != "und" for r in out)
    assert language_id.predicted_languages(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.predicted_languages(unlabelled).collect()} == {"und"}


def test_language_decision_is_hierarchical():
    """A language wins only within the family that won."""
    x = lambda yes, no: language_id.Linear(yes, no, np.zeros(1), 0.0)
    model = language_id.LanguageModel({"germanic": ["de", "en"], "romance": ["es", "fr"]}, [x("germanic", "romance")], {"germanic": [x("de", "en")], "romance": [x("es", "fr")]})
    lang, score = model.decide(np.array([[3.0, -3.0, 3.0], [-3.0, 3.0, -0.1], [-0.01, 9.0, 9.0]]))
    assert lang.tolist() == ["en", "fr", "es"] and score[0] > 0.99 and 0.4 < score[2] < 0.6


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores)) + 1
    n = labels.sum()
    return (rank[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    assert all(r["predicted"] == int(r["score"] >= 0.5) and crc(r["doc_id"]) % 5 == 0 for r in rows)
    assert auc(s, y) > 0.95 and ((s >= 0.5) == y).mean() > 0.96


def test_toxicity_ignores_language_and_sees_whole_texts(spark):
    """A word at the end of a very long text counts; lang moves the threshold, never the score."""
    good, bad = "fine words about calm rivers", "you total scoundrel go"
    rows = [(i, f"{good} number{i} " * 3 + (bad if i % 3 == 0 else "more calm things"), ("en", "de")[i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")), F.lit(True))
    tests = [(1, "calm rivers " * 200_000 + "scoundrel you total scoundrel", "en"), (2, "calm rivers " * 200_000, None), (3, bad, "en"), (4, bad, "xx"), (5, None, "en"), (6, "", None)]
    got = {r["doc_id"]: r for r in toxicity.toxicity(spark.createDataFrame(tests, "doc_id long, text string, lang string"), model).collect()}
    assert [got[k]["predicted"] for k in (1, 2, 3, 5)] == [1, 0, 1, 0]
    assert got[3]["score"] == got[4]["score"] and got[5]["score"] == got[6]["score"]


def tap_model():
    """A model whose first filter of each width adds up what words of known buckets hold."""
    rnd = np.random.default_rng(3)
    taps = [rnd.normal(size=(w, toxicity.SIZE, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    # float16 keeps these exactly, so that a model and its broadcast form agree
    table = rnd.normal(size=(toxicity.BUCKETS, toxicity.SIZE)).astype(np.float16).astype(np.float32)
    return toxicity.ToxicityModel(table, np.ones(toxicity.BUCKETS, bool), taps, np.zeros(n), rnd.normal(size=n) / 30, 0.0, {None: 0.5})


def brute_score(model, text):
    """Score of one text alone: windows start on its words and reach into pads; one pad stands for no words."""
    ids = np.array([toxicity.word_buckets(w) for w in (text or "").split() or [""]] + [[-1] * toxicity.PARTS] * 2)
    x, pooled = toxicity.vectors_of(model.embeddings, ids), []
    for w, tap in zip(toxicity.WIDTHS, model.taps):
        pooled.append(np.max([sum(x[i + k] @ tap[k] for k in range(w)) for i in range(len(x) - 2)], axis=0))
    return float(model.score(np.concatenate(pooled)[None])[0])


def test_toxicity_score_is_of_the_text_alone(spark, monkeypatch):
    """Next to other texts, in any order and batch, cut or whole, a text has the same score."""
    model = tap_model()
    texts = [None, "", " \n", "calm", "toxic words here", "calm river", "toxic", "a calm river of many slow words " * 9, "calm", ""]
    want = [brute_score(model, t) for t in texts]
    got = set()
    for seed, rows in ((0, "1"), (1, "3"), (2, "100")):
        order = list(range(len(texts)))
        random.Random(seed).shuffle(order)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            docs = spark.createDataFrame([(i, texts[i], "en") for i in order], "doc_id long, text string, lang string").coalesce(1)
            got.add(tuple(told(toxicity.toxicity(docs, model), "doc_id", "score")))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1
    assert [s for _, s in got.pop()] == pytest.approx(want, abs=1e-5)


def test_toxicity_pools_cut_texts_like_whole_ones():
    """Windows of a text that goes on end on its words; pads belong to no maximum."""
    model, words = tap_model(), [f"w{k}" for k in range(9)]
    rows = lambda own: model.parts(toxicity.vectors_of(model.embeddings, np.array([toxicity.word_buckets(w) for w in own])))
    whole = toxicity.pool(rows([*words, "", ""]), np.array([0]), np.array([9]))
    for cut in range(10):
        head, rest = words[:cut], words[max(0, cut - 2) :]
        flat, starts = [*head, "", "", *rest, "", ""], np.array([0, len(head) + 2])
        parts = toxicity.pool(rows(flat), starts, np.array([len(head), len(rest)]), np.array([True, False]))
        assert (parts.max(axis=0) == whole[0]).all()
    beside = toxicity.pool(rows(["calm", "", "", *words, "", ""]), np.array([0, 3]), np.array([1, 9]))
    assert (beside[0] == toxicity.pool(rows(["calm", "", ""]), np.array([0]), np.array([1]))[0]).all()


def test_quality_rank_held_out(spark):
    docs, labels = labelled(spark, SF01)
    rows = quality_rank.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert auc(s, y) > 0.95 and ((s >= 0.3) == y).mean() > 0.95


def brute_figures(text):
    """The features of a text by plain counting."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    chars = "".join(words)
    n, c, k = max(1, len(words)), max(1, len(chars)), max(1, len(lines))
    alpha, digits, symbols = sum(x.isalpha() for x in chars), sum(x.isdigit() for x in chars), sum(x in "#*$%&|<>" for x in chars)
    of_chars = [alpha, sum(x.isupper() for x in chars), digits, symbols, len(chars) - alpha - digits - symbols]
    tests = [lambda w: not any(map(str.isalpha, w)), lambda w: w.isupper() and len(w) > 1, lambda w: any(x in "#*$%&|<>" for x in w), lambda w: w[-1] in ".!?", lambda w: len(w) > 20]
    of_words = [sum(map(t, words)) for t in tests]
    pairs = list(zip(words, words[1:]))
    return (
        [(x / c) ** 0.5 for x in of_chars] + [(x / n) ** 0.5 for x in of_words] + [len(chars) / n / 10, len(set(words)) / n, ((len(pairs) - len(set(pairs))) / n) ** 0.5, (sum(a == b for a, b in pairs) / n) ** 0.5]
        + [((len(lines) - len(set(lines))) / k) ** 0.5, np.log1p(len(words)) / 5, np.log1p(len(words) / k) / 3, float(not words)]
    )


def test_quality_figures_by_plain_counting():
    texts = [t or "" for t in odd_texts()] + ["one line here\n" * 50, "a a a b a\n\n \na a a b a", "x\ny " * 40 + "\n" + "long " * 30]
    want = np.array([brute_figures(t) for t in texts])
    for limit in (1 << 20, 50, 7):
        np.testing.assert_allclose(quality_rank.document_figures(texts, limit), want, atol=1e-12)


def test_quality_strengths_rank_pairs():
    """The fitted weights are where the loss over the pairs has no slope, and a score is the logistic of the strength."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, quality_rank.N_FIGURES))
    labels = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    model = quality_rank.train(x, labels)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -4, 4)
    strength = np.concatenate([z, z * z / 4], axis=1) @ model.weights
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(strength - model.threshold + np.log(3 / 7)))))
    assert np.mean(strength[labels == 1][:, None] > strength[labels == 0][None, :]) > 0.95
    assert ((model.score(x) >= 0.3) == (strength >= model.threshold)).all()


def test_language_margins_are_sums_over_ngrams(spark):
    """A text's margins are those of the direct sum over all n-grams of all its words, whole or in segments."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = language_id.learn(docs, ~common.held_out(3, 1))
    texts = [r["text"] for r in docs.limit(30).collect()] + ["", "12 34", "Ünï", "a " * 500]
    lang, score = language_id.predictor(model)(texts)
    for t, own, p in zip(texts, lang, score):
        used = [g for w in t.split() for g in language_id.grams(w)]
        if not any(map(str.isalpha, t)):
            assert (own, p) == ("und", 0.0)
            continue
        margins = np.array([[30.0 * sum(x.weights[g] for g in used) / len(used) + x.bias for x in model.linears]])
        want, chance = model.decide(margins)
        assert own == want[0] and abs(p - chance[0]) < 1e-6


def test_languages_without_labels_keep_what_has_letters(spark):
    rows = [(1, "some text", None), (2, "12 34", None), (3, None, None), (None, "x", None), (4, "é", None)]
    left = language_id.recognised(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert told(left, "doc_id") == [(1,), (4,)]


@pytest.mark.parametrize("op, column", [(toxicity, "toxic"), (quality_rank, "quality")])
def test_scores_of_odd_texts(spark, odd, pairs, empty, op, column):
    labels = spark.createDataFrame([(i, i % 2) for i, _ in pairs] + [(None, 1), (9999, 0)], f"doc_id long, {column} int")
    rows = op.scored(odd, labels).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in pairs] and all(0 <= r["score"] <= 1 for r in rows)
    one_class = labels.withColumn(column, F.lit(1))
    assert all(r["predicted"] == 1 for r in op.scored(odd, one_class).collect())
    assert op.scored(odd, labels.where("false")).count() == len(pairs)
    assert op.scored(empty, labels).count() == 0


def test_queries_read_their_tables(spark):
    from rentscope.llm.queries import QUERIES

    for name in ("op2_quality_rules", "op4_token_counts"):
        assert QUERIES[name](spark, SF001).count() == 200


def test_new_words_are_filled_a_few_at_a_time():
    """What a fill takes besides its rows is bounded, however many new words a call has; rows stay those of the words."""
    asked = []

    def fill(words):
        asked.append(len(words))
        return np.array([[int(w), len(w)] for w in words], np.int64).reshape(-1, 2)

    words = common.Words(fill, kept=9_000)
    for first in (0, 5_000, 2_500):
        flat = [str(k % 11_000) for k in range(first, first + 20_000)]
        assert words.of(flat).tolist() == [[int(w), len(w)] for w in flat]
    assert max(asked) <= 4096 < sum(asked)


def test_ids_of_many_new_words_in_one_call_are_the_librarys():
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    encoder, lib = bpe.LibraryEncoder(path, True, 6_000), Tokenizer.from_file(path)
    for first in (0, 4_000):
        text = " ".join(f"w{k % 9_500}é{k}" for k in range(first, first + 10_000))
        assert encoder.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_a_language_worker_needs_little_memory_besides_its_table():
    """A call with many new words takes less than their n-grams would all at once."""
    rnd = np.random.default_rng(3)
    vote = language_id.Linear("de", "en", rnd.normal(size=language_id.BUCKETS), 0.0)
    model = language_id.LanguageModel({"germanic": ["de", "en"]}, [], {"germanic": [vote]})
    text = " ".join("".join(chr(97 + x) for x in w) for w in rnd.integers(0, 26, (40_000, 12)))
    predict = language_id.predictor(model)
    tracemalloc.start()
    predict([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
