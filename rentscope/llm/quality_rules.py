"""Quality rules over DataFrame functions only: figures of each text, and lines that a host repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.llm.common import SENT_IDS, keeping, pick, written

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
NO_SYMBOL = r"[^#*$%&|<>]+"
#: A line is removed when more of its host's documents hold it than this share, and than this many.
HOST_SHARE, HOST_DOCUMENTS = 0.1, 5
#: Where a host is large: a line of so many words goes when more than so many of its host's documents hold it, whatever their share.
HOST_MOST, LINE_WORDS = 30, 8
#: A document is depleted when less than this percentage of its words, or fewer words, are left.
LEFT_PERCENT, LEFT_WORDS = 30, 10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in ``words``, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def places(s: Column) -> Column:
            twin = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["at"]))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda p, i: F.when(i == 0, F.lit(5)).otherwise(F.least(F.lit(5), p - F.get(at, i - 1))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(placed, places), total)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return let(words, lambda w: F.when(F.size(w) < 5, F.lit(0)).otherwise(let(windows(w), counted))).cast("long")


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each text."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", NO_SYMBOL, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def normal_line(raw: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(raw, SPACE, " ")))


def host_of() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, host, content, line, n_words: the lines with a word, normalised and hashed."""
    rows = pick(docs, "doc_id", "source", "text").where(F.col("text").isNotNull())
    rows = rows.select("doc_id", host_of().alias("host"), F.xxhash64("text").alias("content"), F.explode(F.split("text", "\n")).alias("raw"))
    rows = rows.where(F.col("raw").rlike(WORD))
    rows = rows.select("doc_id", "host", "content", normal_line(F.col("raw")).alias("normal"))
    return rows.select("doc_id", "host", "content", F.xxhash64("normal").alias("line"), F.size(F.split("normal", " ")).cast("long").alias("n_words"))


def host_lines(lines: DataFrame, share: float = HOST_SHARE, least: int = HOST_DOCUMENTS, most: int | None = HOST_MOST) -> DataFrame:
    """host, line: those that more than ``share`` of the host's documents hold, and more than ``least``.

    Also those of LINE_WORDS words or more that over ``most`` of them hold (None:
    no such limit), so that the limit doesn't rise with the host; shorter lines,
    which may be common by chance, need the share.

    Documents count as distinct contents, so that copies of one text don't make
    its lines frequent. Rows are first reduced to one for each (host, line,
    content), which spreads a line that a third of all documents hold.
    """
    held = lines.select("host", "line", "content", "n_words").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("n_words"))
    hosts = lines.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    often = held.where(F.col("n_docs") > (least if most is None else min(least, most))).join(hosts, "host")
    frequent = (F.col("n_docs") > least) & (F.col("n_docs") > share * F.col("host_docs"))
    if most is not None:
        frequent |= (F.col("n_docs") > most) & (F.col("n_words") >= LINE_WORDS)
    return often.where(frequent).select("host", "line")


def removed_lines(docs: DataFrame, share: float = HOST_SHARE, least: int = HOST_DOCUMENTS, most: int | None = HOST_MOST) -> DataFrame:
    """doc_id, host, gone (hashes of the lines that go), n_removed_words (in all their occurrences) where lines go."""
    lines = lines_of(docs)
    rows = lines.join(host_lines(lines, share, least, most), ["host", "line"])
    return rows.groupBy("doc_id", "host").agg(F.collect_set("line").alias("gone"), F.sum("n_words").alias("n_removed_words"))


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs``, all columns, with texts less the lines that ``removed`` (of ``removed_lines``) names; no document goes.

    What is left of a text keeps its bytes and order; a text that is nothing
    else becomes empty, null stays null. A column n_chars is told anew where
    lines go. Rows without doc_id are left out.
    """
    gone = removed.select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("gone").alias("_gone"))
    rows = docs.where(F.col("doc_id").isNotNull()).join(gone, (F.col("doc_id") == F.col("_id")) & (host_of() == F.col("_host")), "left")
    stays = lambda x: ~(x.rlike(WORD) & F.array_contains(F.col("_gone"), F.xxhash64(normal_line(x))))
    left = F.array_join(F.filter(F.split("text", "\n"), stays), "\n")
    rows = rows.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return rows.select(*docs.columns)


def cleaned(docs: DataFrame, share: float = HOST_SHARE, least: int = HOST_DOCUMENTS, most: int | None = HOST_MOST) -> DataFrame:
    """``docs`` as ``without_lines`` leaves them of the lines over the limits."""
    return without_lines(docs, removed_lines(docs, share, least, most))


def verdicts(docs: DataFrame, removed: DataFrame, left_percent: int = LEFT_PERCENT, left_words: int = LEFT_WORDS) -> DataFrame:
    """The figures of each document, n_removed_words and kept, given the lines ``removed``."""
    removed = removed.groupBy("doc_id").agg(F.sum("n_removed_words").alias("n_removed_words"))
    rows = figures(docs).join(removed, "doc_id", "left")
    rows = rows.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((100 * left < left_percent * F.col("n_words")) | (left < left_words))
    return rows.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_rules(docs: DataFrame, share: float = HOST_SHARE, least: int = HOST_DOCUMENTS, left_percent: int = LEFT_PERCENT, left_words: int = LEFT_WORDS, most: int | None = HOST_MOST) -> DataFrame:
    """One row a document: the figures of ``figures``, n_removed_words and kept.

    Words are runs of characters other than ASCII white space. Lines that a
    host (``source``; null is a host of its own) repeats over the limits of
    ``host_lines`` are removed; a document is rejected when it failed the base
    rules, or when lines were removed and less than ``left_percent`` of its
    words or fewer than ``left_words`` words are left.

    Null and empty texts have no words, so they fail the base rules. Rows
    without doc_id are left out; rows that repeat a doc_id pool what is removed
    of them; other columns are ignored; an empty table gives none.
    """
    return verdicts(docs, removed_lines(docs, share, least, most), left_percent, left_words)


def passing(docs: DataFrame, most: int | None = HOST_MOST) -> DataFrame:
    """``docs`` less the rows that the rules reject, with texts less the removed lines; all columns stay.

    The lines that go are sent to the texts if they and their documents are SENT_IDS at most; else texts are shuffled.
    """
    removed = written(removed_lines(docs, most=most), "removed-lines")
    n = removed.agg(F.sum(F.size("gone") + 1)).first()[0] or 0
    sent = F.broadcast(removed) if n <= SENT_IDS else removed
    return keeping(without_lines(docs, sent), verdicts(docs, removed).select("doc_id", "kept"))


SQL = rf"""
    with base as (
      select doc_id, coalesce(source, '') as host, text is null as no_text, coalesce(text, '') as t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
      from documents where doc_id is not null),
    line_rows as (
      select doc_id, host, t, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) as normal
      from (select doc_id, host, t, unnest(string_split(t, chr(10))) as line from base where not no_text)
      where regexp_matches(line, '[^\x20\x09-\x0D]')),
    often as (
      select host, normal from
        (select host, normal, count(distinct t) as n, len(string_split(normal, ' ')) as words from line_rows group by all)
        join (select host, count(distinct t) as of_host from line_rows group by all) using (host)
      where n > {HOST_DOCUMENTS} and n > {HOST_SHARE}::double * of_host or n > {HOST_MOST} and words >= {LINE_WORDS}),
    removed as (
      select doc_id, sum(len(string_split(normal, ' '))) as gone
      from line_rows join often using (host, normal) group by doc_id),
    twins as (
      select doc_id, count(*) - count(distinct line) as dup from line_rows group by doc_id),
    placed as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as nr from base),
    five as (
      select doc_id, nr, x || ' ' || lead(x, 1) over d || ' ' || lead(x, 2) over d || ' ' || lead(x, 3) over d || ' ' || lead(x, 4) over d as g,
             lead(x, 4) over d is not null as whole
      from placed window d as (partition by doc_id order by nr)),
    again as (
      select doc_id, nr from five where whole qualify count(*) over (partition by doc_id, g) > 1),
    covered as (
      select doc_id, count(distinct q) as n
      from (select doc_id, unnest([nr, nr + 1, nr + 2, nr + 3, nr + 4]) as q from again) group by doc_id),
    told as (
      select doc_id, len(w)::bigint as n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
             coalesce(dup, 0)::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
             coalesce(gone, 0)::bigint as n_removed_words
      from base left join twins using (doc_id) left join covered using (doc_id) left join removed using (doc_id))
    select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
           not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
           and not (n_removed_words > 0 and (100 * (n_words - n_removed_words) < {LEFT_PERCENT} * n_words
                                             or n_words - n_removed_words < {LEFT_WORDS})) as kept
    from told"""
