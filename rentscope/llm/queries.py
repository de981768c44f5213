"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from rentscope.llm import arrow_output, byte_bpe, collocations, common, exact_dedup, language_id, ngram_join, packing, quality_rank, quality_rules, sentencepiece_scan, spelling_groups, token_counts, toxicity


def _over(fn):
    """A query that applies ``fn`` to the whole of documents."""

    def query(spark, sf_dir):
        return fn(common.documents(spark, sf_dir))

    return query


def _labelled(fn):
    """A query that applies ``fn`` to the whole of documents and of labels."""

    def query(spark, sf_dir):
        return fn(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

    return query


QUERIES = {
    "op1_toxicity": _labelled(toxicity.scored),
    "op2_quality_rules": _over(quality_rules.quality_rules),
    "op3_ngram_join": _over(ngram_join.similar_documents),
    "op4_token_counts": _over(token_counts.word_token_counts),
    "op5_language_id": _over(language_id.predicted_languages),
    "op6_sentencepiece": _over(sentencepiece_scan.encoded_documents),
    "op7_arrow_token_ids": _over(arrow_output.arrow_token_ids),
    "op8_exact_dedup": _over(exact_dedup.exact_duplicates),
    "op9_quality_rank": _labelled(quality_rank.scored),
    "op10_packing": _over(packing.byte_packing),
    "op11_collocations": _over(collocations.collocations),
    "op12_spelling_groups": _over(spelling_groups.spelling_groups),
    "op13_byte_bpe": _over(byte_bpe.byte_round_trips),
}

ORACLE = {
    "op2_quality_rules": quality_rules.SQL,
    "op3_ngram_join": ngram_join.SQL,
    "op8_exact_dedup": """
        with normal as (
          select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm
          from documents where doc_id is not null)
        select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
               row_number() over (partition by norm order by doc_id) = 1 as kept, sha256(norm) as text_sha256
        from normal window same as (partition by norm)""",
    "op11_collocations": collocations.SQL,
}
