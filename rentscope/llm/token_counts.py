"""Token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.llm.bpe import rank_bpe, tokenizer_path
from rentscope.llm.common import pick

LIMIT = 2048


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of each whole text; no shuffle.

    ``path``: a BPE vocabulary in the tokenizers library's JSON form with byte
    symbols and a word-end suffix. The pre-tokens that a batch of texts brings
    up are held as one ragged array; each step merges, in every sequence at
    once, the pair that ranks lowest there, until none is left. Counts equal
    the library's without begin, end or added tokens; strings of special
    tokens inside a text count one each.

    Null and empty texts have 0 bytes and 0 tokens. Rows without doc_id name no
    document and are left out; rows that repeat a doc_id are counted each. Other
    columns are ignored; an empty table gives none.
    """

    def count(batches):
        bpe = rank_bpe(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            n = bpe.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = pick(docs, "doc_id", "text").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")


def word_token_counts(docs: DataFrame) -> DataFrame:
    return token_counts(docs, tokenizer_path("word_bpe_49k.json"))
