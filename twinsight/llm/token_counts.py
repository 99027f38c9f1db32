"""Token counts with a shortcut for words that are one token."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsight.llm.text import col, words_of, worker_state
from twinsight.llm.vocabulary import ChunkEncoder, Remembered, whole_tokens


def with_token_counts(
    df: DataFrame, tokenizer_file: str, text: str = "text", limit: int = 2048, counts: str = "n_tokens"
) -> DataFrame:
    """``df`` with ``n_bytes``, the token count and ``over_limit`` of every whole text.

    The driver proves which vocabulary strings are one token each; tasks count those directly
    and merge only other pre-tokens, each distinct one once per worker. One scan, no shuffle:
    only the text goes through Python.

    A null or empty text has 0 bytes and 0 tokens. Rows are independent: repeated rows and ties
    get equal counts, an empty table gives an empty one. Columns of ``df`` with the three new
    names are replaced; all others are kept whatever they are called.
    """
    source = Path(tokenizer_file).read_text()
    shared = df.sparkSession.sparkContext.broadcast((source, whole_tokens(source)))  # bound by the vocabulary

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def build():
            encoder = ChunkEncoder(*shared.value)
            return encoder.lowered, Remembered(lambda chunk: len(encoder.ids(chunk)) // 4)

        lowered, table = worker_state("token_counts", build, tokenizer_file)
        for batch in batches:
            sizes = [sum(map(table.__getitem__, words_of(lowered(t.encode())))) if t else 0 for t in batch]
            yield pd.Series(sizes, dtype="int64")

    tokens = F.pandas_udf(count, "long")(col(text))
    return df.withColumns(
        {"n_bytes": F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long"), counts: tokens}
    ).withColumn("over_limit", col(counts) > F.lit(limit))
