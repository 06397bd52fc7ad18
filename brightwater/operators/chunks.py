"""Documents to chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.functions.chunking import STRATEGIES


def chunk_documents(
    documents: DataFrame, strategy: str = "fixed", key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """One row per chunk: ``id``, ``chunk_index`` from 0, ``chunk_text`` and the other columns.

    The id is the document key and the index, so a rerun gives the same ids.
    """
    cut = STRATEGIES[strategy](F.col(text), **options)
    others = [c for c in documents.columns if c != text]
    return documents.select(*others, F.posexplode(cut).alias("chunk_index", "chunk_text")).select(
        F.concat_ws("-", F.col(key).cast("string"), F.col("chunk_index").cast("string")).alias(
            "id"
        ),
        *others,
        "chunk_index",
        "chunk_text",
    )
