"""Token counts: Arrow functions that encode in batches balanced by bytes and return lengths only.

A null text counts as empty; empty texts have 0 tokens. Long texts are split at safe boundaries (see ``encoding``), so
that calls to the library are small but for texts that have none, and for sentencepiece models, which get
texts whole. Repeated rows are
counted row by row; an empty table gives an empty result; columns beside the two named ones are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .encoding import default_path, encoder, gathered


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each row."""
    path = tokenizer or default_path("byte_bpe_50k.json")

    def count(batches):
        lengths = encoder(path).lengths
        for b in gathered(batches, 1):
            text = pc.fill_null(b.column(1), "")
            n = pa.array(lengths(text), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(pc.binary_length(text), pa.int64()), n, pc.greater(n, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
