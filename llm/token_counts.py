"""Token counts by rank-synchronous merging of ragged symbol arrays.

Each task splits whole texts into pre-tokens, holds the different ones as one ragged numpy array of symbols,
and in every step merges, in all sequences at once, the pair with the lowest rank of the sequence. The symbols
that survive are the tokens. There is no shuffle: the result streams with the scan.

* A null text counts as empty: 0 bytes, 0 tokens. Null ids are kept. Repeated rows give repeated results.
* Strings of added tokens inside a text are one token each, as the vocabulary's own library has it by default.
* Texts are never cut. Other columns of the input are ignored. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from llm.arrays import chunks
from llm.pretokens import PieceMemory, pieces
from llm.rank_merge import merger
from llm.tables import texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, with the vocabulary file at ``path``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = PieceMemory(lambda new: merger(path).encode(new)[1].tolist())
        for chunk in chunks(batches, "text"):
            whole = chunk.column(1).to_pylist()
            lists = [pieces(t) for t in whole]
            of = memory.lookup(lists)
            tokens = [sum(map(of, words)) for words in lists]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column(0),
                    pa.array([len(t.encode()) for t in whole], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs, id_col, text_col).mapInArrow(count, SCHEMA)
