"""Reading the input tables, and lineage cuts as tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.lineage import cut

__all__ = ["cut", "held_out", "may_learn", "table", "texts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: other columns cannot clash with what operators add."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )


def held_out(doc_id: str = "doc_id"):
    """Whether labels of a document stay unseen: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def may_learn(doc_id: str = "doc_id"):
    """Whether labels of a document may be learned from: it has an id, and is not held out."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)
