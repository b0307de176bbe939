"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A missing id sorts after every other.
NO_ID = 2**63 - 1


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_back(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts, for sizing partitions."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
