"""Cleaning job: pack -> wide row -> range filter -> known sensors -> gap filling -> annotation."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.senml import parse_pack, to_pack
from tideline.operators.clean import (
    annotate,
    annotate_by_choice,
    interpolate_blocks,
    null_out_of_range,
)
from tideline.operators.membership import BloomTable, bloom_filter, keep_members
from tideline.session import materialise
from tideline.specs import BLOCK_SIZE, Dataset


def clean(
    packs: DataFrame,
    spec: Dataset,
    order: Seq[str],
    keys: Seq[str] | None = None,
    members: DataFrame | BloomTable | None = None,
    dimension: DataFrame | None = None,
    size: int = BLOCK_SIZE,
) -> DataFrame:
    """Cleaned wide rows; the columns beside ``pack`` are kept, ``order`` among them."""
    keys = [spec.id_field] if keys is None else keys
    # The rows are counted per key and then numbered: written once, parsed once.
    rows = materialise(before_blocks(packs, spec, members))
    filled = interpolate_blocks(rows, spec.interpolated, keys, order, size)
    return add_annotation(filled, spec, dimension)


def before_blocks(
    packs: DataFrame, spec: Dataset, members: DataFrame | BloomTable | None = None
) -> DataFrame:
    """The part without memory, for batches and streams alike."""
    rows = null_out_of_range(parse_pack(packs, spec), spec.ranges)
    if isinstance(members, BloomTable):
        return bloom_filter(rows, members, spec.id_field)
    return keep_members(rows, members, spec.id_field)


def add_annotation(rows: DataFrame, spec: Dataset, dimension: DataFrame | None = None) -> DataFrame:
    if dimension is not None:
        return annotate(rows, dimension, [spec.id_field])
    return annotate_by_choice(rows, spec, spec.id_field)


def packed(rows: DataFrame, spec: Dataset, keep: Seq[str] = ()) -> DataFrame:
    """Wide rows -> pack text for the cleaned topic and collection."""
    annotated = all(c in rows.columns for c in spec.annotation_names)
    return rows.select(*[F.col(c) for c in keep], to_pack(spec, annotated=annotated).alias("pack"))
