"""Tables of a block go at its end; kept ones stay or pass to the block around."""

import os

import pytest

from tideline.session import Scratch, discard, materialise


def _folder(table):
    return table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")


def test_blocks_remove_what_is_not_kept(spark):
    outside = materialise(spark.range(3))
    with Scratch() as outer:
        one = materialise(spark.range(5))
        with Scratch() as inner:
            two = materialise(one.where("id > 1"))
            kept = inner.keep(materialise(two.where("id > 2")))
            gone, stays = _folder(two), _folder(kept)
        assert not os.path.exists(gone) and os.path.exists(stays) and os.path.exists(_folder(one))
        assert sorted(r.id for r in kept.collect()) == [3, 4]
        folder = _folder(one)
    assert not os.path.exists(folder) and not os.path.exists(stays)
    assert outside.count() == 3
    discard(outside)


def test_a_union_keeps_all_its_tables_and_an_error_keeps_none(spark):
    with Scratch() as scratch:
        both = scratch.keep(materialise(spark.range(2)).union(materialise(spark.range(3).where("id < 0"))))
    assert both.count() == 2
    with pytest.raises(RuntimeError), Scratch():
        table = materialise(spark.range(2))
        folder = _folder(table)
        raise RuntimeError
    assert not os.path.exists(folder)
