"""Model swap on a running stream: rows meet control messages in one state machine.

Every shard of the rows holds the known versions of the models, (since, kind, model), and its
rows wait until the watermark passes their time. Then every control message for that time
has come, and a row leaves with the version in force at its time, whatever the order in which
rows and messages arrived. Rows are dealt to shards by all their columns, so a hot sensor
spreads; control messages are few and go to every shard. Versions older than the one in force
at the watermark are dropped from the state.

A model is text in JSON: weights of a regression, or the node table of a tree, so both kinds
are scored by expressions that read the row's own version.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence as Seq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.operators.joins import asof_join
from tideline.operators.scoring import Split
from tideline.streaming.stateful import _STORE, _STORE_CONF, _plain

REGRESSION_JSON = "struct<intercept: double, weights: array<double>>"
TREE_JSON = "struct<depth: int, nodes: array<struct<field: int, threshold: double, left: int, right: int, label: int>>>"

_VERSION = "since long, kind string, model string"
_AT, _US, _KIND, _MODEL, _SHARD = "__at", "__us", "__kind", "__model", "__shard"


def model_column(kind: str) -> str:
    return f"model_{kind}"


class InForce(StatefulProcessor):
    """Rows of a shard, each with the versions in force at its time."""

    def __init__(self, names: Seq[str], rows: T.StructType, kinds: Seq[str]) -> None:
        self.names, self.kinds = list(names), list(kinds)
        self.rows = T.StructType([*rows.fields, T.StructField(_US, T.LongType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getListState("versions", _VERSION)
        self.waiting = handle.getListState("waiting", self.rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).set_axis(self.names, axis=1)
        control = frame[frame[_KIND].notna()]
        for r in control[[_US, _KIND, _MODEL]].itertuples(index=False, name=None):
            self.versions.appendValue(tuple(map(_plain, r)))
        new = frame[frame[_KIND].isna()][self.rows.names]
        yield from self._release(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(None, timerValues.getCurrentWatermarkInMs())

    def _release(self, new: pd.DataFrame | None, watermark_ms: int) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=self.rows.names)
        parts = [x for x in (held, new) if x is not None and len(x)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        due = rows[_US].to_numpy(np.int64) < watermark_ms * 1000
        later = rows[~due]
        if len(later):
            kinds = [f.dataType for f in self.rows]
            self.waiting.put([tuple(map(_plain, r, kinds)) for r in later.itertuples(index=False, name=None)])
            self.handle.registerTimer(int(later[_US].min()) // 1000 + 1)
        else:
            self.waiting.clear()
        if due.any():
            yield self._with_versions(rows[due], watermark_ms)

    def _with_versions(self, rows: pd.DataFrame, watermark_ms: int) -> pd.DataFrame:
        versions = sorted({tuple(v) for v in self.versions.get()})
        stay = []
        out = {}
        for kind in self.kinds:
            own = [v for v in versions if v[1] == kind]
            since = np.array([v[0] for v in own], np.int64)
            models = np.array([None, *(v[2] for v in own)], object)
            out[model_column(kind)] = models[np.searchsorted(since, rows[_US].to_numpy(np.int64), "right")]
            passed = int(np.searchsorted(since, watermark_ms * 1000, "right"))
            stay += own[max(0, passed - 1) :]
        if len(stay) < len(versions):
            self.versions.put(stay) if stay else self.versions.clear()
        return rows.drop(columns=_US).assign(**out)

    def close(self) -> None:
        pass


def swap_stream(
    rows: DataFrame, control: DataFrame, time: str, kinds: Seq[str], delay: str = "10 seconds", shards: int | None = None
) -> DataFrame:
    """Streamed ``rows`` with ``model_<kind>``: the newest model with ``since`` <= the row's ``time``.

    ``control`` is a stream of (since timestamp, kind, model). Rows leave when the watermark,
    ``delay`` behind the latest time of both streams, has passed them; what comes later than
    that is dropped, as watermarks do. Null before the first version; of two versions of one
    instant the greater text counts. Rows without a time have no version in force and are
    left out.
    """
    spark = rows.sparkSession
    spark.conf.set(_STORE_CONF, _STORE)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    data = rows.where(F.col(time).isNotNull()).withColumns(
        {
            _AT: F.col(time).cast("timestamp"),
            _KIND: F.lit(None).cast("string"),
            _MODEL: F.lit(None).cast("string"),
            _SHARD: F.pmod(F.xxhash64(*rows.columns), F.lit(shards)).cast("int"),
        }
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    messages = control.where("since IS NOT NULL AND kind IS NOT NULL").select(
        F.col("since").cast("timestamp").alias(_AT), F.col("kind").alias(_KIND), F.col("model").alias(_MODEL), every.alias(_SHARD)
    )
    both = data.unionByName(messages, allowMissingColumns=True).withWatermark(_AT, delay).withColumn(_US, F.unix_micros(_AT))
    out = T.StructType([*plain.fields, *[T.StructField(model_column(k), T.StringType()) for k in kinds]])
    return both.groupBy(_SHARD).transformWithStateInPandas(InForce(both.columns, plain, kinds), out, "append", "EventTime")


def still_waiting(spark: SparkSession, checkpoint: str, kinds: Seq[str]) -> DataFrame:
    """At the end of the input: the rows that wait for the watermark, with their versions."""

    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select("list_element.*")

    rows, versions = state("waiting"), state("versions").distinct()
    for kind in kinds:
        own = versions.where(F.col("kind") == kind).groupBy("since").agg(F.max("model").alias(model_column(kind)))
        rows = asof_join(rows, own, [], _US, [model_column(kind)])
    return rows.drop(_US)


def regression_model(model: Column) -> tuple[Column, Column]:
    """Intercept and weights of a regression as text."""
    parsed = F.from_json(model, REGRESSION_JSON)
    return parsed["intercept"], parsed["weights"]


def tree_nodes(tree: Split | int, features: Seq[str]) -> dict:
    """A tree as the node table that ``tree_walk`` reads; to be written as JSON."""
    nodes: list[dict] = []

    def add(node: Split | int) -> tuple[int, int]:
        at = len(nodes)
        nodes.append({})
        if isinstance(node, int):
            nodes[at] = {"field": -1, "threshold": None, "left": -1, "right": -1, "label": node}
            return at, 0
        (left, a), (right, b) = add(node.left), add(node.right)
        nodes[at] = {"field": list(features).index(node.field), "threshold": node.threshold, "left": left, "right": right, "label": -1}
        return at, 1 + max(a, b)

    depth = add(tree)[1]
    return {"depth": depth, "nodes": nodes}


def tree_walk(model: Column, features: Seq[str]) -> Column:
    """Class index of the row under its own tree (text of ``tree_nodes``); null in, null out."""
    values = F.array(*[F.col(f).cast("double") for f in features])
    bound = F.array(F.struct(F.from_json(model, TREE_JSON).alias("tree"), values.alias("x")))

    def walk(b: Column) -> Column:
        nodes = b["tree"]["nodes"]

        def step(at: Column, _: Column) -> Column:
            node = F.get(nodes, at)
            value = F.get(b["x"], node["field"])
            next_one = F.when(value <= node["threshold"], node["left"]).when(value > node["threshold"], node["right"])
            return F.when(node["field"] < 0, at).otherwise(next_one)

        steps = F.when(b["tree"]["depth"] > 0, F.sequence(F.lit(1), F.greatest(b["tree"]["depth"], F.lit(1)))).otherwise(F.array().cast("array<int>"))
        last = F.get(nodes, F.aggregate(steps, F.lit(0), step))
        return F.when(last["field"] < 0, last["label"]).cast("float")

    return F.transform(bound, walk)[0]
