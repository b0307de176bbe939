"""Operators with memory on streams, keyed state in the state store.

Rows of a key are taken in the order of ``order`` within a micro-batch; rows that
come in a later micro-batch than they should are processed on arrival. A key's rows
of one micro-batch are held together, so the source's per-trigger limit
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) bounds the memory of a task; for keys too
large for that, ``tideline.streaming.pieces`` cuts a key's rows of a micro-batch.

Count blocks take keys in groups: a call of Python and its trips to the state cost far more than
a row, so a group's keys share them. A group's state has the rows of its open blocks and their
numbers, by columns; a micro-batch rewrites the state of the groups it has rows of. An open block
is emitted when its key was silent for a time, by a timer; at the end of the input ``open_rows``
reads those left from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence as Seq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators.clean import fill_from_blocks
from tideline.operators.kalman import PROCESS_NOISE, SENSOR_NOISE
from tideline.operators.sequence import BLOCK
from tideline.specs import BLOCK_SIZE, HORIZON, REGRESSION_WINDOW

# Rows of whole blocks with their ``block``, and which rows are one block: a number from 0 over all keys.
BlockFunction = Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]

# State with several typed variables and timers needs this store.
_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Keys are dealt into this many groups, each with one state and one call per micro-batch. A stream
# keeps it for its life.
KEY_GROUPS = 1024
_GROUP, _KEY, _BLOCK, _DEADLINE = "__group", "__key", "__block", "__deadline"


def _gather(batches: Iterator[pd.DataFrame], order: Seq[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(list(order), kind="stable")


def _plain(value, kind: T.DataType | None = None):
    """A pandas value as a state row holds it."""
    if isinstance(value, np.ndarray):
        return [_plain(v, getattr(kind, "elementType", None)) for v in value]
    if isinstance(value, (list, tuple, dict)):
        return value
    if pd.isna(value):
        return None
    if isinstance(kind, T.IntegralType):
        return int(value)  # pandas makes doubles of integers beside nulls
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if isinstance(value, np.generic) else value


def _column(values: pd.Series, kind: T.DataType) -> list:
    """A pandas column as a state row holds it."""
    exact = isinstance(kind, T.IntegralType) == (values.dtype.kind == "i")
    if values.dtype.kind in "if" and exact and not values.hasnans:
        return values.tolist()
    return [_plain(v, kind) for v in values]


class OpenBlocks(StatefulProcessor):
    """Emits whole blocks of the keys of one group; keeps the rows of the open ones and their numbers.

    State is held by columns: ``held`` has the rows of open blocks, a key's rows in their order,
    and ``place`` the number of the open block of each key that had a whole one or has a deadline.
    """

    def __init__(
        self,
        keys: Seq[str],
        order: Seq[str],
        size: int,
        function: BlockFunction,
        rows: T.StructType,
        silence_ms: int | None,
    ) -> None:
        self.order, self.size, self.function = list(order), size, function
        self.rows, self.silence_ms = rows, silence_ms
        # the hash keeps apart what pandas does not: null and NaN, whole numbers beside nulls
        self.key = [_KEY, *keys]
        number = [T.StructField(_BLOCK, T.LongType())]
        own = [f for f in rows if f.name not in (_GROUP, _KEY)]
        self.kinds = {
            "held": [*own, rows[_KEY], *number],
            "place": [*(rows[k] for k in self.key), *number, T.StructField(_DEADLINE, T.LongType())],
        }

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = {
            name: handle.getValueState(name, T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields]))
            for name, fields in self.kinds.items()
        }

    def _read(self, name: str) -> pd.DataFrame:
        state, fields = self.states[name], self.kinds[name]
        columns = state.get() or [[]] * len(fields)
        types = {f.name: "float64" for f in fields if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType)}
        return pd.DataFrame({f.name: pd.Series(c, dtype=types.get(f.name, None if c else object)) for f, c in zip(fields, columns)})

    def _write(self, name: str, rows: pd.DataFrame) -> None:
        if len(rows):
            self.states[name].update(tuple(_column(rows[f.name], f.dataType) for f in self.kinds[name]))
        else:
            self.states[name].clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # names that are no Python names do not reach this place
        new = pd.concat([r.set_axis(self.rows.names, axis=1) for r in rows], ignore_index=True).drop(columns=_GROUP)
        place, held = self._read("place"), self._read("held")
        # a missing value of the held rows is None, and takes the column's own type
        held = held.astype({c: t for c, t in new.dtypes.items() if len(held)}, errors="ignore")
        frames = [f[self.key] for f in (place, held, new) if len(f)]
        every = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        code = every.groupby(self.key, dropna=False, sort=False).ngroup().to_numpy()
        of_place, of_held, of_new = np.split(code, [len(place), len(place) + len(held)])
        keys = every.iloc[np.unique(code, return_index=True)[1]]

        block = np.zeros(len(keys), dtype=np.int64)
        deadline = np.full(len(keys), np.nan)
        if len(place):
            block[of_place] = place[_BLOCK].to_numpy(dtype=np.int64)
            deadline[of_place] = place[_DEADLINE].to_numpy(dtype=float)
        new = new.assign(**{_BLOCK: of_new}).sort_values([_BLOCK, *self.order], kind="stable")
        both = pd.concat([held.assign(**{_BLOCK: of_held}), new], ignore_index=True) if len(held) else new
        both = both.sort_values(_BLOCK, kind="stable")
        of = both[_BLOCK].to_numpy()
        count = np.bincount(of, minlength=len(keys))
        position = np.arange(len(of)) - (np.cumsum(count) - count)[of]
        whole = count // self.size
        ready = position < whole[of] * self.size
        both[_BLOCK] = block[of] + position // self.size

        if self.silence_ms is not None:
            spoke = np.unique(of_new)
            now = timerValues.getCurrentProcessingTimeInMs() + self.silence_ms
            deadline[spoke] = np.where(count[spoke] % self.size > 0, now, np.nan)
            if (deadline[spoke] == now).any():
                self.handle.registerTimer(now)
        self._keep(keys, block + whole, deadline)
        self._write("held", both[~ready])
        if ready.any():
            rows = both if ready.all() else both[ready]
            yield self._called(rows, np.arange(len(rows)) // self.size)

    def _keep(self, keys: pd.DataFrame, block: np.ndarray, deadline: np.ndarray) -> None:
        place = keys.assign(**{_BLOCK: block, _DEADLINE: deadline})
        self._write("place", place[(block > 0) | ~np.isnan(deadline)])

    def _called(self, rows: pd.DataFrame, which: np.ndarray) -> pd.DataFrame:
        rows = rows.drop(columns=_KEY).rename(columns={_BLOCK: BLOCK})
        return self.function(rows.reset_index(drop=True), which)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        place, held = self._read("place"), self._read("held")
        if not len(place):
            return
        deadline = place[_DEADLINE].to_numpy(dtype=float)
        due = deadline == expiredTimerInfo.getExpiryTimeInMs()
        if not due.any():
            return  # rows came since
        both = pd.concat([place[self.key], held[self.key]], ignore_index=True)
        code = both.groupby(self.key, dropna=False, sort=False).ngroup().to_numpy()
        of_held = code[len(place) :]
        out = np.isin(of_held, code[: len(place)][due])
        # the number stays used, so later rows open a block of their own
        block = place[_BLOCK].to_numpy(dtype=np.int64) + due
        self._keep(place[self.key], block, np.where(due, np.nan, deadline))
        self._write("held", held[~out])
        which = np.unique(of_held[out], return_inverse=True)[1]
        chosen = np.argsort(which, kind="stable")
        yield self._called(held[out].iloc[chosen], which[chosen])

    def close(self) -> None:
        pass


def stream_blocks(
    df: DataFrame,
    keys: Seq[str],
    order: Seq[str],
    size: int,
    function: BlockFunction,
    schema: T.StructType,
    flush_after_ms: int | None = None,
) -> DataFrame:
    """Apply ``function`` to whole blocks of ``size`` rows of a key.

    The function gets the rows of whole blocks of any number of keys, a block's rows side by side,
    with a ``block`` column and the block that each row is of; it returns rows of ``schema``. An open
    block waits for its rows; with ``flush_after_ms`` it is emitted as it is once its key was silent
    that long, and the key's next row opens a new block. Numbers of blocks are never used twice.
    """
    df.sparkSession.conf.set(_STORE_CONF, _STORE)
    hashed = F.xxhash64(*keys)
    dealt = df.withColumns({_GROUP: F.pmod(hashed, F.lit(KEY_GROUPS)), _KEY: hashed})
    rows = T.StructType([T.StructField(f.name, f.dataType) for f in dealt.schema])
    processor = OpenBlocks(keys, order, size, function, rows, flush_after_ms)
    mode = "None" if flush_after_ms is None else "ProcessingTime"
    return dealt.groupBy(_GROUP).transformWithStateInPandas(processor, schema, "append", mode)


def open_rows(spark: SparkSession, checkpoint: str, keys: Seq[str]) -> DataFrame:
    """Rows of the open blocks that a stopped stream left in its checkpoint, with ``block``.

    For the end of the input: these rows have not been emitted. A stream that goes on from
    the checkpoint still holds them.
    """
    held = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint).select("value.*")
    rows = held.select(F.explode(F.arrays_zip(*[F.col(f"`{c}`") for c in held.columns])).alias("row"))
    return rows.select("row.*").drop(_KEY).withColumnRenamed(_BLOCK, BLOCK)


def stream_interpolate(
    df: DataFrame,
    columns: Seq[str],
    keys: Seq[str],
    order: Seq[str],
    size: int = BLOCK_SIZE,
    flush_after_ms: int | None = None,
) -> DataFrame:
    """Fill nulls by the block mean, else by 0.0."""
    columns, names = list(columns), list(df.columns)

    def fill(rows: pd.DataFrame, which: np.ndarray) -> pd.DataFrame:
        means = rows.groupby(which)[columns].transform("mean")
        rows[columns] = rows[columns].fillna(means).fillna(0.0)
        return rows[names]

    return stream_blocks(df, keys, order, size, fill, df.schema, flush_after_ms)


def interpolate_open(spark: SparkSession, checkpoint: str, columns: Seq[str], keys: Seq[str]) -> DataFrame:
    """The rows that ``stream_interpolate`` holds at the end of the input, filled from their open block."""
    rows = open_rows(spark, checkpoint, keys)
    return fill_from_blocks(rows, columns, keys).drop(BLOCK)


def stream_block_stats(
    df: DataFrame,
    keys: Seq[str],
    order: Seq[str],
    mean_of: str,
    distinct_of: str,
    size: int = BLOCK_SIZE,
    flush_after_ms: int | None = None,
) -> DataFrame:
    """Per block: row count, last order values, mean (missing as 0.0), distinct count."""
    keys, order = list(keys), list(order)
    fields = [df.schema[k] for k in keys]
    fields += [T.StructField("block", T.LongType()), T.StructField("rows", T.LongType())]
    fields += [df.schema[c] for c in order]
    fields += [T.StructField("mean", T.DoubleType()), T.StructField("distinct_values", T.LongType())]

    def summarise(rows: pd.DataFrame, which: np.ndarray) -> pd.DataFrame:
        by = rows.groupby(which, sort=True)
        counts = np.bincount(which)
        # a block has one key and one number
        out = rows[[*keys, BLOCK]].iloc[np.cumsum(counts) - counts].reset_index(drop=True)
        out["rows"] = counts
        out[order] = by[order].last()
        out["mean"] = rows[mean_of].fillna(0.0).groupby(which, sort=True).mean()
        out["distinct_values"] = by[distinct_of].nunique(dropna=False)
        return out[[f.name for f in fields]]

    return stream_blocks(df, keys, order, size, summarise, T.StructType(fields), flush_after_ms)


def block_stats_open(
    spark: SparkSession, checkpoint: str, keys: Seq[str], order: Seq[str], mean_of: str, distinct_of: str
) -> DataFrame:
    """The open blocks of ``stream_block_stats`` at the end of the input, summarised as they are."""
    rows = open_rows(spark, checkpoint, keys)
    last = F.struct(*order)
    distinct = F.count_distinct(distinct_of) + F.max(F.col(distinct_of).isNull().cast("long"))
    return rows.groupBy(*keys, BLOCK).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.max_by(c, last).alias(c) for c in order],
        F.avg(F.coalesce(F.col(mean_of).cast("double"), F.lit(0.0))).alias("mean"),
        distinct.alias("distinct_values"),
    )


def stream_forecast(
    df: DataFrame,
    value: str,
    keys: Seq[str],
    order: Seq[str],
    window_rows: int = REGRESSION_WINDOW,
    horizon: int = HORIZON,
) -> DataFrame:
    """Add ``seq``, ``estimate`` (Kalman) and ``horizon_mean`` (sliding regression) to every row."""
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("seq", T.LongType()),
            T.StructField("estimate", T.DoubleType()),
            T.StructField("horizon_mean", T.DoubleType()),
        ]
    )

    def step(key, batches, state: GroupState):
        n, x, p, tail = state.get if state.exists else (0, 0.0, 0.0, [])
        rows = _gather(batches, order)
        estimates = []
        for z in rows[value].fillna(0.0).to_numpy(dtype=float):
            p += PROCESS_NOISE
            gain = p / (p + SENSOR_NOISE)
            x += gain * (z - x)
            p *= 1 - gain
            estimates.append(x)
        past = np.concatenate([np.asarray(tail, dtype=float), estimates])
        means = _horizon_means(past, len(tail), window_rows, horizon)
        yield rows.assign(
            seq=n + 1 + np.arange(len(rows)), estimate=estimates, horizon_mean=means
        )
        state.update((n + len(rows), float(x), float(p), past[-(window_rows - 1) :].tolist()))

    return df.groupBy(*keys).applyInPandasWithState(
        step,
        schema,
        "n long, x double, p double, tail array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def _horizon_means(past: np.ndarray, known: int, window_rows: int, horizon: int) -> np.ndarray:
    """Mean prediction after each value from position ``known`` on; NaN with one value."""
    out = np.full(len(past) - known, np.nan)
    short = min(window_rows - 1, len(past))
    for end in range(max(known, 1), short):
        y = past[: end + 1]
        slope = np.polyfit(np.arange(len(y)), y, 1)[0]
        out[end - known] = y.mean() + slope * ((horizon + 1) / 2 + (len(y) - 1) / 2)
    if len(past) >= window_rows:
        windows = np.lib.stride_tricks.sliding_window_view(past, window_rows)
        x = np.arange(window_rows) - (window_rows - 1) / 2
        slopes = (windows - windows.mean(axis=1, keepdims=True)) @ x / (x @ x)
        ahead = (horizon + 1) / 2 + (window_rows - 1) / 2
        full = windows.mean(axis=1) + slopes * ahead
        first = max(known, window_rows - 1)
        out[first - known :] = full[first - (window_rows - 1) :]
    return out


def stream_latest_average(
    df: DataFrame, value: str, keys: Seq[str], order: Seq[str], size: int = BLOCK_SIZE
) -> DataFrame:
    """Add ``average``: mean of the key's last whole block, null before the first."""
    schema = T.StructType([*df.schema.fields, T.StructField("average", T.DoubleType())])

    def step(key, batches, state: GroupState):
        open_values, last = state.get if state.exists else ([], None)
        rows = _gather(batches, order)
        known = len(open_values)
        values = np.concatenate([open_values, rows[value].fillna(0.0).to_numpy(dtype=float)])
        whole = len(values) // size
        means = values[: whole * size].reshape(whole, size).mean(axis=1)
        latest = np.concatenate([[np.nan if last is None else last], means])
        ended = (np.arange(known, len(values)) + 1) // size
        yield rows.assign(average=latest[ended])
        current = latest[-1]
        state.update(
            (values[whole * size :].tolist(), None if np.isnan(current) else float(current))
        )

    return df.groupBy(*keys).applyInPandasWithState(
        step, schema, "open array<double>, last double", "append", GroupStateTimeout.NoTimeout
    )
