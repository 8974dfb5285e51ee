"""Stateful operators on streams: running folds, counting and moving windows, as keyed processors with state.

State lives in the RocksDB state store and is part of the checkpoint. Elements of a key are taken in event-time order
within a micro-batch and in batch order between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string


def _batch(rows: Iterator[pd.DataFrame], names: list[str]) -> pd.DataFrame:
    """A key's rows of a micro-batch; Spark passes names that start with an underscore on as other ones."""
    out = pd.concat(list(rows))
    out.columns = names
    return out


class _Scan(StatefulProcessor):
    def __init__(self, names: list[str], state: str, init: tuple, fold: Callable, emit: Callable, keys: list[str], order: list[str], columns: list[str]):
        self.names, self.schema, self.init_value, self.fold, self.emit = names, state, init, fold, emit
        self.keys, self.order, self.columns = keys, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.acc = handle.getValueState("acc", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        acc = tuple(self.acc.get()) if self.acc.exists() else self.init_value
        batch = _batch(rows, self.names).sort_values(self.order, kind="stable")
        out = []
        for r in batch.to_dict("records"):
            acc = self.fold(acc, r)
            out.append((*key, *self.emit(acc, r)))
        self.acc.update(acc)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def scan(df: DataFrame, keys: list[str], order: list[str], state: str, init: tuple, fold: Callable[[tuple, dict], tuple], output: str, emit: Callable[[tuple, dict], tuple]) -> DataFrame:
    """A running fold by key: after each row emits the keys and emit(state, row). `output` is the schema of emit's."""
    schema = StructType([*[df.schema[k] for k in keys], *_parse_datatype_string(output).fields])
    p = _Scan(df.columns, state, init, fold, emit, keys, order, schema.fieldNames())
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=p, outputStructType=schema, outputMode="Append", timeMode="None")


class Cells:
    """`state[key]` of one grouping key: cells by an inner key, each `default` until it is set."""

    def __init__(self, held, default: tuple):
        self.held, self.default, self.seen, self.changed = held, default, {}, set()

    def __getitem__(self, key: tuple) -> tuple:
        if key not in self.seen:
            self.seen[key] = tuple(self.held.getValue(key)) if self.held.containsKey(key) else self.default
        return self.seen[key]

    def __setitem__(self, key: tuple, value: tuple) -> None:
        self.seen[key] = value
        self.changed.add(key)

    def __delitem__(self, key: tuple) -> None:
        self[key] = self.default

    def store(self) -> None:
        for key in self.changed:
            if self.seen[key] != self.default:
                self.held.updateValue(key, self.seen[key])
            elif self.held.containsKey(key):
                self.held.removeKey(key)


class _Keyed(StatefulProcessor):
    def __init__(self, names: list[str], cell_key: str, cell: str, default: tuple, step: Callable, order: list[str], columns: list[str]):
        self.names, self.cell_key, self.cell, self.default = names, cell_key, cell, default
        self.step, self.order, self.columns = step, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("cells", self.cell_key, self.cell)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cells, out = Cells(self.held, self.default), []
        for r in _batch(rows, self.names).sort_values(self.order, kind="stable").to_dict("records"):
            out += [(*key, *made) for made in self.step(cells, r)]
        cells.store()
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def keyed(df: DataFrame, keys: list[str], order: list[str], cell_key: str, cell: str, default: tuple, output: str, step: Callable[[Cells, dict], list[tuple]]) -> DataFrame:
    """A processor with `state[key]`: for each row `step(state, row)` reads and sets cells and gives rows of `output`, which
    come with the keys. `cell_key` and `cell` are the schemas of the inner keys and of the cells; both are tuples."""
    schema = StructType([*[df.schema[k] for k in keys], *_parse_datatype_string(output).fields])
    p = _Keyed(df.columns, cell_key, cell, default, step, order, schema.fieldNames())
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=p, outputStructType=schema, outputMode="Append", timeMode="None")


class _Counted(StatefulProcessor):
    def __init__(self, names: list[str], length: int, step: int, value: str, kind: str, compute: Callable, order: list[str], columns: list[str]):
        self.names, self.length, self.step, self.value, self.kind = names, length, step, value, kind
        self.compute, self.order, self.columns = compute, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", f"v {self.kind}")
        self.place = handle.getValueState("place", "window long, skip long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        window, skip = tuple(self.place.get()) if self.place.exists() else (0, 0)
        out = []
        for v in _batch(rows, self.names).sort_values(self.order, kind="stable")[self.value].tolist():
            if skip:
                skip -= 1
                continue
            held.append(v)
            if len(held) == self.length:
                out.append((*key, window, *self.compute(held)))
                skip, held, window = max(0, self.step - self.length), held[self.step :], window + 1
        self.held.clear()
        if held:
            self.held.put([(v,) for v in held])
        self.place.update((window, skip))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def moving(df: DataFrame, keys: list[str], order: list[str], value: str, length: int, step: int, output: str, compute: Callable[[list], tuple]) -> DataFrame:
    """Count-based sliding windows by key: keys, `window`, compute(values) of each full window."""
    from pyspark.sql.types import LongType, StructField

    schema = StructType([*[df.schema[k] for k in keys], StructField("window", LongType()), *_parse_datatype_string(output).fields])
    p = _Counted(df.columns, length, step, value, df.schema[value].dataType.simpleString(), compute, order, schema.fieldNames())
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=p, outputStructType=schema, outputMode="Append", timeMode="None")


def counting(df: DataFrame, keys: list[str], order: list[str], value: str, length: int, output: str, compute: Callable[[list], tuple]) -> DataFrame:
    """Windows of every `length` elements by key."""
    return moving(df, keys, order, value, length, length, output, compute)


class _Timer(StatefulProcessor):
    def __init__(self, names: list[str], after_ms: int, time: str, emit: Callable, columns: list[str]):
        self.names, self.after_ms, self.time, self.emit, self.columns = names, after_ms, time, emit, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for t in _batch(rows, self.names)[self.time].tolist():
            self.handle.registerTimer(t.value // 1_000_000 + self.after_ms)
        yield pd.DataFrame([], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        yield pd.DataFrame([(*key, *self.emit(key, at))], columns=self.columns)

    def close(self) -> None:
        pass


def after(df: DataFrame, keys: list[str], time: str, delay_ms: int, output: str, emit: Callable[[tuple, int], tuple]) -> DataFrame:
    """A timer for each event, `delay_ms` after its event time: emits keys and emit(key, time in ms) when it expires."""
    schema = StructType([*[df.schema[k] for k in keys], *_parse_datatype_string(output).fields])
    p = _Timer(df.columns, delay_ms, time, emit, schema.fieldNames())
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=p, outputStructType=schema, outputMode="Append", timeMode="EventTime")
