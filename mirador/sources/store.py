"""A data source for stores of one JSON file a symbol: {symbol, bars: [{date, open, ...}]}.

``spark.dataSource.register(BarStore)``, then ``spark.read.format("bar_store")`` with the
options ``path`` (a folder) and ``what`` (a file's kind, all where absent). A file is a
partition. Filters on the symbol choose files by their names, so others are never opened;
those on the session are applied while a file is read. Both are told to Spark as done.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "symbol string, session date, o double, h double, l double, c double, v double"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_FIELDS = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}


def file_of(symbol: str) -> str:
    return f"{symbol.upper().replace(' ', '_')}.json"


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, what: str | None):
        self.path, self.what = path, what
        self.symbols: set[str] | None = None
        self.low, self.high = dt.date.min, dt.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        name, day = getattr(f, "attribute", None), dt.timedelta(days=1)
        if name == ("symbol",) and isinstance(f, EqualTo | In):
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.symbols = asked if self.symbols is None else self.symbols & asked
            return True
        if name == ("session",) and isinstance(getattr(f, "value", None), dt.date):
            if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                self.low = max(self.low, f.value + day if isinstance(f, GreaterThan) else f.value)
            if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                self.high = min(self.high, f.value - day if isinstance(f, LessThan) else f.value)
            return isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan | LessThanOrEqual | LessThan)
        return False

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, folder = _store(self.path)
        if self.symbols is not None:
            found = store.get_file_info([f"{folder}/{file_of(s)}" for s in sorted(x for x in self.symbols if x)])
        else:
            found = store.get_file_info(fs.FileSelector(folder))
        return [_File(i.path) for i in sorted(found, key=lambda i: i.path) if i.is_file and i.base_name.endswith(".json")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        with store.open_input_stream(partition.path) as file:
            doc = json.loads(file.read())
        symbol = doc.get("symbol")
        if (self.what and doc.get("what") != self.what) or (self.symbols is not None and symbol not in self.symbols):
            return
        days = [(dt.date(int(b["date"][:4]), int(b["date"][4:6]), int(b["date"][6:8])), b) for b in doc.get("bars") or []]
        kept = [(d, b) for d, b in days if self.low <= d <= self.high]
        number = lambda b, n: None if b.get(n) is None or b[n] != b[n] else float(b[n])
        columns = [pa.array([symbol] * len(kept), pa.string()), pa.array([d for d, _ in kept], pa.date32()), *[pa.array([number(b, n) for _, b in kept], pa.float64()) for n in _FIELDS.values()]]
        yield pa.RecordBatch.from_arrays(columns, ["symbol", "session", *_FIELDS])


class BarStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bar_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("what"))


def bars(spark: SparkSession, path: str, what: str | None = None) -> DataFrame:
    """The store as a DataFrame; sets the session to push filters to it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(BarStore)
    read = spark.read.format("bar_store").option("path", path)
    return (read.option("what", what) if what else read).load()
