"""Sources: readers with an encoding and a time source, as batch or streaming DataFrames.

Kafka needs Spark's Kafka connector on the class path. The TCP reader connects; one that listens for a peer is the
`listen` data source below. A watched file is a watched folder here: Spark sees new files, not new lines of a file.
"""

from __future__ import annotations

import socket
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Csv:
    """Positional, without header; damaged lines become nulls, or go if `drop`."""

    sep: str = ","
    drop: bool = True

    def options(self) -> dict:
        return {"sep": self.sep, "header": "false", "mode": "DROPMALFORMED" if self.drop else "PERMISSIVE"}

    def decode(self, line, schema: StructType):
        return F.from_csv(line, schema.simpleString()[7:-1].replace(":", " "), {"sep": self.sep, "mode": "PERMISSIVE"})

    format = "csv"


@dataclass(frozen=True)
class Json:
    """A document a line."""

    drop: bool = True

    def options(self) -> dict:
        return {"mode": "DROPMALFORMED" if self.drop else "PERMISSIVE"}

    def decode(self, line, schema: StructType):
        return F.from_json(line, schema, {"mode": "PERMISSIVE"})

    format = "json"


@dataclass(frozen=True)
class File:
    path: str
    watch: bool = False
    max_files: int | None = None


@dataclass(frozen=True)
class Stdin:
    pass


@dataclass(frozen=True)
class Tcp:
    host: str
    port: int
    listen: bool = False
    bounded: bool = False  # read to the end as a batch (only with listen)


@dataclass(frozen=True)
class Http:
    url: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Kafka:
    servers: str
    topic: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Ingestion:
    """Stamps each batch with its time."""

    name: str = "_t"


@dataclass(frozen=True)
class Event:
    """Event time from an expression over the row; the watermark is `slack` behind the latest."""

    extractor: str
    slack: str = "0 seconds"
    name: str = "_t"


Encoding = Csv | Json
Reader = File | Stdin | Tcp | Http | Kafka


def source(spark: SparkSession, reader: Reader, encoding: Encoding, schema: StructType | str, time: Ingestion | Event | None = None, keys: dict[str, str] | None = None) -> DataFrame:
    """A source's rows with event time, and with key columns from expressions if `keys` are given."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    df = _rows(spark, reader, encoding, schema)
    if isinstance(time, Ingestion):
        df = df.withColumn(time.name, F.current_timestamp())
    elif isinstance(time, Event):
        df = df.withColumn(time.name, F.expr(time.extractor))
        if df.isStreaming:
            df = df.withWatermark(time.name, time.slack)
    for n, e in (keys or {}).items():
        df = df.withColumn(n, F.expr(e))
    return df


def _rows(spark: SparkSession, reader: Reader, encoding: Encoding, schema: StructType) -> DataFrame:
    match reader:
        case File(path, watch, most):
            r = (spark.readStream if watch else spark.read).format(encoding.format).schema(schema).options(**encoding.options())
            return (r.option("maxFilesPerTrigger", most) if most and watch else r).load(path)
        case Stdin():
            lines = spark.createDataFrame([(x.rstrip("\n"),) for x in sys.stdin], "value string")
        case Tcp(host, port, False, _):
            lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
        case Tcp(host, port, True, bounded):
            spark.dataSource.register(Listen)
            r = (spark.read if bounded else spark.readStream).format("listen")
            lines = r.option("host", host).option("port", port).load()
        case Http(url, options):
            spark.dataSource.register(HttpLines)
            lines = spark.read.format("http_lines").options(url=url, **options).load()
        case Kafka(servers, topic, options):
            r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
            lines = r.options(**options).load().select(F.col("value").cast("string").alias("value"))
    parsed = lines.select(encoding.decode(F.col("value"), schema).alias("r"))
    return (parsed.where("r is not null") if encoding.drop else parsed).select("r.*")


def from_iter(spark: SparkSession, rows: Iterable, schema: StructType | str, time: str, slack: str = "0 seconds", every: int = 1) -> DataFrame:
    """A bounded source in arrival order (column `_arrival`), without its late rows."""
    from ..operators.eventtime import drop_late, drop_late_every

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_arrival long, {schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(':', ' ')}")
    if every == 1:
        return drop_late(df, time, slack, "_arrival")
    us = int(df.sparkSession.sql(f"SELECT CAST(INTERVAL {slack} AS BIGINT) * 1000000 AS us").first()["us"]) if slack else 0
    return drop_late_every(df, time, us, every, "_arrival")


def simulator(spark: SparkSession, rows_per_second: int = 1, **columns: str) -> DataFrame:
    """An endless stream of numbered rows with columns from expressions over `value` and `timestamp`."""
    df = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return df.select(F.col("timestamp").alias("_t"), *[F.expr(e).alias(n) for n, e in columns.items()])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: `value`, its whole text."""
    return spark.read.text(path, wholetext=True)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


class _ListenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.host, self.port = options.get("host", "127.0.0.1"), int(options["port"])

    def read(self, partition) -> Iterator[tuple]:
        with socket.create_server((self.host, self.port)) as server:
            peer, _ = server.accept()
            with peer, peer.makefile(encoding="utf-8", newline="\n") as lines:
                for line in lines:
                    yield (line.rstrip("\r\n"),)


class _ListenStream(SimpleDataSourceStreamReader):
    """Accepts one peer; each batch has the lines that came since the last."""

    def __init__(self, options: dict):
        self.host, self.port = options.get("host", "127.0.0.1"), int(options["port"])
        self.peer = self.server = None
        self.rest, self.lines, self.first = b"", [], 0

    def initialOffset(self) -> dict:
        return {"line": 0}

    def _poll(self) -> None:
        if self.server is None:
            self.server = socket.create_server((self.host, self.port))
            self.server.settimeout(0.2)
        try:
            if self.peer is None:
                self.peer, _ = self.server.accept()
                self.peer.settimeout(0.2)
            while data := self.peer.recv(1 << 16):
                *done, self.rest = (self.rest + data).split(b"\n")
                self.lines += [x.decode("utf-8", "replace").rstrip("\r") for x in done]
        except TimeoutError:
            pass

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._poll()
        end = self.first + len(self.lines)
        return iter([(x,) for x in self.lines[start["line"] - self.first :]]), {"line": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(x,) for x in self.lines[start["line"] - self.first : end["line"] - self.first]])

    def commit(self, end: dict) -> None:
        self.lines, self.first = self.lines[end["line"] - self.first :], end["line"]


class Listen(DataSource):
    """Listens on a port, accepts one connection and reads its lines."""

    @classmethod
    def name(cls) -> str:
        return "listen"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _ListenReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _ListenStream(self.options)


class _HttpReader(DataSourceReader):
    def __init__(self, url: str):
        self.url = url

    def read(self, partition) -> Iterator[tuple]:
        from urllib.request import urlopen

        with urlopen(self.url) as body:
            for line in body:
                yield (line.decode("utf-8", "replace").rstrip("\r\n"),)


class HttpLines(DataSource):
    """The lines of one response."""

    @classmethod
    def name(cls) -> str:
        return "http_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(self.options["url"])
