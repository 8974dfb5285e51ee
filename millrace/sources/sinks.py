"""Sinks: writers with an encoding, for batches and streams. `sink` returns a Dataflow that `run` starts."""

from __future__ import annotations

import socket
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .readers import Csv, Encoding, Json


@dataclass(frozen=True)
class Stdout:
    pass


@dataclass(frozen=True)
class FileOut:
    """A folder of part files."""

    path: str


@dataclass(frozen=True)
class TcpOut:
    """Connects from each task; a line a row."""

    host: str
    port: int


@dataclass(frozen=True)
class HttpOut:
    """Posts the lines of each partition."""

    url: str


@dataclass(frozen=True)
class KafkaOut:
    servers: str
    topic: str


@dataclass(frozen=True)
class Discard:
    """Runs the plan and drops its rows."""


Writer = Stdout | FileOut | TcpOut | HttpOut | KafkaOut | Discard


@dataclass
class Dataflow:
    starts: list[Callable[[], StreamingQuery | None]] = field(default_factory=list)


def encoded(df: DataFrame, encoding: Encoding) -> DataFrame:
    """One column `value`: the row as text."""
    row = F.struct("*")
    return df.select((F.to_json(row) if isinstance(encoding, Json) else F.to_csv(row, {"sep": encoding.sep})).alias("value"))


def flattened(df: DataFrame) -> DataFrame:
    """Struct columns as their fields, as CSV needs."""
    while any(t.startswith("struct") for _, t in df.dtypes):
        cols = []
        for name, t in df.dtypes:
            fields = df.schema[name].dataType.fieldNames() if t.startswith("struct") else None
            cols += [F.col(f"{name}.{f}").alias(f"{name}_{f}") for f in fields] if fields else [F.col(name)]
        df = df.select(*cols)
    return df


def _send(host: str, port: int) -> Callable:
    def send(rows) -> None:
        with socket.create_connection((host, port)) as peer:
            for r in rows:
                peer.sendall((r["value"] + "\n").encode())

    return send


#: Bytes of lines in one HTTP request, about.
POST_BYTES = 1 << 20


def _post(url: str) -> Callable:
    def post(rows) -> None:
        from urllib.request import Request, urlopen

        def request(lines: list[bytes]) -> None:
            if lines:
                urlopen(Request(url, b"".join(lines), {"Content-Type": "text/plain"})).close()

        held, size = [], 0
        for r in rows:
            held.append((r["value"] + "\n").encode())
            size += len(held[-1])
            if size >= POST_BYTES:
                request(held)
                held, size = [], 0
        request(held)

    return post


def _write(df: DataFrame, writer: Writer, encoding: Encoding) -> None:
    match writer:
        case Stdout():
            encoded(df, encoding).show(truncate=False)
        case FileOut(path):
            out = flattened(df) if isinstance(encoding, Csv) else df
            out.write.mode("append").format(encoding.format).options(**({"sep": encoding.sep} if isinstance(encoding, Csv) else {})).save(path)
        case TcpOut(host, port):
            encoded(df, encoding).foreachPartition(_send(host, port))
        case HttpOut(url):
            encoded(df, encoding).foreachPartition(_post(url))
        case KafkaOut(servers, topic):
            encoded(df, encoding).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
        case Discard():
            drain(df)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def sink(df: DataFrame, writer: Writer, encoding: Encoding = Json(), checkpoint: str | None = None, mode: str = "append", available_now: bool = True) -> Dataflow:
    """Nothing runs yet. On streams each micro-batch goes to the writer; files are written by Spark's own sink."""

    def start() -> StreamingQuery | None:
        if not df.isStreaming:
            return _write(df, writer, encoding)
        w = df.writeStream.outputMode(mode)
        w = w.trigger(availableNow=True) if available_now else w
        w = w.option("checkpointLocation", checkpoint) if checkpoint else w
        if isinstance(writer, FileOut):
            out = flattened(df) if isinstance(encoding, Csv) else df
            w = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            w = w.trigger(availableNow=True) if available_now else w
            return w.format(encoding.format).start(writer.path)
        if isinstance(writer, Discard):
            return w.format("noop").start()
        return w.foreachBatch(lambda batch, _: _write(batch, writer, encoding)).start()

    return Dataflow([start])


def merge(*flows: Dataflow) -> Dataflow:
    return Dataflow([s for f in flows for s in f.starts])


@dataclass
class Instance:
    """A running dataflow."""

    queries: list[StreamingQuery]

    def wait(self, timeout: float | None = None) -> None:
        for q in self.queries:
            q.awaitTermination(timeout) if timeout else q.awaitTermination()

    def kill(self) -> None:
        for q in self.queries:
            q.stop()

    def log(self) -> list[dict]:
        return [p for q in self.queries for p in q.recentProgress]


def run(flow: Dataflow) -> Instance:
    return Instance([q for s in flow.starts if (q := s()) is not None])
