"""What both substring dedups share: stretches of documents around repeated grams, dealt out to shards, and the removed
runs that come back from there.

A context is a run of windows of one document with one minimizer, a gram that the corpus has more than once. Its text
goes to the shard of the gram, so equal windows meet. A gram that very many chunks of documents have is hot: its runs are
cut into CLASSES by how far left of the gram the windows reach, and go to the shard of the gram with the bytes or words
that all windows of the class have around it. Equal windows are of one class and have these in common, so they still
meet, and what merely shares the gram is parted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import by_shard, stored

CLASSES = 4
RUNS = "doc_id long, start long, count long"


def cut_runs(live: np.ndarray, minimizer: np.ndarray, grams: np.ndarray, sums: np.ndarray, hot: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, key): runs of live windows with one minimizer, those of hot grams by class; `hot` flags grams."""
    rest = window - gram
    cuts = (rest + 1) * np.arange(CLASSES + 1) // CLASSES
    kind = np.where(hot[minimizer], np.searchsorted(cuts, minimizer - np.arange(len(minimizer)), "right"), 0)
    s, e = W.runs(live, minimizer, kind)
    m, k = minimizer[s], kind[s]
    key = grams[m]
    some = np.flatnonzero(k)
    around = W.spans(sums, m[some] - cuts[k[some] - 1], m[some] + gram + rest + 1 - cuts[k[some]])
    key[some] = W.mix(W.mix(around, 43) + k[some].astype(np.uint64))
    return s, e, key


def flags(c, column: str, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the grams at `at` are among the hashes in a list column of the chunk."""
    known = np.unique(c.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
    out = np.zeros(len(grams), bool)
    out[at[np.isin(grams[at], known)]] = True
    return out


def runs_of(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, count) of the runs of successive places."""
    if not len(owner):
        return owner, place, place
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + 1)]))
    last = np.append(new[1:], len(owner)) - 1
    return owner[new], place[new], place[last] - place[new] + 1


def judged(asked: DataFrame, n: int, judge: Callable[[list[pa.Buffer]], tuple[np.ndarray, np.ndarray, np.ndarray]], name: str) -> DataFrame:
    """(_id, runs): by document the removed windows as (start, count), from the contexts (shard, packed).

    A row comes out for each removed run, so their number does not depend on the number of shards."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x.as_buffer() for b in batches for x in b.column("packed")]
        if rows:
            columns = judge(rows)
            for i in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)].astype(np.int64)) for c in columns], ["doc_id", "start", "count"])

    found = by_shard(asked, n).mapInArrow(answer, RUNS)
    return stored(found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count")).alias("runs")), name).withColumnRenamed("doc_id", "_id")


def with_runs(waiting: DataFrame, runs: DataFrame) -> DataFrame:
    """The documents that wait for their runs, beside them; each text is dealt out once, by id."""
    return waiting.join(runs.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left").drop("_id")


def starts_and_counts(own: pa.Array, runs: pa.Array) -> Iterator[np.ndarray]:
    """By row the (start, count) found beside the document itself and those from the shards."""
    flat = runs.flatten()
    found = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(2)], 1)
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(runs), 0).to_pylist()]).tolist()
    for mine, a, b in zip(own.to_pylist(), ends, ends[1:]):
        yield np.concatenate([np.frombuffer(mine, "<i8").reshape(-1, 2), found[a:b]])
