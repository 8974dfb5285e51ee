"""Substring dedup by automata of repeated phrases.

1. Sieve: a window of WINDOW words is known by its minimizer, a phrase of PHRASE words. Phrases that the corpus seems to
   have more than once are found by an exchange of their hashes (`exchange.repeated`); documents without one have nothing
   to remove and go no further. Of the others the passages around such phrases (`contexts`) go to the phrases' shards,
   without the places of the phrases, once for equal passages of a chunk of documents.
2. Compile: a shard, some MB of passages whatever the corpus' size, compiles the corpus' phrases that belong to it into
   one Aho-Corasick automaton.
3. Stream and judge: all passages of the shard, from all documents, go through the automaton, which locates every
   occurrence of a phrase. Windows around occurrences of phrases that occur again are compared word by word; the earliest
   of each is found, and every word that a later one covers is removed.

Hashes only say where to look: whole copies are known by SHA-256, phrases are matched letter by letter and windows are
equal if all their words are.

Defined cases: a null text is empty and has no words; a null id is the smallest; repeated rows of one id are one
document: a window removed from one is removed at that place from each, and windows at one place of different texts with
one id are equally early; texts shorter than a window stay whole, very long texts are taken whole, a chunk by themselves;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import Chunk, chunks, shards, stored, texts
from .contexts import cut_runs, flags, judged, runs_of, starts_and_counts, with_runs
from .exchange import HOT, expand, noted, shard_of, squeeze

WINDOW, PHRASE = 20, 5
NULL_ID = np.iinfo(np.int64).min
LOCATED = "doc_id long, text binary, n_words long, kept_sha256 string, n_removed long, own binary, shard int, packed binary"
#: Columns of a packed row: owner, place and bytes of each passage. The passages follow, then the phrases, a line each.
COLUMNS = ("<i8", "<i8", "<i4")


class Anchors:
    """Words, phrase hashes and minimizers of a chunk."""

    def __init__(self, c: Chunk, window: int, phrase: int):
        self.a, self.b, self.doc = W.words(c.data, c.starts)
        self.sums = W.prefix(W.word_hashes(c.data, self.a, self.b))
        self.phrases = W.mix(W.grams(self.sums, phrase), 11)
        n = max(0, len(self.a) - window + 1)
        self.minimizer = W.minimizers(self.phrases, window - phrase + 1)[:n]
        self.valid = self.doc[:n] == self.doc[window - 1 :][:n]

    def places(self) -> np.ndarray:
        """Minimizers of the windows, each once."""
        used = np.zeros(len(self.phrases), bool)
        used[self.minimizer[self.valid]] = True
        return np.flatnonzero(used)


def automaton(phrases: list[bytes]):
    """An automaton of phrases between spaces, which gives their numbers; bytes as Latin-1, so that places are byte offsets."""
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(phrases):
        out.add_word(f" {p.decode('latin-1')} ", i)
    out.make_automaton()
    return out


def locate(phrases: list[bytes], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place, phrase): the words at which one of the phrases starts, and which one it is."""
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    found = np.array(list(automaton(phrases).iter(f" {b' '.join(words).decode('latin-1')} ")), np.int64).reshape(-1, 2)
    which = found[:, 1]
    return np.searchsorted(starts, found[:, 0] - np.array([len(p) for p in phrases], np.int64)[which] - 1), which


def _passages(batches: Iterator[pa.RecordBatch], n_shards: int, window: int, phrase: int) -> Iterator[pa.RecordBatch]:
    kinds = {"kept_sha256": pa.string(), "shard": pa.int32(), "doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64()}
    names = ("doc_id", "text", "n_words", "kept_sha256", "n_removed", "own", "shard", "packed")
    for c in chunks(batches):
        x = Anchors(c, window, phrase)
        ids, copied = c.ids(), np.array(c.column("copied").to_pylist(), bool)
        first = np.searchsorted(x.doc, np.arange(c.n + 1))
        at = x.places()
        n = len(x.minimizer)
        live = x.valid & flags(c, "hs", x.phrases, at)[x.minimizer] & ~copied[x.doc[:n]]
        s, e, key = cut_runs(live, x.minimizer, x.phrases, x.sums, flags(c, "hot", x.phrases, at), window, phrase)
        doc = x.doc[s]
        owner, place = ids[doc], s - first[doc]
        raw = c.data.tobytes()
        split = [raw[a:b].split() for a, b in zip(c.starts[:-1].tolist(), c.starts[1:].tolist())]
        passages = [b" ".join(split[d][p : p + k]) for d, p, k in zip(doc.tolist(), place.tolist(), (e - s + window - 1).tolist())]
        # The first passage of each content stands for the later ones; a repeated row is not sent again.
        known: dict[bytes, int] = {}
        head = np.arange(len(s))
        for i in np.lexsort((place, owner)).tolist():
            head[i] = known.setdefault(passages[i], i)
        del known
        later = (owner != owner[head]) | (place != place[head])
        pending = np.zeros(c.n, bool)
        pending[doc] = True
        cols = {name: [] for name in names}
        own = np.searchsorted(doc, np.arange(c.n + 1)).tolist()
        for d, words in enumerate(split):
            a, b = own[d : d + 2]
            mine, gone = later[a:b], bool(copied[d]) and len(words) >= window
            cols["doc_id"].append(int(ids[d]))
            cols["n_words"].append(len(words))
            cols["text"].append(raw[c.starts[d] : c.starts[d + 1]] if pending[d] else None)
            cols["own"].append(np.stack([place[a:b][mine], (e - s)[a:b][mine]], 1).astype("<i8").tobytes() if pending[d] else None)
            cols["kept_sha256"].append(None if pending[d] else hashlib.sha256(b"" if gone else b" ".join(words)).hexdigest())
            cols["n_removed"].append(None if pending[d] else len(words) * gone)
        shard = shard_of(key, n_shards)
        send = np.flatnonzero(head == np.arange(len(s)))
        send = send[np.argsort(shard[send], kind="stable")]
        anchor = x.minimizer[s] - first[doc]
        for part in np.split(send, np.flatnonzero(np.diff(shard[send])) + 1) if len(send) else ():
            lot = [passages[i] for i in part.tolist()]
            phrases = {b" ".join(split[d][m : m + phrase]) for d, m in zip(doc[part].tolist(), anchor[part].tolist())}
            cols["shard"].append(int(shard[part[0]]))
            cols["packed"].append(squeeze(owner[part], place[part], np.array([len(p) for p in lot], "<i4"), tail=b"".join(lot) + b"\n".join(phrases)))
        m = len(cols["shard"])
        yield pa.RecordBatch.from_arrays([pa.array([None] * c.n + v if k in ("shard", "packed") else v + [None] * m, kinds.get(k, pa.binary())) for k, v in cols.items()], list(cols))


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1] if len(a) else a


def sequences(words: np.ndarray, size: int) -> np.ndarray:
    """Equal numbers for equal runs of `size` words, by doubling: exact, for words are numbers themselves."""
    out, have, power, step = None, 0, words, 1
    while True:
        if size & step:
            part = power[have:]
            n = len(words) - have - step + 1
            out = part[:n] if out is None else _numbered(out[: max(0, n)], part[: max(0, n)])
            have += step
        if 2 * step > size:
            return out
        power = _numbered(power[:-step], power[step:]) if len(power) > step else power[:0]
        step *= 2


def _judge(packed: list[pa.Buffer], window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, count) of the windows of a shard's passages that are not the earliest of their words."""
    owners, places, phrases = [], [], set()
    which: list[int] = []
    known: dict[bytes, int] = {}
    for p in packed:
        (owner, place, size), tail = expand(p, *COLUMNS)
        owners.append(owner), places.append(place)
        ends = np.cumsum(size, dtype=np.int64).tolist()
        which += [known.setdefault(tail[a:b], len(known)) for a, b in zip([0, *ends], ends)]
        phrases.update(tail[ends[-1] :].split(b"\n"))
    owner, place, which = np.concatenate(owners), np.concatenate(places), np.array(which)
    # Of equal passages the earliest is compared further, the others are removed whole.
    order = np.lexsort((place, owner))
    head = order[np.unique(which[order], return_index=True)[1]]
    late = np.flatnonzero((owner != owner[head[which]]) | (place != place[head[which]]))
    parts = [p.split() for p in known]
    sizes = np.array([len(p) for p in parts])
    words = [w for p in parts for w in p]
    text = np.repeat(np.arange(len(parts)), sizes)
    begin = np.cumsum(sizes) - sizes
    n = max(0, len(words) - window + 1)
    inside = text[:n] == text[window - 1 :][:n]
    # Windows around an occurrence of a phrase that occurs again.
    at, found = locate(list(phrases), words)
    ok = text[at] == text[at + phrase - 1]
    at, found = at[ok], found[ok]
    hit = np.zeros(len(words) + 1, np.int64)
    hit[1 + at[np.bincount(found)[found] > 1]] = 1
    hit = np.cumsum(hit)
    some = np.flatnonzero(inside & (hit[window - phrase + 1 :][:n] > hit[:n]))
    number: dict[bytes, int] = {}
    sequence = sequences(np.array([number.setdefault(w, len(number)) for w in words]), window)[some]
    who, where = owner[head[text[some]]], place[head[text[some]]] + some - begin[text[some]]
    order = np.lexsort((where, who, sequence))
    first = np.ones(len(order), bool)
    first[1:] = sequence[order[1:]] != sequence[order[:-1]]
    lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
    again = order[(who[order] != who[lead]) | (where[order] != where[lead])]
    runs = runs_of(who[again], where[again])
    return tuple(np.concatenate([a, b]) for a, b in zip((owner[late], place[late], sizes[which[late]] - window + 1), runs))


def _finish(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, digests = [], []
        for text, r in zip(batch.column("text").to_pylist(), starts_and_counts(batch.column("own"), batch.column("runs"))):
            words = text.split()
            r = r[r.sum(1) + window - 1 <= len(words)]
            gone = W.cover(len(words), r[:, 0], r.sum(1) + window - 1)
            removed.append(int(gone.sum()))
            digests.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text", per_shard: int = 16 << 20, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the words that stay, joined by single spaces."""
    source = texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(int(NULL_ID))))

    def grams(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        x = Anchors(c, window, phrase)
        at = x.places()
        return x.doc[at], x.phrases[at]

    n = shards(source, per_shard)
    found = stored(noted(source, grams, True, hot).mapInArrow(lambda it: _passages(it, n, window, phrase), LOCATED), "passages")
    runs = judged(found.where("shard is not null").select("shard", "packed"), n, lambda rows: _judge(rows, window, phrase), "later-windows")
    plain = found.where("shard is null and text is null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    waiting = with_runs(found.where("shard is null and text is not null").select("doc_id", "n_words", "text", "own"), runs)
    done = waiting.mapInArrow(lambda it: _finish(it, window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return plain.unionByName(done).withColumn("doc_id", F.when(F.col("doc_id") != int(NULL_ID), F.col("doc_id")))
