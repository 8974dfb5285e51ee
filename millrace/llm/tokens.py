"""Exact encoding with a byte-level BPE of the tokenizers library, a distinct piece at a time.

Such a tokenizer cuts a text into pre-tokens before it merges bytes, and none of them crosses the place before a space
or a line feed that stands alone between other characters, or the place between a letter or digit and a final run of
ASCII punctuation. Pieces between such places therefore have the ids that they have within the whole text, so each
distinct piece is encoded by the library once and looked up after that: a hash finds it, and its bytes are compared with
those of the piece found. Texts in which two pieces share a hash, or a piece shares it with another that is known, go to
the library whole. So do texts that hold a special token's text; others that are not of the simple form are cut at lone
spaces only. A text of more than LONG_TEXT bytes is taken in parts, cut before lone spaces where it has some.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import windows as W

#: Texts in which some space or line feed does not stand alone, or that hold other white space.
ODD = "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]|[ \n][ \n]|^[ \n]|[ \n]$"
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces that a worker remembers; it forgets them all when there are more.
MEMORY = 1_000_000
#: Bytes from which on a text is encoded in parts, and the least size of a part.
LONG_TEXT, PART = 1 << 22, 1 << 20

_ALNUM, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, whether a space belongs before it) of the pieces of texts of the simple form, none of them empty."""
    n = len(data)
    space, feed = data == 32, data == 10
    begin, end = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    word = ~(space | feed)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begin[1:n] = word[1:] & ~word[:-1]
    end[1:n] = ~word[1:] & word[:-1]
    begin[:n] |= edge[:n] & word
    end[1:] |= edge[1:] & word
    # a final run of punctuation after an ASCII letter or digit, or after a letter of U+00C0 to U+00FF
    e = np.flatnonzero(end)
    plain = np.where(_PUNCT[data], 0, np.arange(1, n + 1))
    np.maximum.accumulate(plain, out=plain)
    cut = plain[e - 1]
    b = np.flatnonzero(begin)
    ok = (cut < e) & (cut > b)
    cut = cut[ok]
    last, before = data[cut - 1], data[np.maximum(cut - 2, 0)]
    cut = cut[_ALNUM[last] | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)]
    spaced = np.zeros(n + 1, bool)
    spaced[1:n] = begin[1:n] & space[:-1] & ~edge[1:n]
    begin[cut] = end[cut] = True
    f = np.flatnonzero(feed)
    begin[f] = end[f + 1] = True
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(end), spaced[s]


class Encoder:
    """Ids of whole texts; `dtype` is the narrowest unsigned type that holds the vocabulary."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without normalizer or added prefix space is needed")
        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        vocab = self.tokenizer.get_vocab()
        self.size = 1 + max(vocab.values())
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.heads = np.zeros(self.size, bool)
        self.lengths = np.zeros(self.size, np.int32)
        for token, i in vocab.items():
            self.heads[i] = token[0] in "ĠĊ"
            self.lengths[i] = len(token.encode()) if token in self.special else len(token)
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        """Piece i has the ids pool[at[i] : at[i + 1]]. Hashes lie in two sorted arrays with each one's piece beside it:
        the many, and the latest, which join them when they have become some ten thousands."""
        self.count = 0
        self.many = self.latest = (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.pool, self.at, self.used = np.empty(1 << 16, self.dtype), np.zeros(1 << 14, np.int64), 0
        # Its bytes are text[text_at[i] : text_at[i + 1]]; after the last are eight spare ones at least.
        self.text, self.text_at = np.zeros(1 << 16, np.uint8), np.zeros(1 << 14, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The pieces of sorted hashes, -1 for one that is not known."""
        out = np.full(len(keys), -1, np.int64)
        for known, piece in (self.many, self.latest):
            if len(known):
                p = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[p] == keys
                out[hit] = piece[p[hit]]
        return out

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order]

    def _learn(self, keys: np.ndarray, new: list[bytes], spaced: list[bool]) -> np.ndarray:
        """Encodes pieces with these sorted hashes and gives their numbers. They are joined into texts of some KB: each with
        its space, or a line feed in the place of none, so that only a piece's first token starts with one."""
        groups, size = [[]], 0
        for p, s in zip(new, spaced):
            groups[-1].append(" " + p.decode() if s else "\n" + p.decode() if p != b"\n" else "\n")
            size += len(p)
            if size > 1 << 15:
                groups.append([])
                size = 0
        made = [e.ids for e in self.tokenizer.encode_batch_fast(["".join(g) for g in groups if g], add_special_tokens=False)]
        ids = np.array([i for m in made for i in m], self.dtype)
        head = np.flatnonzero(self.heads[ids])
        if len(head) != len(new):
            raise AssertionError("pieces and tokens do not correspond")
        bare = np.array([not s and p != b"\n" for p, s in zip(new, spaced)], bool)
        keep = np.ones(len(ids), bool)
        keep[head[bare]] = False  # the line feed that stood for no space
        sizes = np.add.reduceat(keep, head, dtype=np.int64) if len(head) else np.empty(0, np.int64)
        ids, n = ids[keep], self.count
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while n + len(new) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.empty_like(self.at)])
            self.text_at = np.concatenate([self.text_at, np.empty_like(self.text_at)])
        raw = np.frombuffer(b"".join(new), np.uint8)
        text_ends = self.text_at[n] + np.cumsum([len(p) for p in new])
        while text_ends[-1] + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.text_at[n] : text_ends[-1]] = raw
        self.text_at[n + 1 : n + 1 + len(new)] = text_ends
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[n + 1 : n + 1 + len(new)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.count += len(new)
        made = np.arange(n, self.count)
        self.latest = self._merged(self.latest, (keys, made))
        if len(self.latest[0]) > 1 << 16:
            self.many, self.latest = self._merged(self.many, self.latest), (np.empty(0, np.uint64), np.empty(0, np.int64))
        return made

    def _simple(self, data: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Ids of texts of the simple form, not empty, that lie one after the other."""
        s, e, spaced = pieces(data, starts)
        # The lowest bit says whether a space belongs before the piece, so pieces of one hash agree in that.
        h = self._hash(data, s, e) << np.uint64(1) | spaced.astype(np.uint64)
        order = np.argsort(h)
        k = h[order]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        which = np.empty(len(k), np.int64)
        which[order] = np.cumsum(first) - 1
        at = order[first]
        keys = k[first]
        v, head = W.loads(data), at[which]
        if not W.equal_spans(data, s, e, data, s[head], e[head], v, v).all():
            return self._whole(data, starts)
        found = self._find(keys)
        new = np.flatnonzero(found < 0)
        if len(new) and self.count + len(new) > self.memory:
            self._forget()
            found[:], new = -1, np.arange(len(keys))
        old = np.flatnonzero(found >= 0)
        if len(old):
            f, stored = found[old], np.ndarray(len(self.text) - 7, "<u8", self.text, strides=(1,))
            if not W.equal_spans(data, s[at[old]], e[at[old]], self.text, self.text_at[f], self.text_at[f + 1], v, stored).all():
                return self._whole(data, starts)
        if len(new):
            raw, lot = data.tobytes(), at[new]
            parts = [raw[a:b] for a, b in zip(s[lot].tolist(), e[lot].tolist())]
            found[new] = self._learn(keys[new], parts, spaced[lot].tolist())
        index = found[which]
        begin, sizes = self.at[index], self.at[index + 1] - self.at[index]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()
        width = self.pool.itemsize
        cuts = np.concatenate([[0], ends])[np.searchsorted(s, starts)] * width
        return [ids[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    _hash = staticmethod(W.span_hashes)

    def _whole(self, data: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Ids of texts that lie one after the other, by the library alone."""
        raw = data.tobytes()
        return [np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, self.dtype).tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]

    def _odd(self, text: str) -> bytes:
        parts = LONE_SPACE.split(text)
        made = self.tokenizer.encode_batch_fast([parts[0], *(" " + p for p in parts[1:])], add_special_tokens=False)
        return b"".join([np.array(e.ids, self.dtype).tobytes() for e in made])

    def encode(self, texts: pa.Array, group: int = 1 << 20) -> list[bytes]:
        """Of each text the ids as little-endian bytes of `dtype`. No text may be null.

        Simple texts are taken together, about `group` bytes at a time."""
        odd = pc.match_substring_regex(texts, ODD).to_pylist()
        for s in self.special:
            odd = [2 if h else o for o, h in zip(odd, pc.match_substring(texts, s).to_pylist())]
        out: list[bytes] = [b""] * len(texts)
        waiting, held, size = [], [], 0
        for i, (text, kind) in enumerate(zip(texts, odd)):
            if kind == 2:
                out[i] = np.array(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, self.dtype).tobytes()
            elif kind:
                out[i] = self._odd(text.as_py())
            elif (raw := text.as_buffer()) is not None and raw.size:
                if size and size + raw.size > group:
                    self._fill(out, waiting, held)
                    waiting, held, size = [], [], 0
                waiting.append(i)
                held.append(np.frombuffer(raw, np.uint8))
                size += raw.size
        if waiting:
            self._fill(out, waiting, held)
        return out

    def _fill(self, out: list[bytes], which: list[int], held: list[np.ndarray]) -> None:
        data = np.concatenate(held)
        if len(which) == 1 and len(data) > LONG_TEXT:
            out[which[0]] = self._long(data)
            return
        made = self._simple(data, np.concatenate([[0], np.cumsum([len(x) for x in held])]))
        for i, ids in zip(which, made):
            out[i] = ids

    def _long(self, data: np.ndarray) -> bytes:
        """A very long text, cut before lone spaces some MB apart; each part but the first is encoded behind a word whose
        ids are then dropped."""
        cuts, out = [0], []
        gaps = np.flatnonzero(data == 32)
        while len(data) - cuts[-1] > 2 * PART:
            at = np.searchsorted(gaps, cuts[-1] + PART)
            if at == len(gaps):
                break
            cuts.append(int(gaps[at]))
        lead = np.frombuffer(b"a", np.uint8)
        skip = len(self._simple(lead, np.array([0, 1]))[0])
        for a, b in zip(cuts, [*cuts[1:], len(data)]):
            part = data[a:b] if not a else np.concatenate([lead, data[a:b]])
            out.append(self._simple(part, np.array([0, len(part)]))[0][skip if a else 0 :])
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of this worker process, kept from task to task. Without a path the default one, where the worker has it."""
    return Encoder(path or default_path())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
