"""Evaluation texts that appear, fully or partly, in a corpus.

Spaced seeds: fixed masks pick three words and ignore those between them. The seeds of an item come
from masks that span up to four words, those of a text from masks that span up to six, so that words
which were replaced, left out or put in do not matter. Seeds of both sides are joined by their hashes;
where the hits of an item in a stretch of text are many enough, the passage is verified.

How many hits are enough follows from the case that is looked for. If m >= 3/4 n words of an item of
n words stand in order in a stretch of at most 3/2 n words, then of the m - 2 triples of neighbouring
ones those whose span in the item exceeds four words are at most (n/2 + 2) / 3, and those whose span
in the text exceeds six at most (3/2 n + 2) / 5; each of the others is a hit. Nothing that fulfils the
case is lost; for items so short that this leaves no hit, single words are seeds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wayloom.llm.words import words
from wayloom.session import spread

#: Successive words that make a case by themselves.
RUN = 10
#: Share of an item's words, and length of the stretch as a multiple of the item's.
SHARE, STRETCH = 0.75, 1.5
ITEM_SPAN, TEXT_SPAN = 4, 6
#: Words of the items that one pass over the texts looks for; more make more passes, so that what a task holds is bounded.
BLOCK_WORDS = 1_000_000
#: Places of all items that may share a seed before it is left out, and hits that an item keeps needing then.
HOT, KEEP = 16, 10
#: Limbs of 64 words up to which items are verified together.
LIMBS = 8
#: Texts that are searched together.
TEXTS = 500


def masks(span: int) -> list[tuple[int, int]]:
    """Distances (first to second, second to third word) of triples that reach at most span words further."""
    return [(a, b) for a in range(1, span) for b in range(1, span - a + 1)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _seed(*columns: np.ndarray) -> np.ndarray:
    """Hash of the words that a mask picks, from the words' numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1))
    return h


def _need(n: int) -> int:
    """Hits that a case of the second kind has at least; 0 if there may be none."""
    m = math.ceil(SHARE * n - 1e-9)
    return max(0, math.ceil(m - 2 - (2 * (n - 1) - 2 * (m - 2)) / 3 - (2 * (math.floor(STRETCH * n) - 1) - 2 * (m - 2)) / 5 - 1e-9))


class _Bits:
    """A set of hashes as a bit map with sixteen bits for each: spares most look-ups of those that are not in it."""

    def __init__(self, hashes: np.ndarray):
        self.shift = np.uint64(64 - max(10, min(32, (16 * len(hashes)).bit_length())))
        self.bits = np.zeros(1 << (61 - int(self.shift)), np.uint8)
        at = hashes >> self.shift
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes that may be in the set."""
        at = hashes >> self.shift
        return np.flatnonzero(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1))


class _Table:
    """Sorted hashes with what they stand for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        keep = np.r_[True, (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])] if len(keys) else np.zeros(0, bool)
        keys, self.values = keys[keep], values[keep].astype(np.int32)
        self.keys, starts = np.unique(keys, return_index=True)
        self.ends = np.r_[starts, len(keys)].astype(np.int64)
        self.bits = _Bits(self.keys)

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into keys, value) of every match."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = self.bits.maybe(keys)
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        sure = self.keys[at] == keys[maybe]
        maybe, at = maybe[sure], at[sure]
        many = self.ends[at + 1] - self.ends[at]
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(maybe, many), self.values[np.repeat(self.ends[at], many) + inner].astype(np.int64)


def _flat(texts: list[list[int]], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """All numbers one after the other, with zeros between, and where each text begins."""
    space, out = [0] * gap, []
    begins = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        out += t
        out += space
        begins[i + 1] = len(out)
    return np.array(out or [0], np.int64), begins


def _ranked(groups: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of each element within its group, by order from the greatest on; groups are sorted."""
    by = np.lexsort((-order, groups))
    out = np.empty(len(groups), np.int64)
    out[by] = np.arange(len(groups)) - np.searchsorted(groups, groups[by])
    return out


class Matcher:
    """The items of one block, and the search for them in batches of texts.

    A case has _need hits at different places of the item, so that the hits at any few of its places
    may be done without: where a seed is shared by more than HOT places of all items, its places are
    left out of the index, as long as KEEP hits are still needed, and the item needs that many hits
    less. So the work does not grow with phrases that many items have.
    """

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        numbers = [[self.number.setdefault(w, len(self.number) + 1) for w in ws] for _, ws in items]
        self.t, self.begins = _flat(numbers, RUN)
        t, self.n = self.t, np.array([len(w) for w in numbers] or [0])
        self.stretch = np.floor(STRETCH * self.n).astype(np.int64)
        self.least = np.ceil(SHARE * self.n - 1e-9).astype(np.int64)
        of_size = {int(n): _need(int(n)) for n in np.unique(self.n)}
        self.need = np.array([of_size[n] for n in self.n.tolist()])
        self.owner = np.searchsorted(self.begins, np.arange(len(t)), "right") - 1
        self.owner[self.owner == len(items)] = max(0, len(items) - 1)
        self._seeds(t)
        whole = np.flatnonzero(self._all(t, range(RUN)))
        self.runs = _Table(_seed(*(t[whole + i] for i in range(RUN))), whole)
        self._marks(t)

    @staticmethod
    def _all(t: np.ndarray, steps) -> np.ndarray:
        """Where all words at the given distances from a place are known."""
        size = max(0, len(t) - max(steps))
        out = np.ones(size, bool)
        for i in steps:
            out &= t[i : i + size] > 0
        return out

    def _seeds(self, t: np.ndarray) -> None:
        found = []
        for a, b in masks(ITEM_SPAN):
            at = np.flatnonzero(self._all(t, (0, a, a + b)))
            found.append((_seed(t[at], t[at + a], t[at + a + b]), at))
        keys, at = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        _, back, many = np.unique(keys, return_inverse=True, return_counts=True)
        shared = np.zeros(len(t), np.int64)
        np.maximum.at(shared, at, many[back])
        rank = _ranked(self.owner, shared)
        out = (shared > HOT) & (rank < self.need[self.owner] - KEEP)
        self.need = self.need - np.bincount(self.owner[out], minlength=len(self.need))
        keep = ~out[at]
        self.seeds = _Table(keys[keep], self.owner[at[keep]])
        # Of items too short for seeds, any n - m + 1 words have one that a case holds: the rarest are taken.
        at = np.flatnonzero((t > 0) & (self.need[self.owner] == 0))
        some = at[_ranked(self.owner[at], -np.bincount(t)[t[at]]) <= (self.n - self.least)[self.owner[at]]]
        self.singles = _Table(_seed(t[some]), self.owner[some])

    def _marks(self, t: np.ndarray) -> None:
        """For each item and word of it, the bits of the word's places in the item, in limbs of 64 bits."""
        at = np.flatnonzero(t)
        self.wide = len(self.number) + 1
        self.keys, back = np.unique(self.owner[at] * self.wide + t[at], return_inverse=True)
        self.known = _Bits(self._hash(self.keys))
        self.limbs = np.maximum(1, -(-self.n // 64))
        sizes = self.limbs[self.keys // self.wide]
        self.marks_at = np.cumsum(sizes) - sizes
        self.marks = np.zeros(int(sizes.sum()), np.uint64)
        place = at - self.begins[self.owner[at]]
        np.bitwise_or.at(self.marks, self.marks_at[back] + place // 64, np.uint64(1) << (place % 64).astype(np.uint64))

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def _common(self, item: np.ndarray, start: np.ndarray, stop: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of items and stretches: bits in parallel, and all pairs of a size together.

        marks: numbers of marks of the places in the stretches; a stretch is marks[start:stop].
        """
        out = np.zeros(len(item), np.int64)
        limbs = self.limbs[item]
        for size in np.unique(limbs).tolist():
            some = np.flatnonzero(limbs == size)
            some = some[np.argsort(start[some] - stop[some], kind="stable")]
            long, first = (stop - start)[some], start[some]
            if size > LIMBS:
                out[some] = [self._common_long(marks[start[i] : stop[i]], int(size)) for i in some.tolist()]
                continue
            v = np.full((size, len(some)), ~np.uint64(0))
            active = np.searchsorted(-long, -np.arange(int(long.max(initial=0))), "left")
            for j, k in enumerate(active.tolist()):
                base = self.marks_at[marks[first[:k] + j]]
                carry = np.zeros(k, np.uint64)
                for i in range(size):
                    a = v[i, :k]
                    u = a & self.marks[base + i]
                    s = a + u
                    over = s < a
                    s += carry
                    carry = (over | (s < carry)).astype(np.uint64)
                    v[i, :k] = s | (a ^ u)
            n = self.n[item[some]]
            for i in range(size):
                full = np.where(n >= 64 * (i + 1), ~np.uint64(0), (np.uint64(1) << np.clip(n - 64 * i, 0, 63).astype(np.uint64)) - np.uint64(1))
                out[some] += np.bitwise_count(~v[i] & full)
        return out

    def _common_long(self, marks: np.ndarray, size: int) -> int:
        """The same for one stretch, with numbers of any length: items of many limbs are few and long."""
        v = full = (1 << 64 * size) - 1
        known: dict[int, int] = {}
        for k in marks.tolist():
            if (m := known.get(k)) is None:
                m = known[k] = int.from_bytes(self.marks[self.marks_at[k] : self.marks_at[k] + size].tobytes(), "little")
            u = v & m
            v = ((v + u) | (v - u)) & full
        return (full ^ v).bit_count()

    def _verify(self, t: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray, begins: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item number) of the cases of the second kind.

        Given are the pairs of places, sorted by text and item, between which hits are enough. A stretch
        is tried if it begins with a word of the item, holds such a pair, and enough words of the item in
        whatever order. Pieces of a stretch and a half, each of which holds all stretches that begin in
        its first third, are tried first.
        """
        cuts = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (item[1:] != item[:-1])])
        closes = np.r_[cuts[1:], len(item)] - 1
        k, d = item[cuts], docs[cuts]
        length, least = self.stretch[k], self.least[k]
        low = np.maximum(begins[d], last[cuts] - length + 1)
        size = np.minimum(begins[d + 1], first[closes] + length) - low
        group = np.repeat(np.arange(len(cuts)), size)
        place = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + low[group]
        code = k[group] * self.wide + t[place]
        maybe = self.known.maybe(self._hash(code))
        group, place, code = group[maybe], place[maybe], code[maybe]
        marks = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
        keep = self.keys[marks] == code
        group, place, marks = group[keep], place[keep], marks[keep]
        key = group * len(t) + place
        end = np.searchsorted(key, group * len(t) + np.minimum(place + length[group], len(t) - 1))
        ok = end - np.arange(len(key)) >= least[group]
        pair = np.searchsorted(np.repeat(np.arange(len(cuts)), closes - cuts + 1) * len(t) + first, key[ok])
        inner = pair <= closes[group[ok]]
        pair = np.minimum(pair, len(first) - 1)
        ok[ok] = inner & (last[pair] < place[ok] + length[group[ok]])
        tried = np.flatnonzero(ok)
        if not len(tried):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = group[tried]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        since = place[tried] - np.repeat(place[tried[starts]], np.diff(np.r_[starts, len(g)]))
        cell = g * (len(t) + 1) + since // np.maximum(1, length[g] // 2)
        heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        tails = np.r_[heads[1:], len(cell)] - 1
        held = self._common(k[g[heads]], tried[heads], end[tried[tails]], marks) >= least[g[heads]]
        rest = np.flatnonzero(np.repeat(held, tails - heads + 1))
        sure = self._common(k[g[rest]], tried[rest], end[tried[rest]], marks) >= least[g[rest]]
        found = np.unique(g[rest[sure]])
        return d[found], k[found]

    def search(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """(number of the text, item id) of every case in a batch of texts."""
        get = self.number.get
        t, begins = _flat([[get(w, 0) for w in ws] for ws in texts], TEXT_SPAN)
        size, many = len(t), len(self.ids)
        at = np.flatnonzero(self._all(t, range(RUN)))
        where, own = self.runs.hits(_seed(*(t[at + i] for i in range(RUN))))
        same = np.ones(len(where), bool)
        for i in range(RUN):
            same &= t[at[where] + i] == self.t[own + i]
        docs = np.searchsorted(begins, at[where[same]], "right") - 1
        found = np.unique(docs * many + self.owner[own[same]])
        pairs = []
        for a, b in masks(TEXT_SPAN):
            at = np.flatnonzero(self._all(t, (0, a, a + b)))
            where, item = self.seeds.hits(_seed(t[at], t[at + a], t[at + a + b]))
            pairs.append(item * size + at[where])
        code = np.sort(np.concatenate(pairs))
        code = code[np.r_[True, code[1:] != code[:-1]]] if len(code) else code
        item = code // size
        ahead = np.minimum(np.arange(len(code)) + np.maximum(self.need[item], 1) - 1, max(0, len(code) - 1))
        enough = (self.need[item] > 0) & (np.arange(len(code)) + self.need[item] <= len(code))
        enough &= code[ahead] - code < self.stretch[item]
        item, first, last = item[enough], code[enough] % size, code[ahead][enough] % size
        if len(self.singles.keys):
            at = np.flatnonzero(t)
            where, short = self.singles.hits(_seed(t[at]))
            item, first, last = np.r_[item, short], np.r_[first, at[where]], np.r_[last, at[where]]
        docs = np.searchsorted(begins, first, "right") - 1
        open_ = ~np.isin(docs * many + item, found)
        item, first, last, docs = item[open_], first[open_], last[open_], docs[open_]
        order = np.lexsort((first, item, docs))
        if len(order):
            d, k = self._verify(t, item[order], first[order], last[order], begins, docs[order])
            found = np.r_[found, d * many + k]
        return [(int(f // many), self.ids[int(f % many)]) for f in found]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """The items, each once, in blocks of bounded size; the driver holds one block at a time."""
    rows = items.select("item_id", "text").where("item_id IS NOT NULL").distinct().toLocalIterator()
    block: list[tuple[int, list[str]]] = []
    held = 0
    for r in rows:
        if ws := words(r.text):
            block.append((r.item_id, ws))
            held += len(ws)
        if held >= BLOCK_WORDS:
            yield block
            block, held = [], 0
    if block:
        yield block


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): each document that holds RUN successive words of an item, or, in a stretch of at
    most STRETCH times its length, SHARE of its words in its order.

    One pass over whole texts, which are cut into words once, for all items of up to BLOCK_WORDS words
    together. Their index is built once and sent to the executors; it has some hundred bytes for each
    word. Null and empty texts and items hold nothing. Rows of a repeated doc_id or item_id are looked
    at one by one; a pair is returned once.
    """
    spark = documents.sparkSession
    out, texts = None, spread(documents.where("doc_id IS NOT NULL").select("doc_id", "text"))
    for block in _blocks(items):
        index = spark.sparkContext.broadcast(Matcher(block))

        def run(parts: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            matcher = index.value
            for part in parts:
                ids, texts = iter(part["doc_id"].tolist()), iter(part["text"].tolist())
                while some := list(islice(texts, TEXTS)):
                    own = list(islice(ids, TEXTS))
                    found = matcher.search([words(x if isinstance(x, str) else None) for x in some])
                    yield pd.DataFrame({"doc_id": [own[d] for d, _ in found], "item_id": [i for _, i in found]}, dtype="int64")

        one = texts.mapInPandas(run, "doc_id bigint, item_id bigint")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct()
