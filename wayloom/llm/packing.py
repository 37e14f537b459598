"""Whole texts in containers of fixed capacity.

Every document becomes a vector of hashed words, projected to three dimensions; its place on a Hilbert
curve through them is its key. Documents are range-sorted by key, so that neighbours are alike, and
packed along the curve: a window of neighbours is put, longest first, into the open container with the
least room that suffices. Only a text longer than a container is split, into full containers and a rest.
"""

from __future__ import annotations

import base64
import bisect
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.words import words
from wayloom.session import cut, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes that a vocabulary may have at most, as it is sent to all executors.
VOCABULARY_BYTES = 64 << 20
DIMENSIONS, BITS = 3, 10
#: Documents that are packed together, and containers that stay open along the curve.
WINDOW, OPEN = 4_096, 1_024
_HASHED = 512


def vocabulary_of(path: str) -> tuple[bytes, str]:
    """The contents of a ranks file, and the public splitting pattern: what tasks get sent, as they need not have the file."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        # Fixed value: splits into contractions, letters, digits, other signs and white space
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        return f.read(), pattern


@functools.lru_cache(maxsize=2)
def tokenizer(data: bytes, pattern: str):
    """The byte-level tokenizer of a ranks file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (n x d) of non-negative integers below 2**bits.

    The usual transposed form: from the highest bit down, a set bit inverts the lower bits of the
    first axis, a clear one exchanges them with the axis at hand; then a Gray code undoes the turns.
    """
    x = points.astype(np.int64).copy()
    n, d = x.shape
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(d):
            up = (x[:, i] & q) > 0
            turned = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] ^= np.where(up, p, turned)
            if i:
                x[:, i] ^= np.where(up, 0, turned)
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[:, d - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


@functools.lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((_HASHED, DIMENSIONS))


def curve_keys(texts: list[str]) -> np.ndarray:
    """Hilbert keys of texts: signed counts of hashed words, projected; a text without words is at the middle."""
    at = np.zeros((len(texts), DIMENSIONS))
    hashed: dict[str, int] = {}
    for i, t in enumerate(texts):
        v = np.zeros(_HASHED)
        codes = []
        for w in words(t):
            if (h := hashed.get(w)) is None:
                h = hashed[w] = zlib.crc32(w.encode())
            codes.append(h)
        if codes:
            c = np.array(codes, np.int64)
            np.add.at(v, c % _HASHED, np.where((c >> 16) & 1, 1.0, -1.0))
            length = np.linalg.norm(v)
            at[i] = v @ _projection() / length if length else 0
    side = 1 << BITS
    return hilbert(np.clip((at + 4) / 8 * side, 0, side - 1).astype(np.int64), BITS)


def measured(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, tokens, key): whole texts, in one pass. A null text has no tokens."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(*sent.value)
        for part in parts:
            for i in range(0, len(part), 1_000):
                some = part.iloc[i : i + 1_000]
                texts = [t if isinstance(t, str) else "" for t in some["text"]]
                sizes = [len(enc.encode_ordinary(t)) for t in texts]
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "tokens": sizes, "key": curve_keys(texts)})

    return spread(documents.where("doc_id IS NOT NULL").select("doc_id", "text")).mapInPandas(run, "doc_id bigint, tokens bigint, key bigint")


class Shelf:
    """Open containers, sorted by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.next = capacity, [], 0

    def put(self, size: int) -> tuple[int, int]:
        """(container, place of its first token) for an item: the container with the least room that suffices."""
        i = bisect.bisect_left(self.rooms, (size, -1))
        if i < len(self.rooms):
            room, box = self.rooms.pop(i)
        else:
            room, box, self.next = self.capacity, self.next, self.next + 1
        if room > size:
            bisect.insort(self.rooms, (room - size, box))
        return box, self.capacity - room

    def close(self) -> None:
        """Leaves the OPEN containers with most room."""
        if len(self.rooms) > OPEN:
            del self.rooms[: len(self.rooms) - OPEN]


def pack(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container, place, doc_id, piece, start, tokens): where each piece of each text goes.

    A text of at most capacity tokens is one piece. A longer one is cut into pieces of capacity tokens,
    each a container of its own, and a rest that is packed like any other. place: the tokens before the
    piece in its container; start: its first token in the text. Null and empty texts take no room: they
    have container null. Rows with a null doc_id are left out; a repeated doc_id is packed as often.

    Sizes and keys, a few bytes a document, are written once before they are range-sorted, as Spark reads
    the rows twice for that. Equal keys are told apart by a hash of doc_id, so that no crowd of
    copies ends in one task.
    """
    sizes = cut(measured(documents, vocabulary))
    pieces = F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.lit(capacity)).cast("int"))
    items = sizes.where("tokens > 0").select("doc_id", "tokens", "key", F.explode(pieces).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * F.lit(capacity).cast("long")).alias("start"), "key", F.xxhash64("doc_id").alias("spread"),
        F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece") * F.lit(capacity).cast("long")).alias("tokens"),
    )
    ordered = items.repartitionByRange("key", "spread").sortWithinPartitions("key", "spread", "doc_id", "piece")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shelf, base = Shelf(capacity), TaskContext.get().partitionId() << 40
        held: list[pd.DataFrame] = []

        def window(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("tokens", ascending=False, kind="stable")
            put = [shelf.put(t) for t in rows["tokens"].tolist()]
            shelf.close()
            return rows.assign(container=[base + b for b, _ in put], place=[p for _, p in put])[
                ["container", "place", "doc_id", "piece", "start", "tokens"]
            ]

        for part in parts:
            held.append(part)
            if sum(map(len, held)) >= WINDOW:
                rows = pd.concat(held, ignore_index=True)
                whole = len(rows) // WINDOW * WINDOW
                for i in range(0, whole, WINDOW):
                    yield window(rows.iloc[i : i + WINDOW])
                held = [rows.iloc[whole:]]
        if sum(map(len, held)):
            yield window(pd.concat(held, ignore_index=True))

    schema = "container bigint, place bigint, doc_id bigint, piece int, start bigint, tokens bigint"
    packed = ordered.select("doc_id", "piece", "start", "tokens").mapInPandas(run, schema)
    none = sizes.where("tokens = 0").selectExpr(
        "CAST(NULL AS bigint) container", "0L AS place", "doc_id", "0 AS piece", "0L AS start", "0L AS tokens"
    )
    return packed.unionByName(none)
