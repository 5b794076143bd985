"""Byte-level BPE encoding and decoding.

Text is split by the tokenizer's pattern, and each pre-token is encoded by itself, in two tiers:

* a minimal perfect hash over the vocabulary resolves a pre-token that is itself a token in one probe and
  one comparison;
* any other pre-token goes through the merges: its bytes form a linked list, and a heap yields the
  adjacent pair of lowest rank (leftmost first) until no pair is in the vocabulary.

The vocabulary (a bounded file) is read once on the driver and broadcast.  Encoding needs no shuffle:
each Arrow batch of whole texts is encoded where it is read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

MAX_VOCAB_BYTES = 64 << 20  # bound of what is broadcast
MEMO_BYTES = 64 << 20  # memory of the pre-tokens whose ids a task remembers
ENTRY_BYTES = 200  # of it, what an entry takes beside its characters and ids
LONG_TEXT = 1 << 21  # characters from which a text's pre-tokens are taken in several lists


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in rank order; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, f.read().splitlines()) if t)
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    if sum(len(t) for _, t in pairs) > MAX_VOCAB_BYTES:
        raise ValueError("vocabulary too large to broadcast")
    return [t for _, t in pairs]


def _mix(h: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    x = (h ^ (seed * np.uint64(0x9E3779B97F4A7C15)))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash from n keys to n slots: hash and displace.

    Keys fall into buckets; from the fullest bucket on, each bucket tries seeds until all of its keys land in
    free slots.  A bucket with one key points at one of the slots left over.  A probe is one 64-bit
    hash, one bucket entry and one slot.  Unknown keys land on some slot too, so the key stored there is compared.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.m = len(keys), max(1, len(keys) // 3)
        h = self.hashes(keys)
        if len(np.unique(h)) != self.n:
            raise ValueError("keys must differ in their 64-bit hash")
        bucket = (h % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.m + 1))
        size = np.diff(cuts)
        #: a seed, or -1 - slot for a bucket with one key
        self.entry = np.zeros(self.m, dtype=np.int64)
        self.slot = np.full(self.n, -1, dtype=np.int64)
        n = np.uint64(self.n)
        for b in np.argsort(-size, kind="stable"):
            own = order[cuts[b]:cuts[b + 1]]
            if len(own) < 2:
                break
            first = 0
            while True:
                seeds = np.arange(first, first + 64, dtype=np.uint64)[:, None]
                places = (_mix(h[own][None, :], seeds) % n).astype(np.int64)
                ok = (self.slot[places] < 0).all(axis=1)
                ok &= (np.diff(np.sort(places, axis=1), axis=1) > 0).all(axis=1)
                if ok.any():
                    k = int(ok.argmax())
                    self.entry[b], self.slot[places[k]] = first + k, own
                    break
                first += 64
        alone = np.flatnonzero(size == 1)
        free = np.flatnonzero(self.slot < 0)
        self.entry[alone] = -1 - free
        self.slot[free] = order[cuts[alone]]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """For each key, the index of the only stored key it can be equal to."""
        h = self.hashes(keys)
        e = self.entry[(h % np.uint64(self.m)).astype(np.int64)]
        seeded = (_mix(h, np.maximum(e, 0).astype(np.uint64)) % np.uint64(self.n)).astype(np.int64)
        return self.slot[np.where(e < 0, -1 - e, seeded)]


class Vocabulary:
    """Tokens by id, the perfect hash over them, and the merge ranks."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.hash = tokens, PerfectHash(tokens)
        by_byte = {t[0]: i for i, t in enumerate(tokens) if len(t) == 1}
        if len(by_byte) != 256:
            raise ValueError("every single byte must be a token")
        self.byte_id = [by_byte[b] for b in range(256)]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rank"}

    def __getattr__(self, name):
        if name != "rank":
            raise AttributeError(name)
        self.rank = {t: i for i, t in enumerate(self.tokens)}  # only tasks that merge build it
        return self.rank

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no token itself."""
        n, get = len(piece), self.rank.get
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = [self.byte_id[b] for b in piece]
        end = list(range(1, n + 1))  # where the part that starts here ends
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)  # rank, start of the left part, end of the right part
        while heap:
            r, i, stop = heapq.heappop(heap)
            if ids[i] < 0 or (j := nxt[i]) >= n or end[j] != stop:
                continue  # one of the two parts has been merged meanwhile
            ids[i], ids[j], end[i] = r, -1, stop
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                if (s := get(piece[i:end[k]])) is not None:
                    heapq.heappush(heap, (s, i, end[k]))
            if (p := prev[i]) >= 0 and (s := get(piece[p:stop])) is not None:
                heapq.heappush(heap, (s, p, stop))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of each piece: the perfect hash first, merges for what it does not hold."""
        if not pieces:
            return []
        tokens, merge = self.tokens, self.merge
        return [c.to_bytes(4, "little") if tokens[c] == p else b"".join([x.to_bytes(4, "little") for x in merge(p)])
                for p, c in zip(pieces, self.hash.candidates(pieces).tolist())]


def _runs_of_pieces(pattern: regex.Pattern, text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text, in lists of bounded length."""
    if len(text) <= LONG_TEXT:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(islice(found, LONG_TEXT // 4)):
        yield part


class Encoder:
    """Encodes texts; remembers the pre-tokens it has resolved, in bounded memory."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.pattern, self.memo, self.held = vocab, regex.compile(pattern), {}, 0

    def encode(self, text: str) -> bytes:
        out, memo = [], self.memo
        for pieces in _runs_of_pieces(self.pattern, text):
            new = list(set(pieces).difference(memo))
            if new:
                ids = self.vocab.encode_pieces([p.encode() for p in new])
                size = sum(map(len, new)) + sum(map(len, ids)) + ENTRY_BYTES * len(new)
                if self.held + size > MEMO_BYTES:  # what these pieces need stays, the rest is resolved again when it returns
                    known = {p: memo[p] for p in set(pieces).intersection(memo)}
                    memo.clear()
                    memo.update(known)
                    self.held = sum(len(p) + len(i) + ENTRY_BYTES for p, i in known.items())
                memo.update(zip(new, ids))
                self.held += size
            out.append(b"".join([memo[p] for p in pieces]))
        return b"".join(out)


def encode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, ids binary`` per row of ``docs``: the text's token ids as little-endian unsigned 32-bit integers.

    Null text encodes like the empty text, to no ids.  Special tokens are ordinary text.  Repeated rows each give
    a row; null ids stay null; an empty table gives an empty result.  ``keep`` names further columns to carry.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(vocab_path)))
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            out = [encoder.encode(x.as_py()) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))]
                                             + [pa.array(out, pa.binary())], names=[*names, "ids"])

    src = docs.select(*[F.col(f"`{c}`") for c in names], whole_text(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{schema}, ids binary")


def decode(encoded: DataFrame, vocab_path: str, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The encoded rows with ``bytes``: the tokens of ``ids`` put together again.  Null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            out = [b"".join(map(token, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "bytes"])

    src = encoded.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInArrow(run, f"{schema}, bytes binary")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and checksums of ids and decoded bytes per row."""
    return decoded.select(id_col, (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("bytes", 256).alias("decoded_sha256"))
