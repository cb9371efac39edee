"""Byte-level BPE encoding and decoding over length-bucketed, padded numpy matrices.

Distinct pieces of a batch of documents become rows of a matrix of ids, one matrix for each
length bucket. In each round every row merges its leftmost pair of minimum rank; the ranks of
pairs come from a hash table with open addressing; rows without a mergeable pair leave the
matrix (compaction). Buckets double without an end. Where rows are WIDE or wider, a row merges in one round all pairs of its minimum rank, from
left to right, that would be its next leftmost minima anyway: as no merge of a pair makes a smaller rank, the order is that of single
merges (where one would, the row merges its leftmost alone). So rounds grow with the ranks that a piece holds and not with its
length, and one endless word costs no quadratic time.

Cases: a null or empty text has no tokens and decodes to no bytes. Very long texts are encoded whole, their pieces in buckets of their
length. Of pairs of equal rank the leftmost merges first. Repeated rows, null and repeated doc_ids are encoded
each on their own and give equal results for equal texts. An empty table gives an empty table. Other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mapped, texts

BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128)
WIDE = 256
NONE = np.int32(2**31 - 1)
#: Pieces kept between batches in one worker.
CACHE = 150_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        self.bits = max(4, (4 * len(pairs) + 16).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.probes = 1
        left = np.array(pairs, np.int64).reshape(-1, 3)
        keys, values = left[:, 0] << 32 | left[:, 1], left[:, 2].astype(np.int32)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            put = free & first
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            keys, values, slots = keys[~put], values[~put], (slots[~put] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged tokens; NONE where a pair doesn't merge or an id is padding (-1)."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys = np.where((left < 0) | (right < 0), np.int64(-2), keys)
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1) & (keys != -2))
        for _ in range(self.probes):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(shape)


class Encoder:
    """Encodes and decodes with the ranks of one vocabulary."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        self.ranks = read_ranks(raw)
        self.find = regex.compile(pattern).findall
        self.pairs = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        n = max(self.ranks.values()) + 1
        self.tokens, self.names = [b""] * n, [str(i) for i in range(n)]
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.cache: dict[str, tuple[int, ...]] = {}

    def encode_batch(self, docs: list[str]) -> list[list[int]]:
        """Ids of each text, every match of the pattern encoded by itself."""
        pieces = [self.find(d) for d in docs]
        new = set().union(*pieces) - self.cache.keys() if pieces else set()
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = set().union(*pieces)
        got = self.cache
        got.update(zip(new, self._encode([p.encode() for p in new]), strict=True))
        return [list(chain.from_iterable(map(got.__getitem__, p))) for p in pieces]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def id_text(self, ids: list[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))

    def _encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = (whole,)
            else:
                buckets.setdefault(next((w for w in BUCKETS if len(p) <= w), 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            if width >= WIDE:
                for i in rows:
                    out[i] = self._wide(pieces[i])
                continue
            step = max(1, (1 << 19) // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        columns = np.arange(width)
        ids = np.where(columns < length[:, None], self.byte_ids[raw], np.int32(-1))
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], 1)
        ranks = self.pairs.get(ids[:, :-1], ids[:, 1:])
        ranks = np.concatenate([ranks, np.full((n, 1), NONE, np.int32)], 1)
        final, size, alive = np.full((n, width), -1, np.int32), length.copy(), np.arange(n)
        while len(alive):
            at = ranks.argmin(1)  # the leftmost of the least
            best = ranks[np.arange(len(alive)), at]
            done = best == NONE
            if done.any():
                final[alive[done]] = ids[done, :width]
                keep = ~done
                ids, ranks, alive, at, best = ids[keep], ranks[keep], alive[keep], at[keep], best[keep]
                if not len(alive):
                    break
            rows = np.arange(len(alive))
            size[alive] -= 1
            ids[rows, at] = best
            source = np.minimum(np.arange(width + 1) + (np.arange(width + 1) > at[:, None]), width)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            ranks[rows, at] = self.pairs.get(best, ids[rows, at + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pairs.get(ids[before, at[before] - 1], best[before])
        return [tuple(row[:k]) for row, k in zip(final.tolist(), size.tolist(), strict=True)]

    def _wide(self, piece: bytes) -> tuple[int, ...]:
        """A matrix of one row, which merges all pairs of its minimum rank in a round."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = np.append(self.pairs.get(ids[:-1], ids[1:]), NONE)
        while (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            # of pairs that overlap in a run, the first, third, ... merge
            run = np.cumsum(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            merged, left = ids.copy(), np.ones(len(ids), bool)
            merged[at], left[at + 1] = best, False
            merged, places = merged[left], at - np.arange(len(at))
            around = np.unique(np.concatenate([places, places[places > 0] - 1]))
            around = around[around < len(merged) - 1]
            fresh = self.pairs.get(merged[around], merged[around + 1])
            beside = ids[at[at + 2 < len(ids)] + 2]  # the right neighbours when the merges come one by one
            between = self.pairs.get(np.full(len(beside), best, np.int32), beside)
            if len(at) > 1 and min(fresh.min(initial=NONE), between.min(initial=NONE)) < best:  # not in ranks of trained vocabularies
                at = at[:1]
                merged = np.delete(ids, at + 1)
                merged[at] = best
                left = np.ones(len(ids), bool)
                left[at + 1] = False
                around = np.unique(np.concatenate([at, at[at > 0] - 1]))
                around = around[around < len(merged) - 1]
                fresh = self.pairs.get(merged[around], merged[around + 1])
            ids, ranks = merged, ranks[left]
            ranks[around] = fresh
            ranks[-1] = NONE
        return tuple(ids.tolist())


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (with_ids), ids_sha256 and decoded_sha256 of each row of docs(doc_id, text).

    decoded_sha256 is of the bytes that come from decoding the ids again. The vocabulary is read
    on the driver and broadcast: its size is that of one tokenizer file. No shuffle.
    """
    with open(ranks_path, "rb") as f:
        raw = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(raw), (hashlib.sha256(raw).digest(), pattern)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        enc = kept(key, lambda: Encoder(shared.value, pattern))  # made once in a worker

        def step(batch: pa.RecordBatch) -> dict:
            out = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
            rows = texts(batch)
            for at in range(0, len(rows), 500):
                for ids in enc.encode_batch(rows[at : at + 500]):
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(enc.id_text(ids).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(enc.decode(ids)).hexdigest())
                    if with_ids:
                        out["ids"].append(pa.array(ids, pa.int32()))
            return out

        return step

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), make, schema, keeps=key)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the decoded bytes of each row of encoded(doc_id, ids); null ids give null."""
    with open(ranks_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def make():
        tokens = {r: t for t, r in read_ranks(shared.value).items()}

        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "bytes": [None if ids is None else b"".join(map(tokens.__getitem__, ids)) for ids in batch.column("ids").to_pylist()]}

        return step

    return mapped(encoded.select("doc_id", "ids"), make, f"doc_id {kind}, bytes binary")
