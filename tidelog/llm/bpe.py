"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace: a first hash picks a bucket,
the bucket's displacement sends its keys to slots that no other key has, as many slots as keys).
A pre-token that is the key of its slot is one id. Tier two: other pre-tokens start as a doubly linked
list of bytes; a heap of (rank, position) gives the next pair to merge, and entries whose nodes have
changed since are skipped. Both agree with the merges of the rank file, lowest rank first and leftmost
among equals.

A null or empty text has no ids. Texts of any length are encoded whole. Rows are independent, so ties,
repeated rows and order do not matter; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from tidelog.llm.common import id_text, map_steps

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pre-tokens in one generation of a worker's memory, of which it holds two. Longer pre-tokens aren't remembered.
MEMO, MEMO_LENGTH = 400_000, 48


def ranks_of(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 bytes and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash from byte strings to their place in ``keys``; strangers give -1."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.keys, self.n = keys, max(1, len(keys))
        self.buckets = max(1, self.n // per_bucket)
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault((h >> 64) % self.buckets, []).append(i)
        free = np.ones(self.n, bool)
        self.moves = np.zeros(self.buckets, np.int64)
        self.slots = np.full(self.n, -1, np.int64)
        spare = None
        for bucket, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:  # any free slot, named outright
                if spare is None:
                    spare = iter(np.flatnonzero(free).tolist())
                slot = next(spare)
                self.moves[bucket], self.slots[slot] = -1 - slot, members[0]
                continue
            move = 0
            while True:
                places = [self._place(hashes[i], move) for i in members]
                if len(set(places)) == len(places) and all(free[p] for p in places):
                    break
                move += 1
            self.moves[bucket] = move
            for i, p in zip(members, places):
                free[p], self.slots[p] = False, i
        self.move_list, self.slot_list = self.moves.tolist(), self.slots.tolist()

    def _place(self, h: int, move: int) -> int:
        x = ((h & 0xFFFFFFFFFFFFFFFF) + move * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return (x ^ x >> 32) * 0xA0761D6478BD642F % 0x10000000000000000 * self.n >> 64

    def find(self, key: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(key)
        move = self.move_list[(h >> 64) % self.buckets]
        i = self.slot_list[-1 - move if move < 0 else self._place(h, move)]
        return i if i >= 0 and self.keys[i] == key else -1


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token by merges, from a heap over linked bytes. A node is named by its first byte
    and ends where the next one starts; a heap entry counts while its node's pair still has its rank."""
    n, get, none = len(piece), ranks.get, 1 << 40
    bits = n.bit_length()
    mask = (1 << bits) - 1
    after, before = list(range(1, n + 2)), list(range(-1, n))
    pair = [get(piece[i : i + 2], none) for i in range(n)]
    pair[n - 1] = none
    heap = [r << bits | i for i, r in enumerate(pair) if r != none]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        left = top & mask
        if pair[left] != top >> bits:
            continue
        right = after[left]
        stop = after[left] = after[right]
        pair[right] = pair[left] = none
        if stop < n:
            before[stop] = left
            pair[left] = rank = get(piece[left : after[stop]], none)
            if rank != none:
                heapq.heappush(heap, rank << bits | left)
        first = before[left]
        if first >= 0:
            pair[first] = rank = get(piece[first:stop], none)
            if rank != none:
                heapq.heappush(heap, rank << bits | first)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes texts to little-endian 32-bit ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.keys = list(ranks)
        self.hash = PerfectHash(self.keys)
        self.key_ids = [ranks[k] for k in self.keys]
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids_of(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            key = piece.encode()
            i = self.hash.find(key)
            ids = (self.key_ids[i],) if i >= 0 else merged(key, self.ranks)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join([self.memo.get(p) or self.ids_of(p) for p in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple, Codec] = {}


def codec(ranks: dict[bytes, int], pattern: str, name: str) -> Codec:
    """This worker's codec of that name, made once."""
    if (name, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[name, pattern] = Codec(ranks, pattern)
    return _CODECS[name, pattern]


def encoded_table(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a document: number of ids, digests of ids and of the bytes decoded from them; with
    ``keep_ids`` also ``ids`` (binary, little-endian 32-bit). ``vocabulary``: a rank file that the driver
    reads; workers get its ranks (under 1 MB for 50,000 tokens) by broadcast."""
    ranks = df.sparkSession.sparkContext.broadcast(ranks_of(vocabulary))
    name = hashlib.sha256(repr(sorted(ranks.value.items())).encode()).hexdigest()

    def work(part: pa.RecordBatch) -> dict:
        c = codec(ranks.value, pattern, name)
        ids = [c.encode(t) for t in part.column(1).to_pylist()]
        got = {"doc_id": part.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(c.decode(x)).hexdigest() for x in ids]}
        return got | ({"ids": ids} if keep_ids else {})

    return map_steps(id_text(df, id_col, text_col), work, SCHEMA + ", ids binary" * keep_ids)
