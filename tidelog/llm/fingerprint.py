"""Document fingerprints by locally consistent parsing.

A text's code points are names of level 0. A level is parsed thus: runs of one name become one item;
three rounds of deterministic coin tossing (twice the place of the lowest bit in which a label differs
from its left neighbour's, plus that bit) leave labels below 8 of which neighbours differ; a phrase
starts at each local maximum; its name is a hash of its items. Where a phrase starts depends on four
items to the left and one to the right only, so equal substrings have equal names inside, wherever they
stand. Names of a level are parsed again for the next one.

A fingerprint holds the smallest ``SKETCH`` distinct names of level ``LEAST`` and of each higher one with ``ENOUGH``
phrases. All phrases of the whole text take part, and every text that isn't empty has a phrase at each level; where it has only one, that is the name of the
whole text. Likeness is the Dice share of common names at level ``FINE``, whose phrases hold some 16 code points at every length of
text, or at ``LEAST`` (some 6) if one of the two texts has fewer than ``ENOUGH`` phrases there; it is estimated from the smallest names of both together
(standard error up to about 0.1). So scattered edits cost the same share at every length. Levels grow with the logarithm of the text's length.

A null text is an empty one, whose fingerprint has no names; two empty texts are alike (1). The next
document is the one with the next lower id, after the last the first; null ids come last, ties go by a
hash of the text. Repeated rows stay, each with its own successor. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import id_text, mix64

SKETCH, ENOUGH, LEAST, FINE = 48, 24, 2, 3
#: Code points that one vectorised step takes at most, besides a single longer text.
STEP_CHARS = 1 << 18
LOWEST = -(1 << 63)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: Odd multiplier whose powers weigh the items of a phrase, and its inverse modulo 2^64.
FACTOR = 0xD1342543DE82EF95
INVERSE = pow(FACTOR, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of both, at least; kept by the worker for its longest step."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((FACTOR, INVERSE)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[i] = np.cumprod(row)
    return _POWERS


def _again() -> np.ndarray:
    """A further round of coin tossing for each pair (left label, own label) below 128."""
    own, left = np.meshgrid(np.arange(128), np.arange(128))
    differ = own ^ left
    low = differ & -differ
    place = np.bitwise_count(low.astype(np.int64) - 1)
    return np.where(differ == 0, 0, 2 * place + ((own & low) != 0)).astype(np.uint8).reshape(-1)


AGAIN = _again()


def _labels(items: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8 after three rounds of coin tossing on 32 bits of the items; the first item of a
    document counts as differing from a left neighbour in bit 0."""
    own = items.astype(np.uint32)
    differ = own.copy()
    differ[1:] ^= own[:-1]
    differ[first] = 1
    low = differ & (~differ + np.uint32(1))
    labels = (np.bitwise_count(low - np.uint32(1)) << np.uint8(1)) | ((own & low) != 0)
    for _ in range(2):
        pairs = labels.astype(np.uint16)
        pairs[1:] |= labels[:-1].astype(np.uint16) << np.uint16(7)
        pairs[first] = labels[first] | (labels[first] ^ np.uint8(1)).astype(np.uint16) << np.uint16(7)
        labels = AGAIN[pairs]
    return labels


def _parsed(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and each document's first one; ``starts`` ends with the number of names."""
    n = len(names)
    if not n:
        return names.astype(np.uint64), starts
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(names[1:], names[:-1], out=fresh[1:])
    fresh[starts[:-1][starts[:-1] < n]] = True
    at = np.flatnonzero(fresh)
    items = names[at].astype(np.uint64)
    if len(at) < n:
        items += (np.diff(np.append(at, n)) - 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        starts = np.searchsorted(at, starts)
    items = mix64(items)
    first = np.unique(starts[:-1][starts[:-1] < len(items)])
    labels = _labels(items, first) + np.uint8(1)
    rises = np.empty(len(items) + 1, bool)
    rises[0], rises[-1] = True, False
    np.greater(labels[1:], labels[:-1], out=rises[1:-1])
    peak = rises[:-1] & ~rises[1:]
    peak[first] = True
    peak[first[1:] - 1] |= rises[first[1:] - 1]
    begins = np.flatnonzero(peak)
    up, down = _powers(len(items))
    return mix64(np.add.reduceat(items * up[: len(items)], begins) * down[begins]), np.searchsorted(begins, starts)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprints of texts, all parsed together level by level."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    levels = [(names, starts)]
    while len(levels) <= LEAST or int(np.diff(levels[-1][1]).max(initial=0)) >= ENOUGH:
        levels.append(_parsed(*levels[-1]))
    counts = np.stack([np.diff(s) for _, s in levels])
    top = np.maximum((counts >= ENOUGH).sum(axis=0) - 1, LEAST)

    def sketch(level: int, i: int) -> str:
        names, starts = levels[level]
        return f"{level}:" + np.unique(names[starts[i] : starts[i + 1]] >> np.uint64(32))[:SKETCH].astype(">u4").tobytes().hex()

    return ["|".join(sketch(k, i) for k in range(t, LEAST - 1, -1)) for i, t in enumerate(top.tolist())]


def _levels_of(fingerprint: str) -> dict[int, list[str]]:
    out = {}
    for part in fingerprint.split("|"):
        level, _, values = part.partition(":")
        out[int(level)] = [values[i : i + 8] for i in range(0, len(values), 8)]
    return out


def likeness(one: str, other: str) -> float:
    """From 0 (no common names) to 1 (equal)."""
    if one == other:
        return 1.0
    a, b = _levels_of(one), _levels_of(other)
    level = FINE if FINE in a and FINE in b else LEAST
    x, y = set(a[level]), set(b[level])
    whole = len(x) < SKETCH and len(y) < SKETCH
    least = sorted(x | y)[: None if whole else SKETCH]
    jaccard = sum(v in x and v in y for v in least) / max(1, len(least))
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(4)))


def _worked(rows: list[tuple]) -> pa.RecordBatch:
    """Of (doc_id, text, next text): one output row each."""
    own, after = [r[1] for r in rows], [r[2] for r in rows]
    changed = [edited(a, b) for a, b in zip(own, after)]
    unique = list(dict.fromkeys([*own, *after, *changed]))
    prints = dict(zip(unique, fingerprints(unique)))
    columns = [
        pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array([prints[t] for t in own]), pa.array([prints[t] for t in changed]),
        pa.array([likeness(prints[a], prints[b]) for a, b in zip(own, changed)], pa.float64()), pa.array([likeness(prints[a], prints[b]) for a, b in zip(own, after)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, guest, doc_id, text), sorted; each row's successor is the row after it in its bucket."""
    ready: list[tuple] = []
    size, last = 0, None
    for bucket, guest, doc_id, text in _rows(batches):
        if last is not None and last[0] == bucket and not last[1]:
            ready.append((last[2], last[3], text))
            size += 2 * len(last[3]) + len(text)
            if size >= STEP_CHARS:
                yield _worked(ready)
                ready, size = [], 0
        last = (bucket, guest, doc_id, text)
    if ready:
        yield _worked(ready)


def fingerprint_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its text edited with its successor's.

    Ids are cut at quantiles into buckets, three for each shuffle partition; the first document of a bucket
    goes as a guest to the bucket before, so that one shuffle brings every document beside its successor.
    The driver sees a split and a highest id for each bucket."""
    spark = df.sparkSession
    docs = id_text(df, id_col, text_col).withColumn("key", F.coalesce(F.col("doc_id"), F.lit(LOWEST)))
    buckets = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select("key").approxQuantile("key", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    cuts = np.unique(np.array(cuts, np.float64))

    @F.pandas_udf("int")
    def bucket_of(key):
        return key.__class__(np.searchsorted(cuts, key.to_numpy().astype(np.float64), side="right").astype(np.int32))

    highest = sorted(docs.select("key", bucket_of("key").alias("bucket")).groupBy("bucket").agg(F.max("key").alias("key")).collect(), key=lambda r: -r.bucket)
    host = {r.key: highest[i - 1].bucket for i, r in enumerate(highest)}  # the first of the highest bucket follows the last of the lowest

    @F.pandas_udf("array<int>")
    def places(key):
        own = np.searchsorted(cuts, key.to_numpy().astype(np.float64), side="right").tolist()
        return key.__class__([[2 * b] + ([2 * host[k] + 1] if k in host else []) for b, k in zip(own, key.tolist())])

    placed = docs.select("doc_id", "key", "text", F.explode(places("key")).alias("place"))
    placed = placed.select(F.shiftright("place", 1).alias("bucket"), (F.col("place") % 2).alias("guest"), "doc_id", "text", "key")
    near = placed.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), F.xxhash64("text"))
    return near.select("bucket", "guest", "doc_id", "text").mapInArrow(_with_next, SCHEMA)
