"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

A text's terms are hashed pairs of bytes, counted over the whole text, and bins of its form (share of
upper case, of punctuation, of digits, word length, how far it compresses). Counts are damped, weighted
by inverse document frequency and projected by a truncated singular value decomposition of the labelled
sample. The labelled vectors (``SAMPLE`` of ``RANK`` numbers, so a proven size) are broadcast; every
document's exact cosines with all of them are computed block by block, and its ``NEIGHBOURS`` nearest
vote, each weighted by a power of its similarity.

Labels come only from rows whose crc32(doc_id as text) modulo 5 is not 0, of which at most ``SAMPLE``
are used, lowest hash of the id first, within ``samples.SAMPLE_CHARS`` characters. One task fits the projection; texts and
their term counts stay in it. A null text is an empty one. Without usable labels every score
is 1; labels with nulls are not used; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import samples
from tidelog.llm.common import crc_mod, id_text, score_column

SAMPLE, RANK, NEIGHBOURS, BUCKETS, BLOCK = 4000, 48, 15, 2048, 256
THRESHOLD = 0.3
FORMS, FORM_WEIGHT = 6 * 8, 0.4


def _pair_buckets() -> np.ndarray:
    """The bucket of each pair of bytes."""
    x = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % BUCKETS


PAIRS = _pair_buckets().astype(np.int16)
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(65, 91)]] = 1
KINDS[[*range(48, 58)]] = 2
KINDS[[*range(9, 14), 32]] = 3
KINDS[[i for i in range(33, 127) if not chr(i).isalnum()]] = 4


def terms_of(text: bytes) -> np.ndarray:
    """Counts of a text's terms, damped."""
    out = np.zeros(BUCKETS + FORMS, np.float32)
    b = np.frombuffer(text, np.uint8)
    if len(b) > 1:
        out[:BUCKETS] = np.bincount(PAIRS[b[:-1].astype(np.uint16) << 8 | b[1:]], minlength=BUCKETS)
        np.sqrt(out[:BUCKETS] / len(b), out=out[:BUCKETS])
    n = max(1, len(b))
    kinds = np.bincount(KINDS[b], minlength=5) / n
    squeezed = len(zlib.compress(text, 1)) / (n + 20)
    shape = (4 * kinds[1], 8 * kinds[2], 4 * abs(kinds[3] - 0.16), 8 * kinds[4], 1.4 * squeezed, np.log1p(n) / 12)
    for k, x in enumerate(shape):
        x = min(max(float(x), 0.0), 1.0) * 7
        low = min(int(x), 6)
        out[BUCKETS + 8 * k + low], out[BUCKETS + 8 * k + low + 1] = (1 - (x - low)) * FORM_WEIGHT, (x - low) * FORM_WEIGHT
    return out


class Voter:
    """Projection and labelled vectors."""

    def __init__(self, texts: list[bytes], labels: list[int]):
        counts = np.stack([terms_of(t) for t in texts])
        self.weights = np.log((len(texts) + 1) / ((counts > 0).sum(axis=0) + 1)).astype(np.float32) + 0.3
        counts *= self.weights
        start = np.random.default_rng(7).standard_normal((counts.shape[1], RANK + 16)).astype(np.float32)
        for _ in range(3):
            start = np.linalg.qr(counts.T @ (counts @ start))[0]
        self.basis = np.ascontiguousarray((start @ np.linalg.svd(counts @ start, full_matrices=False)[2].T)[:, :RANK])
        self.labels = np.array(labels, np.float32)
        self.vectors = self._unit(counts @ self.basis)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), BLOCK):
            near = self._unit((np.stack([terms_of(t) for t in texts[at : at + BLOCK]]) * self.weights) @ self.basis) @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(near, best, axis=1), 1e-3).astype(np.float64) ** 4
            out.append((votes * self.labels[best]).sum(axis=1) / votes.sum(axis=1))
        return np.concatenate(out) if out else np.zeros(0)


def _trained(texts: list[str], labels: list[int]) -> Voter:
    return Voter([t.encode() for t in texts], labels)


def scorer(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Callable[[Column], Column]:
    """The function from a text to its score, with the labelled vectors of ``docs``."""
    sample = samples.labelled(docs, labels, label_col, 5, 0, {None: SAMPLE})
    voter = docs.sparkSession.sparkContext.broadcast(samples.fitted(sample, _trained))
    return score_column(lambda texts: np.ones(len(texts)) if voter.value is None else voter.value.scores(texts), as_bytes=True, limit=2 << 20)


def quality_table(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: held_out, score (likelihood of label 1) and predicted."""
    docs = id_text(df, id_col, text_col)
    scored = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), scorer(docs, labels, label_col)("text").alias("score"))
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
