"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings sums, over all common subsequences of ``LENGTH`` characters, the product of
``DECAY`` to the power of their spans, normalised by the strings' own kernels, and is raised to ``POWER``:
an insult with inserted characters or gaps keeps a share of it that clean words do not reach. Where the longest common subsequence is
below ``NEED`` of the landmark's length (or below ``LENGTH``) the kernel counts as 0; that length is computed first for all pairs
of unit and landmark by bit-parallel dynamic programming, and the kernel for the remaining pairs only.

A text is cut into units: its words in lower case without outer punctuation, runs of single characters joined into
one ("i d i o t"), neighbouring words that together are a landmark ("wor thless"), and words over ``WINDOW``
characters in overlapping windows of that length. Words under ``LENGTH`` characters have no kernel of their own.

Training, on a sample of labelled texts (at most ``TOXIC`` and ``CLEAN`` rows of the two classes within ``samples.SAMPLE_CHARS``, the
sample's only bounds): a unit is evidence if toxic texts hold it significantly more often than clean ones (a likelihood ratio over ``EVIDENCE``),
where occurrences between the same two words count once, so copies of one text prove nothing. Landmarks are chosen by
pivoted Cholesky among the evidence and the clean units that resemble it, until nothing is left to explain or there
are ``LANDMARKS``, the rank of the Nyström map. A squared-hinge machine is trained on the whitened
features: evidence positive, each weighted by its occurrences; all units of clean texts negative. A text's score is a logistic function,
fitted on the sample and weighted back to the classes' shares, of its two highest margins.

Labels come only from rows whose crc32(doc_id as text) modulo 4 is not 2. A null text is an empty one, with the lowest
margins. Without labels of both classes every score is 0. Repeated rows count each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import samples
from tidelog.llm.common import crc_mod, id_text, score_column

LENGTH, DECAY, POWER, NEED = 4, 0.6, 2, 0.7
TOXIC, CLEAN, LANDMARKS, EVIDENCE = 1500, 3500, 256, 15.0
WINDOW, STRIDE = 24, 12
THRESHOLD, NONE = 0.3, -1.5
OUTER = ".,;:!?|\"'()[]{}<>«»¿¡-_*~"
#: Units whose margins a worker remembers before it starts anew; it changes no result.
MEMO = 200_000

SPACED = re.compile(rf"(?<!\w)\w(?:[^\w\s]?\s\w){{{LENGTH - 1},}}(?!\w)")
APART = re.compile(r"\W+")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, in order, and behind them its runs of single characters, joined."""
    low = text.lower()
    return low.split() + [APART.sub("", run) for run in SPACED.findall(low)]


def units_of_word(word: str) -> list[str]:
    """A word's units that can have a kernel: those of ``LENGTH`` characters or more."""
    word = word.strip(OUTER)
    if len(word) <= WINDOW:
        return [word] if len(word) >= LENGTH else []
    return [word[i : i + WINDOW] for i in range(0, len(word) - STRIDE, STRIDE)]


def units_of(text: str) -> set[str]:
    return {u for w in set(words_of(text)) for u in units_of_word(w)}


def _codes(words: list[str], width: int) -> np.ndarray:
    """Characters as small numbers, padded by 0: Latin-1 as it is, others folded onto 128 to 255."""
    chars = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
    return np.where(chars < 256, chars, 128 + chars % 128).astype(np.uint8)


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernels of the rows of ``a`` with the rows of ``b``, pair by pair."""
    out = np.empty(len(a), np.float32)
    n, m = a.shape[1], b.shape[1]
    reach = lambda k: np.tril(DECAY ** (np.subtract.outer(np.arange(k), np.arange(k)) - 1.0), -1).astype(np.float32)
    left, right = reach(n), np.ascontiguousarray(reach(m).T)
    for at in range(0, len(a), 2048):
        x, y = a[at : at + 2048].T, b[at : at + 2048]
        same = ((x[:, :, None] == y[None]) & (x[:, :, None] > 0)).astype(np.float32) * np.float32(DECAY**2)
        now = same
        for _ in range(LENGTH - 1):
            now = (left @ now.reshape(n, -1)).reshape(-1, m) @ right
            now = now.reshape(same.shape) * same
        out[at : at + 2048] = now.sum(axis=(0, 2))
    return out


class Kernels:
    """Normalised kernels with a fixed list of landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.sizes = np.array([len(w) for w in landmarks], np.int64)
        self.needs = np.maximum(LENGTH, np.ceil(NEED * self.sizes - 1e-9)).astype(np.int64)
        self.codes = _codes(landmarks, WINDOW)
        self.own = np.sqrt(_kernel(self.codes, self.codes))
        self.packs = self._packs()

    def _packs(self) -> list[tuple[np.ndarray, np.uint64, list[tuple[int, np.uint64]]]]:
        """Masks of as many landmarks as fit into 64 bits, a lane each with a bit more that stops carries."""
        out: list = []
        at, masks, lanes, parts = 0, np.zeros(256, np.uint64), 0, []
        for k, word in enumerate(self.codes):
            size = int(self.sizes[k])
            if at + size + 1 > 64:
                out.append((masks, np.uint64(lanes), parts))
                at, masks, lanes, parts = 0, np.zeros(256, np.uint64), 0, []
            for i in range(size):
                masks[word[i]] |= np.uint64(1 << at + i)
            lane = ((1 << size) - 1) << at
            lanes |= lane
            parts.append((k, np.uint64(lane)))
            at += size + 1
        return out + ([(masks, np.uint64(lanes), parts)] if parts else [])

    def _near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word, landmark) whose longest common subsequence is as long as the landmark needs."""
        places, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        columns = np.ascontiguousarray(words.T)
        for masks, lane, parts in self.packs:
            v = np.full(len(words), lane, np.uint64)
            for column in columns:
                met = masks[column]
                both = v & met
                v = ((v + both) | (v & ~met)) & lane
            v = ~v
            for k, part in parts:
                found = np.flatnonzero(np.bitwise_count(v & part) >= self.needs[k])
                places.append(found)
                marks.append(np.full(len(found), k, np.int64))
        return np.concatenate(places), np.concatenate(marks)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of words with a kernel with any landmark, and their kernels with all landmarks."""
        sizes = np.array([len(w) for w in words], np.int64)
        places, rows = [np.zeros(0, np.int64)], [np.zeros((0, len(self.landmarks)), np.float32)]
        for low, width in ((LENGTH - 1, 6), (6, 9), (9, 13), (13, 18), (18, WINDOW)):
            own = np.flatnonzero((sizes > low) & (sizes <= width))
            if not len(own):
                continue
            codes = _codes([words[i] for i in own], width)
            word, mark = self._near(codes)
            kept, word = np.unique(word, return_inverse=True)
            if not len(kept):
                continue
            codes, wide = codes[kept], int(self.sizes[mark].max())
            table = np.zeros((len(codes), len(self.landmarks)), np.float32)
            table[word, mark] = (_kernel(codes[word], self.codes[mark, :wide]) / (np.sqrt(_kernel(codes, codes))[word] * self.own[mark])) ** POWER
            places.append(own[kept])
            rows.append(table)
        return np.concatenate(places), np.concatenate(rows)


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Weights, the offset last, by Newton steps on the active rows."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w)) * ridge
    keep[-1, -1] = 1e-6
    loss = lambda v: float(v @ keep @ v + weight @ np.maximum(0, 1 - y * (x @ v)) ** 2)
    for _ in range(40):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        step, now, part = np.linalg.solve(a.T @ x[on] + keep, a.T @ y[on]) - w, loss(w), 1.0
        while part > 1e-4 and loss(w + part * step) > now:
            part /= 2
        if part <= 1e-4 or np.abs(step).max() < 1e-7:
            break
        w = w + part * step
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(100):  # steps of bounded length, for classes that a line parts
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w -= step * min(1.0, 1 / max(1e-9, float(np.abs(step).max())))
    return w


def _pivots(square: np.ndarray, most: int, least: float = 0.02) -> list[int]:
    """Places of landmarks by pivoted Cholesky: each time the one that the ones before explain least."""
    rest, rows, out = square.diagonal().astype(np.float64).copy(), np.zeros((0, len(square))), []
    while len(out) < min(most, len(square)):
        k = int(np.argmax(rest))
        if rest[k] < least:
            break
        row = (square[k] - (rows[:, k] @ rows if len(rows) else 0)) / np.sqrt(rest[k])
        rows, rest = np.vstack([rows, row]), np.maximum(rest - row**2, 0)
        rest[k] = 0
        out.append(k)
    return out


class Evidence:
    """Units of a sample with their occurrences in toxic and clean texts: texts, but no more than pairs of words around them."""

    def __init__(self, texts: list[str], labels: list[int]):
        names: dict[str, int] = {}
        self.units: list[str] = []
        units_by_word: dict[int, list[int]] = {}
        place: dict[str, int] = {}
        pairs: tuple[list, list] = ([], [])
        held: tuple[list, list] = ([], [])
        for text, y in zip(texts, labels):
            words = words_of(text)
            ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
            fresh = [(w, i) for w, i in zip(words, ids.tolist()) if i not in units_by_word]
            for w, i in fresh:
                if i not in units_by_word:
                    units_by_word[i] = [place.setdefault(u, len(place)) for u in units_of_word(w)]
            around = (np.concatenate([[-1], ids[:-1]]) + 1) * 0x9E3779B1 + (np.concatenate([ids[1:], [-1]]) + 1) * 0x85EBCA77
            pairs[y].append(np.unique(ids << 32 | around & 0x7FFFFFFF))
            held[y].append(np.unique(ids))
        self.units = [*place]
        words_n = len(names)
        both = lambda lists: np.concatenate(lists) if lists else np.zeros(0, np.int64)
        contexts = [np.bincount(np.unique(both(p)) >> 32, minlength=words_n) for p in pairs]
        texts_n = [np.bincount(both(h), minlength=words_n) for h in held]
        self.counts = np.zeros((2, len(self.units)))
        for y in (0, 1):
            seen = np.minimum(contexts[y], texts_n[y])
            for i, n in enumerate(seen.tolist()):
                for u in units_by_word[i]:
                    self.counts[y, u] += n

    def significant(self) -> np.ndarray:
        """Places of units that toxic texts hold more often than chance explains."""
        clean, toxic = self.counts
        total = clean + toxic
        share = toxic.sum() / max(1.0, total.sum())
        part = np.where(total > 0, toxic / np.maximum(total, 1), 0)
        term = lambda n, p, q: np.where(n > 0, n * np.log(np.maximum(p, 1e-12) / max(q, 1e-12)), 0)
        ratio = 2 * (term(toxic, part, share) + term(clean, 1 - part, 1 - share))
        return np.flatnonzero((part > max(0.5, share)) & (ratio > EVIDENCE))


def _automaton(words: frozenset[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word in words:
        out.add_word(word, len(word))
    out.make_automaton()
    return out


class Machine:
    """Landmarks, their weights and the logistic function of a text's margins."""

    def __init__(self, texts: list[str], labels: list[int], prior: float | None = None):
        found = Evidence(texts, labels)
        positive = found.significant().tolist()
        self.marks, self.split = [], None
        self.memo: dict[str, float] = {}
        if positive:
            self._fit(found, positive)
        y = np.array(labels, float)
        share = y.mean()
        prior = share if prior is None else prior
        weight = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
        self.link = _logistic(self.margins(texts), y, weight)
        self.memo = {}

    def _fit(self, found: Evidence, positive: list[int]) -> None:
        insults = [found.units[i] for i in positive]
        clean = [u for i, u in enumerate(found.units) if found.counts[0, i] > 0 and found.counts[0, i] >= found.counts[1, i]]
        place, rows = Kernels(insults).of(clean)
        near = sorted({clean[p] for p, r in zip(place.tolist(), rows) if r.max() >= 0.15})
        pool = insults + near
        at, rows = Kernels(pool).of(pool)
        square = np.zeros((len(pool), len(pool)))
        square[at] = rows
        square = np.maximum(square, square.T)
        np.fill_diagonal(square, 1.0)
        # evidence first: its own pivots, then those of clean units that resemble it
        first = _pivots(square[: len(insults), : len(insults)], LANDMARKS)
        kin = square[len(insults) :][:, first].max(axis=1) if near else np.zeros(0)
        closest = np.argsort(-kin, kind="stable")[: max(0, LANDMARKS - len(first))]
        chosen = first + [len(insults) + int(k) for k in sorted(closest.tolist())]
        self.marks = [pool[k] for k in chosen]
        self.insults = frozenset(pool[k] for k in first)
        self.kernels = Kernels(self.marks)
        own = square[np.ix_(chosen, chosen)]
        value, vector = np.linalg.eigh(own)
        whiten = (vector / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
        _, negatives = self.kernels.of(clean)
        at, positives = self.kernels.of(insults)
        count = found.counts[1][positive][at]
        x = np.vstack([positives @ whiten, negatives @ whiten, np.zeros((1, len(chosen)))])
        y = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives) + 1)])
        size = len(negatives) + 1.0
        weight = np.concatenate([count / count.sum() * 2 * size, np.ones(len(negatives)), [size]])  # the last: the many units without any kernel
        weights = _squared_hinge(x, y, weight)
        self.linear = (whiten @ weights[:-1]).astype(np.float32)
        self.offset = float(weights[-1])
        self.split = _automaton(self.insults)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "split": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.split = _automaton(self.insults) if self.marks else None

    def _joined(self, words: list[str]) -> list[str]:
        """Landmarks that neighbouring words spell together, from the first one's start to the last one's end."""
        stripped = [w.strip(OUTER) for w in words]
        text = "".join(stripped)
        out = []
        bounds = None
        for end, size in self.split.iter(text):
            if bounds is None:
                bounds = np.cumsum([0, *map(len, stripped)])
            a, b = np.searchsorted(bounds, [end + 1 - size, end + 1])
            if bounds[a] == end + 1 - size and bounds[b] == end + 1 and sum(map(bool, stripped[a:b])) > 1:
                out.append(text[end + 1 - size : end + 1])
        return out

    def margins(self, texts: list[str]) -> np.ndarray:
        """The two highest unit margins of each text, at least ``NONE`` and at most its negative."""
        out = np.full((len(texts), 2), NONE)
        if self.split is None:
            return out
        memo = self.memo
        sets: list[list[str]] = []
        for t in texts:
            words = words_of(t)
            sets.append([*dict.fromkeys(words), *self._joined(words)])
        new = [w for w in set().union(*sets) if w not in memo] if sets else []
        owners: dict[str, list[str]] = {}
        for word in new:
            memo[word] = NONE
            for unit in units_of_word(word):
                owners.setdefault(unit, []).append(word)
        units = list(owners)
        place, rows = self.kernels.of(units)
        scores = np.clip(rows @ self.linear + self.offset, NONE, -NONE)
        for i, score in zip(place.tolist(), scores.tolist()):
            for word in owners[units[i]]:
                memo[word] = max(memo[word], score)
        for i, words in enumerate(sets):
            best = sorted((s for w in words if (s := memo[w]) > NONE), reverse=True)[:2]
            out[i, : len(best)] = best
        if len(memo) > MEMO:
            memo.clear()
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts) @ self.link[:-1] + self.link[-1], -50, 50)))


def _trained(prior: float) -> Callable[[list[str], list[int]], Machine | None]:
    return lambda texts, labels: Machine(texts, labels, prior) if len(set(labels)) == 2 else None


def scorer(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> Callable[[Column], Column]:
    """The function from a text to its score, by the machine trained on labelled texts of ``docs``."""
    prior = labels.select(F.avg((F.col(label_col) > 0).cast("int")).alias("p")).first().p
    sample = samples.labelled(docs, labels, label_col, 4, 2, {1: TOXIC, 0: CLEAN})
    machine = docs.sparkSession.sparkContext.broadcast(samples.fitted(sample, _trained(min(0.9, max(0.001, prior or 0.0)))))
    return score_column(lambda texts: np.zeros(len(texts)) if machine.value is None else machine.value.scores(texts), as_bytes=False, limit=2 << 20)


def toxicity_table(df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: held_out, score (likelihood of label 1) and predicted."""
    docs = id_text(df, id_col, text_col)
    scored = docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), scorer(docs, labels, label_col)("text").alias("score"))
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
