"""Mixing sources to target weights by iterative proportional fitting.

Tokens (ids of a byte-level BPE vocabulary) are summed over cells of source, language and topic. The cells' expected tokens are raked in turn
to the three target marginals, shares of a budget, and never above what a cell holds; where no cell is full that is plain
iterative proportional fitting. Documents are sampled by the probability of their cell, its raked over its own tokens. A category
that holds less than its target gives all it has, and the rest falls on the others in proportion;
``reached`` reports every category's target and its share of the sample. A document's draw is a hash of its id, text and the seed, so it is reproducible.

Topics are clusters of documents by their terms: words are hashed to ``TERMS`` buckets, counts are damped and weighted by inverse document
frequency, and a text belongs to the nearest of ``TOPIC_COUNT`` centres by cosine. Frequencies and centres come from every distinct text of the
table, whole: terms are counted once and saved, and each step of spherical k-means (a centre begun at the text that is least like those before, then at
most ``STEPS`` rounds) reads these counts in one job that gives the driver sums only, or ``FAR`` texts of a task that are least like the centres so far, from
which later centres begin without reading again where no other text can be less like them. Vectors are whole numbers whose sums and products are
exact, so the centres depend neither on partitions nor on the order of rows.

Targets are mappings from category to share; categories that a mapping doesn't name are raked together
as ``other``, so there are at most as many cells as the product of the mappings' sizes, however many
sources there are; only the cells' sums come to the driver. A category without documents has its share
given to the others in proportion.

A null source or language is the category ``other``; a null or empty text has no tokens and topic
``t0``, and is sampled with its cell's probability. Repeated rows draw alike. An empty table gives an empty result. Columns of any name stay
in ``row``, so none clashes.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.bpe import ranks_of
from tidelog.llm.common import release, steps
from tidelog.llm.saved import Scratch
from tidelog.llm.shingles import word_hashes

OTHER = "other"
SEED, ROUNDS, TOLERANCE = 23, 500, 1e-10
TERMS, TOPIC_COUNT, STEPS = 1024, 8, 30
#: The largest count that an entry of 16 bits holds beside its term, and the length of a vector: sums of 2 ** 33 texts are exact.
SHORT, UNIT = 63, 1 << 20
BLOCK = 64  # rows of a step
FAR = 16
#: A library without special tokens looks for one at every character.
NO_TOKEN = "\0\1no token\1\0"
#: A pattern none of whose matches holds a space after another character, if not white space alone. So a text may be cut before each space between two
#: characters that aren't white space, and equal words have equal tokens.
BY_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose words are looked at together.
WORD_BYTES = 8 << 20
#: Target shares of the query: the largest source is to shrink to a fifth. Topics have no names that a target could be set for, so by
#: default their shares of all tokens are raised to ``TEMPER`` and made to sum to 1: frequent ones shrink, rare ones grow.
SOURCES = {"src0": 0.2} | {f"src{i}": 0.04 for i in range(1, 20)}
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
TEMPER = 0.7
#: Expected share of all tokens to keep.
KEEP = 0.5
FEATURES = "struct<tokens: bigint, terms: binary, counts: binary>"


_COUNTERS: dict[tuple, TokenCounter] = {}


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose rows hold ``sizes`` values each."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * values.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a binary column, in order, and each row's number of them."""
    data = column.buffers()[2]
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None and data.size else np.zeros(0, kind)
    return values, np.diff(ends) // np.dtype(kind).itemsize


def term_counts(texts: list[str]) -> tuple[pa.Array, pa.Array]:
    """Each text's terms with their counts, 16 bits a term: its bucket and, times ``TERMS``, its count. A count over
    ``SHORT`` is 0 there and stands in the second column, 32 bits each."""
    hashes, begins = word_hashes([t.encode() for t in texts])
    own = np.repeat(np.arange(len(texts)), np.diff(begins))
    counts = np.bincount(own * TERMS + (hashes >> np.uint64(54)).astype(np.int64), minlength=len(texts) * TERMS)
    at = np.flatnonzero(counts)
    counts, rows, long = counts[at], at // TERMS, counts[at] > SHORT
    entries = (at % TERMS + TERMS * np.where(long, 0, counts)).astype("<u2")
    return packed(entries, np.bincount(rows, minlength=len(texts))), packed(counts[long].astype("<u4"), np.bincount(rows[long], minlength=len(texts)))


def damped(weights: np.ndarray) -> np.ndarray:
    """What each entry of 16 bits counts; one without its count, the weight of its term."""
    return np.vstack([weights, np.outer(np.log1p(np.arange(1, SHORT + 1)), weights)]).ravel()


def term_vectors(terms: pa.Array, counts: pa.Array, worth: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Unit vectors of damped, weighted counts in whole parts of ``UNIT``, a row a text, in ``room``; of texts without words all 0."""
    entries, sizes = unpacked(terms, "<u2")
    values = worth.take(entries)
    long = np.flatnonzero(entries < TERMS)
    if len(long):
        values[long] *= np.log1p(unpacked(counts, "<u4")[0])
    at = np.repeat(np.arange(len(sizes)) * TERMS, sizes)
    at += entries & (TERMS - 1)  # a power of two
    norms = np.sqrt(np.bincount(at >> TERMS.bit_length() - 1, values * values, len(sizes)))
    out = room[: len(sizes)]
    out.fill(0)
    values *= np.repeat(UNIT / np.maximum(norms, 1e-9), sizes)
    out.reshape(-1)[at] = np.rint(values, out=values)
    return out


def blocks(*columns: pa.Array) -> Iterator[list[pa.Array]]:
    for at in range(0, len(columns[0]), BLOCK):
        yield [c.slice(at, BLOCK) for c in columns]


def of_tasks(vectors: DataFrame, work: Callable[[Iterator[list[pa.Array]]], object]) -> list:
    """What ``work`` makes of the rows of each task, a task a core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pickle.dumps(work(b for batch in batches for b in blocks(*batch.columns)))
        release()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["part"])

    tasks = vectors.coalesce(vectors.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "part binary")
    return [pickle.loads(bytes(r.part)) for r in tasks.collect()]  # a row a task, of the model's size


def term_weights(vectors: DataFrame) -> np.ndarray:
    """The terms' inverse document frequencies over all rows."""

    def work(rows: Iterator[list[pa.Array]]) -> tuple[int, np.ndarray]:
        n, have = 0, np.zeros(TERMS, np.int64)
        for _, terms, _ in rows:
            n += len(terms)
            have += np.bincount(unpacked(terms, "<u2")[0] % TERMS, minlength=TERMS)
        return n, have

    parts = of_tasks(vectors, work)
    return np.log((sum(n for n, _ in parts) + 1) / (sum((have for _, have in parts), np.zeros(TERMS)) + 1)) + 0.1


def worded(terms: pa.Array) -> np.ndarray:
    """1 for each text with words, 0 for others."""
    return np.sign(pc.binary_length(terms).to_numpy(zero_copy_only=False)).astype(float)


def least_like(vectors: DataFrame, worth: np.ndarray, centres: np.ndarray) -> tuple[list[tuple], tuple]:
    """The (likeness, hash, vector) of texts with words that are least like any centre, of equal ones those of least hash, at most ``FAR`` of a task;
    and a (likeness, hash) that all other texts have at least."""

    def work(rows: Iterator[list[pa.Array]]) -> list[tuple]:
        best, room = [], np.zeros((BLOCK, TERMS))
        for hashes, terms, counts in rows:
            x = term_vectors(terms, counts, worth, room)
            like, own = (x @ centres.T).max(axis=1, initial=0), hashes.to_numpy()
            able = worded(terms) > 0
            if len(best) == FAR:
                able &= (like < best[-1][0]) | (like == best[-1][0]) & (own <= best[-1][1])
            best += [(float(like[i]), int(own[i]), x[i].astype("<i4").tobytes()) for i in np.flatnonzero(able).tolist()]
            best = sorted(best)[:FAR]
        return best

    parts = of_tasks(vectors, work)
    return [t for p in parts for t in p], min((p[-1][:2] for p in parts if len(p) == FAR), default=(np.inf, 0))


def first_centres(vectors: DataFrame, worth: np.ndarray) -> np.ndarray | None:
    """``TOPIC_COUNT`` vectors, each of the text that is least like those before, of several the one of least hash; None if no text has words."""
    centres, found, limit = np.zeros((0, TERMS)), [], (-1.0, 0)
    while len(centres) < TOPIC_COUNT:
        if not found or min(found) >= limit:  # likeness only grows
            found, limit = least_like(vectors, worth, centres)
            if not found:
                return None
        new = np.frombuffer(min(found)[2], "<i4").astype(float)
        centres = np.vstack([centres, new])
        found = [(max(like, float(np.frombuffer(x, "<i4") @ new)), own, x) for like, own, x in found]
    return centres


def nearest_sums(vectors: DataFrame, worth: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centre the sum and the number of all vectors that it is nearest to."""

    def work(rows: Iterator[list[pa.Array]]) -> tuple[np.ndarray, np.ndarray]:
        sums, sizes, room = np.zeros(centres.shape), np.zeros(len(centres)), np.zeros((BLOCK, TERMS))
        for _, terms, counts in rows:
            x = term_vectors(terms, counts, worth, room)
            near = np.eye(len(centres))[np.argmax(x @ centres.T, axis=1)]
            sums += near.T @ x
            sizes += worded(terms) @ near
        return sums, sizes

    parts = of_tasks(vectors, work)
    return sum(p[0] for p in parts), sum(p[1] for p in parts)


def fit_topics(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Term weights and centres, in order of their size, from all rows (hash, terms, counts); None if no text has words."""
    weights = term_weights(vectors)
    worth = damped(weights)
    centres = first_centres(vectors, worth)
    if centres is None:
        return None
    for _ in range(STEPS):
        sums, sizes = nearest_sums(vectors, worth, centres)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        new = np.where(norms > 0, np.rint(sums * (UNIT / np.maximum(norms, 1e-9))), centres)
        done = np.allclose(new / UNIT, centres / UNIT, atol=1e-6)
        centres = new
        if done:
            break
    return weights, centres[np.argsort(-sizes, kind="stable")]


def topic_of(terms: Column, counts: Column, model: tuple[np.ndarray, np.ndarray] | None) -> Column:
    """The nearest centre's name; ``t0`` for texts without words."""
    if model is None:
        return F.lit("t0")

    @F.arrow_udf("string")
    def named(terms: pa.Array, counts: pa.Array) -> pa.Array:
        worth, room = damped(model[0]), np.zeros((BLOCK, TERMS))
        near = [np.argmax(term_vectors(*b, worth, room) @ model[1].T, axis=1) for b in blocks(terms, counts)]
        release()
        return pa.array([f"t{k}" for ks in near for k in ks.tolist()], pa.string())

    return named(terms, counts)


def features(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> Column:
    """A column of each text's number of tokens and its terms."""
    ranks = ranks_of(vocabulary)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    held = df.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf(FEATURES)
    def counted(column: pa.Array) -> pa.Array:
        if (name, pattern) not in _COUNTERS:  # a worker's own, made once
            _COUNTERS.clear()
            _COUNTERS[name, pattern] = TokenCounter(held.value, pattern)
        tokens, parts = [np.zeros(0, np.int64)], [term_counts([])]
        batch = pa.RecordBatch.from_arrays([pc.fill_null(column, "")], names=["text"])
        for part in steps(iter([batch]), "text", WORD_BYTES):
            tokens.append(_COUNTERS[name, pattern].counts(part.column(0)))
            parts += [term_counts(few.to_pylist()) for (few,) in blocks(part.column(0))]
        release()
        return pa.StructArray.from_arrays([pa.array(np.concatenate(tokens)), *(pa.concat_arrays(p) for p in zip(*parts))], names=["tokens", "terms", "counts"])

    return counted(F.col(f"`{text_col}`").cast("string"))


class TokenCounter:
    """Numbers of tokens of texts. Where the pattern allows, each distinct word of many texts is encoded once; texts that have white space beside a space are encoded whole."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        top = max(ranks.values(), default=-1) + 1
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={NO_TOKEN: top})
        self.by_words, self.lengths = pattern == BY_WORDS, np.zeros(top + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, disallowed_special=())  # no list of ids

    def of_words(self, words: pa.Array) -> np.ndarray:
        """The number of tokens of each distinct word behind a space; -1 for an empty one and one with white space at an end."""
        good = pc.and_(pc.equal(pc.utf8_trim_whitespace(words), words), pc.greater(pc.binary_length(words), 0)).to_numpy(zero_copy_only=False)
        out, kept = np.full(len(words), -1, np.int64), words.filter(pa.array(good))
        if len(kept):
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), " ")[0].as_py()
            ends = np.cumsum(pc.binary_length(kept).to_numpy().astype(np.int64) + 1)
            out[good] = np.diff(np.searchsorted(np.cumsum(self.lengths[self.ids(" " + whole)]), ends, side="right"), prepend=0)
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        """``texts`` has no nulls."""
        if not self.by_words:
            return np.array([len(self.ids(t)) for t in texts.to_pylist()], np.int64)
        lists = pc.split_pattern(texts, " ")
        begins = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(begins[0], begins[-1] - begins[0])
        begins -= begins[0]
        coded = words.dictionary_encode()
        each = self.of_words(coded.dictionary)[coded.indices.to_numpy()]
        first, last = begins[:-1], begins[1:] - 1
        each[first] = each[last] = 0  # the ends of a text have other neighbours
        sums, bad = (np.diff(np.concatenate([[0], np.cumsum(x)])[begins]) for x in (each, each < 0))
        out = []
        for text, n, a, b, size, wrong in zip(texts, sums.tolist(), words.take(pa.array(first)).to_pylist(), words.take(pa.array(last)).to_pylist(), np.diff(begins).tolist(), bad.tolist()):
            if size < 3 or wrong or a[-1:].isspace() or b[:1].isspace():
                out.append(len(self.ids(text.as_py())))
            else:
                out.append(len(self.ids(a)) + n + len(self.ids(" " + b)))
        return np.array(out, np.int64)


def tempered(tokens: dict[str, float]) -> dict[str, float]:
    """The default targets of topics, from their tokens."""
    raised = {f"t{i}": float(tokens.get(f"t{i}") or 0) ** TEMPER if tokens.get(f"t{i}") else 0.0 for i in range(TOPIC_COUNT)}
    return {k: x / max(1e-300, sum(raised.values())) for k, x in raised.items()}


def class_of(column: Column, targets: dict[str, float]) -> Column:
    return F.when(column.isin(list(targets)), column).otherwise(OTHER)


def raked(sums: np.ndarray, targets: list[np.ndarray], budget: float) -> np.ndarray:
    """Expected tokens of each cell: marginals are the targets' shares of the budget, as far as cells hold them."""
    now = sums.astype(float) * (min(1.0, budget / sums.sum()) if sums.sum() else 0.0)
    goals = []
    for axis, goal in enumerate(targets):
        there = sums.sum(axis=tuple(a for a in range(sums.ndim) if a != axis)) > 0
        goal = np.where(there, goal, 0.0)
        goals.append(budget * (goal / goal.sum() if goal.sum() else there / max(1, there.sum())))
    for _ in range(ROUNDS):
        before = now
        for axis, goal in enumerate(goals):
            have = now.sum(axis=tuple(a for a in range(now.ndim) if a != axis))
            factor = np.where(have > 0, goal / np.where(have > 0, have, 1), 0)
            now = np.minimum(now * factor.reshape([-1 if a == axis else 1 for a in range(now.ndim)]), sums)
        if np.abs(now - before).max(initial=0) <= TOLERANCE * max(1.0, budget):
            break
    return now


def mixed_table(df: DataFrame, vocabulary: str, pattern: str, sources: dict = SOURCES, languages: dict = LANGUAGES, topics: dict | None = None, keep: float = KEEP, seed: int = SEED, columns: list[str] | None = None) -> DataFrame:
    """Two structs: ``row``, all columns of ``df`` or those named, source and lang among them, and ``mix``: source, lang and topic class, tokens,
    weight (of a token of its cell, 1 on average), probability and kept."""
    scratch = Scratch(df.sparkSession, "mixing")
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(17))
    draw = F.shiftrightunsigned(F.xxhash64(*(F.col(c) for c in ("doc_id", "text") if c in df.columns), F.lit(seed)), 11) / F.lit(float(1 << 53))
    row = F.struct(*(F.col(f"`{c}`") for c in columns or df.columns))
    counted = scratch.save(df.select(row.alias("row"), features(df, vocabulary, pattern).alias("f"), text.alias("hash"), draw.alias("draw")))
    vectors = scratch.save(counted.select("hash", "f.terms", "f.counts").distinct())
    model = fit_topics(vectors)
    scratch.drop(vectors)
    held = counted.select("row", "draw", F.struct("f.tokens", topic_of(F.col("f.terms"), F.col("f.counts"), model).alias("topic")).alias("f"))
    own_topics = dict.fromkeys(f"t{i}" for i in range(TOPIC_COUNT)) if topics is None else topics
    cell = [class_of(F.col("row.source"), sources), class_of(F.col("row.lang"), languages), class_of(F.col("f.topic"), own_topics)]
    rows = held.groupBy(cell[0].alias("s"), cell[1].alias("l"), cell[2].alias("t")).agg(F.sum("f.tokens").alias("n")).collect()  # at most a row a cell
    if topics is None:
        own_topics = tempered({t: sum(r.n for r in rows if r.t == t) for t in own_topics})
    targets = [sources, languages, own_topics]
    names = [[*t, OTHER] for t in targets]
    goals = [np.array([*t.values(), max(0.0, 1 - sum(t.values()))], float) for t in targets]
    sums = np.zeros([len(n) for n in names])
    for r in rows:
        sums[names[0].index(r.s), names[1].index(r.l), names[2].index(r.t)] = r.n
    budget = keep * sums.sum()
    expected = raked(sums, goals, budget)
    chance = np.where(sums > 0, expected / np.where(sums > 0, sums, 1), 0)
    weights = chance / keep if keep else chance
    cells = [(*(names[a][i] for a, i in enumerate(at)), float(weights[at]), float(chance[at])) for at in product(*(range(len(n)) for n in names)) if sums[at] > 0]
    table = df.sparkSession.createDataFrame(cells, "s string, l string, t string, weight double, probability double")
    wide = held.select("row", F.struct(cell[0].alias("source"), cell[1].alias("lang"), cell[2].alias("topic"), F.col("f.tokens").alias("tokens")).alias("c"), "draw")
    joined = wide.join(F.broadcast(table), (F.col("c.source") == F.col("s")) & (F.col("c.lang") == F.col("l")) & (F.col("c.topic") == F.col("t")), "left")
    chance_of = F.coalesce("probability", F.lit(1.0))  # a cell without any token
    return joined.select("row", F.struct("c.*", F.coalesce("weight", F.lit(1.0)).alias("weight"), chance_of.alias("probability"), (F.col("draw") < chance_of).alias("kept")).alias("mix"))


def reached(mixed: DataFrame, sources: dict = SOURCES, languages: dict = LANGUAGES, topics: dict | None = None) -> DataFrame:
    """(kind, category, target, share): each category's share of the sampled tokens beside its target."""
    if topics is None:
        topics = tempered({r.t: r.n for r in mixed.groupBy(F.col("mix.topic").alias("t")).agg(F.sum("mix.tokens").alias("n")).collect()})  # a row a topic
    kinds = {"source": sources, "lang": languages, "topic": topics}
    long = mixed.filter("mix.kept").select("mix.tokens", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"mix.{k}").alias("category")) for k in kinds))).alias("c"))
    sums = long.groupBy("c.kind", "c.category").agg(F.sum("tokens").alias("tokens"))
    goals = mixed.sparkSession.createDataFrame([(k, c, float(x)) for k, t in kinds.items() for c, x in [*t.items(), (OTHER, max(0.0, 1 - sum(t.values())))]], "kind string, category string, target double")
    both = goals.join(sums, ["kind", "category"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return both.select("kind", "category", "target", (F.col("tokens") / F.greatest(F.lit(1), F.sum("tokens").over(Window.partitionBy("kind")))).alias("share"))
