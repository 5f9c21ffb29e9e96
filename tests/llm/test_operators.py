"""Small tests of the corpus operators: brute force, exact round trips, and odd inputs."""

import hashlib
import itertools
import math
import pickle
import random
import re
import sys
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidelog.llm import bpe, chat, fingerprint, htmltext, jaccard, mixing, quality, saved, skew, telephony, toxicity, urls
from tidelog.llm.saved import Scratch, trim_native
from tidelog.llm.shingles import shingle_sets, word_hashes

TOKENS = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, `key` string"
WORDS = "the of and loser plain river stone cloud bird table green walk little house light".split()


def texts(n, seed=1):
    r = random.Random(seed)
    out = [" ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(r.randint(1, 60))) for _ in range(n)]
    return out + [" ".join(out[0].split()[:-1] + ["end"]), out[0], out[1].upper()]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", None, 1, "x") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "  \n "), (4, "word"), (5, "two words"), (5, "two words"), (None, "no id here at all"), (7, "é" * 3000 + " 😀")]


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.ranks_of(P.path("byte_bpe_50k.tiktoken"))
    return bpe.Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(codec):
    own, other = codec
    for t in [*texts(30), "", "  \n\n\t x", "don't 1234567 ééé 😀😀 <|endoftext|>", "a" * 5000, "\0\1 ¿qué?", "日本語テキスト"]:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert [h.find(k) for k in keys] == list(range(3000)) and h.find(b"stranger") == -1
    assert sorted(h.slot_list) == list(range(3000))  # as many slots as keys
    assert bpe.PerfectHash([]).find(b"x") == -1


def test_odd_inputs(spark):
    df, none = table(spark, ODD), table(spark, [])
    for f in (lambda d: bpe.encoded_table(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), telephony.media_table, fingerprint.fingerprint_table, jaccard.joined_table):
        assert f(df).count() == len(ODD) and f(none).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity_table(df, labels).collect()} == {0.0}
    assert {r.score for r in quality.quality_table(df, labels.limit(0)).collect()} == {1.0}
    assert quality.quality_table(df, labels).count() == len(ODD)
    for f in (toxicity.toxicity_table, quality.quality_table):
        assert f(none, labels).count() == 0
    mixed = mixing.mixed_table(df, *TOKENS)
    assert mixed.count() == len(ODD) and mixed.select("row.*").columns == df.columns
    assert mixing.mixed_table(none, *TOKENS).count() == 0 and mixing.reached(mixing.mixed_table(none, *TOKENS)).count() == 35


def test_telephony():
    for n in (0, 1, 191, 192, 193, 5000):
        payload = telephony.padded(bytes(i * 7 % 256 for i in range(n)))
        assert len(payload) % 192 == 0 and len(payload) >= max(192, n)
        for law in telephony.NAMES:
            assert telephony.load(telephony.store(payload, law)) == (law, payload)
    assert telephony.LAWS[telephony.MULAW][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.LAWS[telephony.ALAW][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    block = np.frombuffer(telephony.chunks_of(telephony.store(bytes(range(192)), telephony.ADPCM))[b"data"], np.uint8)[None]
    value, index, want = 0, 0, [0]
    for code in (c for b in block[0, 4:].tolist() for c in (b & 15, b >> 4)):  # one sample at a time
        step = int(telephony.STEPS[index])
        move = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            move += part if code & bit else 0
        value = max(-32768, min(32767, value - move if code & 8 else value + move))
        index = max(0, min(88, index + int(telephony.INDEX_MOVES[code])))
        want.append(value)
    assert telephony.adpcm_blocks(block)[0].tolist() == want
    assert telephony.resample(np.array([0, 10], np.int16), 8000, 16000).tolist() == [0, 5, 10, 10]


def test_fingerprints(spark):
    docs = list(enumerate(texts(12)))
    got = {r.doc_id: r for r in fingerprint.fingerprint_table(table(spark, docs)).collect()}
    down = sorted(docs, reverse=True)
    for (i, t), (_, following) in zip(down, down[1:] + down[:1]):
        e = fingerprint.edited(t, following)
        a, b, c = fingerprint.fingerprints([t]), fingerprint.fingerprints([e]), fingerprint.fingerprints([following])
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].fingerprint == a[0] and got[i].edited_fingerprint == b[0]
        assert got[i].near_edited == fingerprint.likeness(a[0], b[0]) and got[i].near_next == fingerprint.likeness(a[0], c[0])
    long = " ".join(texts(60))
    shifted = fingerprint.fingerprints([long, "xyz " + long, " ".join(texts(60, 2))])
    assert fingerprint.likeness(*shifted[:2]) > 0.8 and fingerprint.likeness(shifted[0], shifted[2]) < 0.4


def scalar_parse(names):
    """One level of locally consistent parsing, item by item."""
    word = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & word
        x ^= x >> 29
        x = x * 0xA0761D6478BD642F & word
        return x ^ x >> 32

    items = [mixed((n + (len(list(run)) - 1) * 0x9E3779B97F4A7C15) & word) for n, run in itertools.groupby(names)]
    labels = [x & 0xFFFFFFFF for x in items]
    for _ in range(3):
        tossed = []
        for i, own in enumerate(labels):
            differ = own ^ labels[i - 1] if i else 1
            place = (differ & -differ).bit_length() - 1
            tossed.append(2 * place + (own >> place & 1))
        labels = tossed
    begins = [i for i in range(len(items)) if i == 0 or labels[i] > labels[i - 1] and (i + 1 == len(items) or labels[i + 1] <= labels[i])]
    out = []
    for a, b in zip(begins, begins[1:] + [len(items)]):
        out.append(mixed(sum(x * pow(fingerprint.FACTOR, k, 1 << 64) for k, x in enumerate(items[a:b])) & word))
    return out


def test_fingerprints_by_scalar_parsing():
    r = random.Random(12)
    for t in ["", "a", "ab", "aaaaaaa", "abab" * 9, *texts(6), "".join(r.choice("xyz é😀") for _ in range(700))]:
        level, parts = 0, {}
        names = [ord(c) for c in t]
        while level < fingerprint.LEAST or len(names) >= fingerprint.ENOUGH:
            names, level = scalar_parse(names), level + 1
            if level == fingerprint.LEAST or level > fingerprint.LEAST and len(names) >= fingerprint.ENOUGH:
                parts[level] = sorted({n >> 32 for n in names})[: fingerprint.SKETCH]
        want = "|".join(f"{k}:" + "".join(f"{n:08x}" for n in v) for k, v in sorted(parts.items(), reverse=True))
        assert fingerprint.fingerprints([t]) == [want], t


def test_short_fingerprints():
    a, b, c, d, none = fingerprint.fingerprints(["the cat sat on a mat", "a mat sat on the cat", "My dog barked loudly at night in the rain, didn't he now", "Several people walked home early from work this Tuesday", ""])
    assert a != b and 0 < fingerprint.likeness(a, b) < 0.9 and fingerprint.likeness(c, d) < 0.1
    assert fingerprint.likeness(none, none) == 1 and fingerprint.likeness(none, a) == 0
    base = "Several people walked home early from work this Tuesday, and nobody minded the rain at all"
    near = fingerprint.fingerprints([base, base.replace("early", "late")])
    assert fingerprint.likeness(*near) > 0.5


def brute_components(rows, percent=90):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_jaccard(spark, monkeypatch):
    r = random.Random(3)
    base = [f"w{r.randint(0, 500)}" for _ in range(120)]
    rows = list(enumerate(texts(25)))
    for i in range(60):  # near copies around and below the threshold
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"v{r.randint(0, 99)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one"), (303, "one"), (304, "one two"), (305, "ONE two")]
    want = brute_components(rows)
    for cell, count in ((512, False), (8, False), (8, True)):  # small cells are dealt into parts and bands
        monkeypatch.setattr(jaccard, "CELL", cell)
        got = jaccard.joined_table(table(spark, rows), count_links=count).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w := (t or "").lower().split()) > 2 else {tuple(w)} - {()} for i, t in rows}
    assert {x.doc_id: x.n_links for x in got} == {a: sum(b != a and bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) for b in sets) for a in sets}


def test_components(spark, monkeypatch, tmp_path):
    r = random.Random(5)
    pairs = [(r.randint(-60, 60), r.randint(-60, 60)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(20)] + [(300, 301 + i) for i in range(20)] + [(7, 7), (301, 300)]
    least = {x: x for p in pairs for x in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    spark.createDataFrame(pairs, "u long, v long").repartition(3).write.parquet(f"{tmp_path}/edges")
    edges, tracker = spark.read.parquet(f"{tmp_path}/edges"), spark.sparkContext.statusTracker()
    for most, jobs in ((jaccard.EDGES, 5), (0, 500), (80, 500)):  # one task; rounds; rounds first
        monkeypatch.setattr(jaccard, "EDGES", most)
        spark.sparkContext.setJobGroup(group := f"components {most}", "")
        got = jaccard.components(edges, Scratch(spark, "test")).collect()
        spark.sparkContext.setJobGroup("", "")
        assert sorted(map(tuple, got)) == sorted((x, y) for x, y in least.items() if x != y)
        assert len(tracker.getJobIdsForGroup(group)) <= jobs  # each round takes 15 stages or so, whose tasks the driver remembers
    assert not jaccard.components(edges.limit(0), Scratch(spark, "test")).collect()


def test_driver_gives_native_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(saved, "trim_native", lambda s: given.append(trim_native(s)))
    Scratch(spark, "test").save(spark.range(3))
    version = spark._jvm.java.lang.Runtime.version()
    known = sys.platform == "linux" and (version.feature() > 17 or version.feature() == 17 and version.update() >= 9)
    assert given == [known]


def test_looked_up(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 4)
    rows = spark.createDataFrame([(1, 7)] * 50 + [(2, 7), (3, 8), (None, 9)], "k long, x int")
    lookup = spark.createDataFrame([(1, 50, "a"), (2, 1, "b"), (5, 1, "e")], "k long, n long, v string")
    got = skew.looked_up(rows, lookup, "k", "n", ["v"]).groupBy("k", "v").count().collect()
    assert {(r.k, r.v, r["count"]) for r in got} == {(1, "a", 50), (2, "b", 1), (3, None, 1), (None, None, 1)}


def test_count_tree():
    r = np.random.default_rng(5)
    bases = [r.integers(0, 1 << 63, size=int(n)).astype(np.uint64) for n in r.integers(50, 600, 15)]
    sets = [np.unique(np.concatenate([b[r.random(len(b)) < keep], r.integers(0, 1 << 63, size=int(len(b) * (1 - keep))).astype(np.uint64)])) for b in bases for keep in (1, 0.97, 0.9, 0.85, 0.8, 0.5)]
    sizes = np.array([len(s) for s in sets])
    i, j, _ = jaccard.bounded_pairs([jaccard.point_of(s) for s in sets], sizes, 70)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a, b in itertools.combinations(range(90), 2) if jaccard.linked(sets[a], sets[b], 70)}
    assert want and want <= found
    owners = np.arange(90) // 6 * 2 + np.arange(90) % 2  # two components of each base's sets
    i, j, _ = jaccard.bounded_pairs([jaccard.point_of(s) for s in sets], sizes, 70, owners)
    across = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert {(a, b) for a, b in want if owners[a] != owners[b]} <= across <= {(a, b) for a, b in found if owners[a] != owners[b]}
    rows = [(0, k, int(owners[k]), int(sizes[k]), jaccard.point_of(s), 5, [1, 2] if k % 3 else [9]) for k, s in enumerate(sets)]
    nearest = jaccard._nearest_in_cell(rows, 70)
    assert len(nearest) <= 90 and {x for p in nearest for x in p} == {x for p in across for x in p} and {(v, u) for u, v in nearest} <= across
    kept = {(v, u) for u, v in jaccard._pairs_in_cell(rows, 70)}
    assert kept == {(a, b) for a, b in across if not (a % 3 and b % 3)}  # the others meet at the lesser key 1
    assert [len(s) for s in shingle_sets([b"a b c d", b"A B", b"a b", b""])] == [2, 1, 1, 0]


def test_chat(spark):
    rows = [(1, k, role, t) for k, (role, t) in enumerate([("system", "be <s>brief\\1"), ("user", "x" * 900), ("assistant", "[INST]y\\" * 200), ("user", None), ("assistant", ""), ("a\nb", "q</s>\n<s>"), ("assistant", "z" * 3000), ("assistant", "end")])]
    rows += [(2, 0, "assistant", "only"), (None, None, None, None), (3, 1, "user", "same"), (3, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.windows_table(df, budget=300, history=60)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in (1, 2, 3, None):
        own = [((r or ""), (t or "")) for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1].n_windows > 2
    for w in windows.filter("conv_id = 1").first().windows:
        assert w.text.count("<s>") == w.text.count("</s>") and "[INST]" not in w.text and w.text.startswith("<s>system")
    assert chat.read_back(chat.windows_table(df.limit(0))).count() == 0


def brute_ratio(key, counts, order=urls.ORDER, blend=urls.BLEND):
    """The mean logarithm of rejected over accepted probability of a key's characters, by counting."""
    padded, total = "^" * order + key, 0.0
    for at in range(order, len(padded)):
        p = [1 / 256, 1 / 256]
        for k in range(order + 1):
            gram = padded[at - k : at + 1]
            for y in (0, 1):
                p[y] = (counts[y].get(gram, 0) + blend * p[y]) / (counts[y].get(("sum", gram[:-1]), 0) + blend)
        total += math.log(p[1] / p[0])
    return total / len(key)


def counted(names, order=urls.ORDER):
    out = {}
    for name, n in names:
        padded = "^" * order + name
        for at in range(order, len(padded)):
            for k in range(order + 1):
                for g in (padded[at - k : at + 1], ("sum", padded[at - k : at])):
                    out[g] = out.get(g, 0) + n
    return out


def test_urls(spark):
    rows = [(i, f"https://h{i % 9}.example.com/fr/{i}") for i in range(60)] + [(100 + i, f"http://m.royalcasino-{'abcd'[i % 4]}.example.org/en/{i}") for i in range(30)]
    rows += [(200, None), (201, "nothing"), (202, "HTTP://A.Example.COM/en/7x?q#f"), (203, "x://org/es/1"), (204, "x://example.net/de/80"), (205, "x://sub.example.net/de/9"), (206, "x://notcom/en/"), (207, "x://org/es/1"), (207, "x://org/es/1"), (208, "x://long.org/" + "ab/" * 5000)]
    found = urls.judged_table(spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit(2))).collect()
    got = {r.page_id: r for r in found}
    assert len(found) == len(rows)
    assert (got[200].host, got[200].path, got[200].rule, got[200].verdict) == ("", "", None, "allow") == (got[201].host, got[201].path, got[201].rule, got[201].verdict)
    assert (got[202].host, got[202].path, got[202].rule, got[202].verdict) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert [got[i].rule for i in (203, 204, 205, 206, 207)] == ["org/es/", "example.net/de/8", "net/de/", None, "org/es/"]
    assert all(got[100 + i].verdict == "block" for i in range(30)) and all(got[i].verdict == "allow" for i in range(60))
    # scores by counting: marks of the first models, then models of the even hosts' keys and the examples
    first = [counted([(n, 1) for n in names]) for names in (urls.ACCEPTED, urls.REJECTED)]
    keys, bad = {}, {}
    for r in found:
        if r.host + r.path:
            key = re.sub("[0-9]+", "0", r.host + r.path)
            keys.setdefault(key, [0, r.host])[0] += 1
            keys[key][1] = min(keys[key][1], r.host)
    for key, (n, host) in keys.items():
        bad[key] = bool(host) and brute_ratio(host, first) > urls.MARGIN
    fit = lambda y: [(k, n) for k, (n, host) in keys.items() if bad[k] == y and zlib.crc32(host.encode()) % 2 == 0]
    final = [counted([(n, 1) for n in names] + fit(bool(y))) for y, names in enumerate((urls.ACCEPTED, urls.REJECTED))]
    for i in (5, 100, 113, 202, 206, 208):
        assert got[i].score == pytest.approx(brute_ratio(re.sub("[0-9]+", "0", got[i].host + got[i].path), final), abs=1e-9)
    assert urls.judged_table(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_html():
    page = """<html><head><title>t</title><script>"<p>no</p>"</script></head><body><nav><a href=x>Menu</a></nav><article><h1>Title of it</h1>
      <p>First &amp;\n  long paragraph with <b>bold</b> words<br>and more<p>Second one that is not closed</article><div class="comments"><p>I like it very much indeed</p></div><footer>&copy; x</footer></body>"""
    assert htmltext.main_text(page) == "Title of it\nFirst & long paragraph with bold words and more\nSecond one that is not closed"
    assert htmltext.main_text("") == "" and htmltext.main_text("<p") == "" and htmltext.main_text("<nav>a</nav>") == ""


SOUP = """<body><div><a href=1>Home</a> <a href=2>News</a></div><div><p>{long}</p><p>Yes.</p><p>{long}</p><p>No!</p><p>{long}</p></div><div>Terms | Privacy</div></body>"""
LONG = "A long paragraph about rivers, bridges and towns goes on for a while here. " * 3
#: Pages marked by hand: (page, text of the article).
MARKED = [
    (SOUP.format(long=LONG), "\n".join([LONG.strip(), "Yes.", LONG.strip(), "No!", LONG.strip()])),
    (f"<header><h1>Site</h1></header><main><h2>Title here</h2><p>{LONG}</p><aside>See also: others</aside><p>Short end.</p></main><section class='comments'><p>{LONG}</p></section>", f"Title here\n{LONG.strip()}\nShort end."),
    (f"<div id=cookie-notice>We use cookies on this site.</div><article><p>{LONG}<form><input><button>Send</button> your name</form><p>Last one.</article><div class='sidebar'><p>{LONG}</p></div>", f"{LONG.strip()}\nLast one."),
    (f"<article><header><h1>Big title</h1></header><ul><li>One thing<li>Other thing</ul><blockquote>{LONG}</blockquote><div class=ad>Buy this now</div><pre>a  b</pre></article>", f"Big title\nOne thing\nOther thing\n{LONG.strip()}\na b"),
]


def test_marked_pages():
    weights = htmltext.fit_weights([p for p, _ in MARKED] * 20)
    hits = kept = true = 0
    for page, want in MARKED:
        for w in (htmltext.STATED, weights):
            got = htmltext.main_text(page, w).split("\n")
            hits, kept, true = hits + len(set(got) & set(want.split("\n"))), kept + len(set(got)), true + len(set(want.split("\n")))
    assert hits / kept >= 0.9 and hits / true >= 0.9
    blocks = htmltext.blocks_of(MARKED[0][0])
    costs = htmltext.costs_of(blocks, weights)
    cut = htmltext.minimum_cut(costs, htmltext.edges_of(blocks))
    assert sum((c > 0) != k for c, k in zip(costs, cut)) >= 2  # the cut changes labels


def test_html_table(spark):
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(MARKED)] + [(7, None, None), (8, "x", ""), (8, "x", ""), (None, "y", MARKED[1][0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = htmltext.extracted_table(df).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id in (7, 8)} == {""} and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id is None] == [r.text for r in got if r.page_id == 1]
    assert htmltext.extracted_table(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<a " * 9000, "".join(f"<p>{'word ' * (1 + i % 7)}</p>" for i in range(9000)), '<a title="x>' * 4000, "<b>" * 9000 + "t" + "</i>" * 9000, "<b>" * 4000 + "<li>a" * 4000, "<button>a" * 4000, "<!--" * 9000, "<" * 9000, "".join(f"<div><p>{'w' * (1 + i * 37 % 120)}</p>x<span>y</span></div>" for i in range(6000))])
def test_hostile_pages(page):
    start = time.time()
    htmltext.main_text(page)
    assert time.time() - start < 3


def test_minimum_cut(monkeypatch):
    r = random.Random(2)
    for run in (512, 0):  # by flow, and contracted first
        monkeypatch.setattr(htmltext, "RUN", run)
        for _ in range(80):
            n = r.randint(1, 8)
            costs = [r.uniform(-3, 3) for _ in range(n)]
            edges = [(i, j, r.uniform(0, 1.5)) for i, j in itertools.combinations(range(n), 2) if r.random() < 0.5]
            cost = lambda keep: sum(max(0, c) if not k else max(0, -c) for c, k in zip(costs, keep)) + sum(w for i, j, w in edges if keep[i] != keep[j])  # noqa: B023, E731
            assert cost(htmltext.minimum_cut(costs, edges)) == pytest.approx(min(cost(k) for k in itertools.product([False, True], repeat=n)))


def test_kernel_brute_force():
    def brute(a, b, length=toxicity.LENGTH, decay=toxicity.DECAY):
        total = 0.0
        for x in itertools.combinations(range(len(a)), length):
            for y in itertools.combinations(range(len(b)), length):
                if all(a[i] == b[j] for i, j in zip(x, y)):
                    total += decay ** (x[-1] - x[0] + 1 + y[-1] - y[0] + 1)
        return total

    for a, b in (("idiot", "idiot"), ("idxiot", "idiot"), ("scum", "sacxum"), ("plain", "words")):
        got = toxicity._kernel(toxicity._codes([a], 8), toxicity._codes([b], 7))[0]
        assert got == pytest.approx(brute(a, b), rel=1e-4)
    assert "idiot" in toxicity.units_of("you i d i o t!") and toxicity.units_of("") == set()


def test_kernels_of_landmarks():
    r = random.Random(5)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(4, 12))) for _ in range(120)]
    marks = words[:30]
    kernels = toxicity.Kernels(marks)
    at, rows = kernels.of(words)

    def common(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    value = lambda a, b: float(toxicity._kernel(toxicity._codes([a], 12), toxicity._codes([b], 12))[0])
    for i, row in zip(at.tolist(), rows):
        for mark, got in zip(marks, row):
            near = common(words[i], mark) >= max(toxicity.LENGTH, math.ceil(toxicity.NEED * len(mark) - 1e-9))
            assert got == pytest.approx((value(words[i], mark) / math.sqrt(value(words[i], words[i]) * value(mark, mark))) ** 2 if near else 0, abs=1e-4)


def test_toxicity_held_out():
    r = random.Random(4)
    plain = ["river", "stone", "cloudy", "tables", "greenish", "walking", "littler", "houses", "lights", "idea"]
    make = lambda bad: ". ".join(" ".join(r.choice(plain) for _ in range(8)) + (" " + r.choice(["stupid", "idiot", "moron"]) + " " + r.choice(plain) if bad else "") for _ in range(5))
    labels = [int(i % 4 == 0) for i in range(400)]
    made = [make(y) for y in labels]
    machine = pickle.loads(pickle.dumps(toxicity.Machine(made[:300], labels[:300])))
    assert np.mean((machine.scores(made[300:]) >= 0.3) == np.array(labels[300:], bool)) > 0.97
    for text in ("a walking i d i o t", "such a stu pid stone", "you moroon", "an id-iot"):  # spaced, split, and with characters put in
        assert machine.scores([text])[0] > machine.scores(["a walking idea"])[0], text


def test_quality_held_out():
    r = random.Random(6)
    good = [" ".join(r.choice(WORDS) for _ in range(60)).capitalize() + "." for _ in range(200)]
    bad = ["!! ".join(r.choice(WORDS).upper() for _ in range(60)) for _ in range(60)]
    rows = [(t.encode(), y) for t, y in [*((t, 1) for t in good), *((t, 0) for t in bad)]]
    r.shuffle(rows)
    voter = quality.Voter([t for t, _ in rows[:180]], [y for _, y in rows[:180]])
    got = voter.scores([t for t, _ in rows[180:]])
    assert np.mean((got >= 0.3) == np.array([y == 1 for _, y in rows[180:]])) > 0.95


def test_raking():
    r = np.random.default_rng(1)
    sums = r.integers(500, 1000, (4, 3, 2)).astype(float)
    goals = [np.array([0.2, 0.2, 0.3, 0.3]), np.array([0.4, 0.3, 0.3]), np.array([0.6, 0.4])]
    budget = 0.4 * sums.sum()
    expected = mixing.raked(sums, goals, budget)
    assert (expected <= sums + 1e-9).all()
    for axis, goal in enumerate(goals):
        assert expected.sum(axis=tuple(a for a in range(3) if a != axis)) == pytest.approx(goal * budget, rel=1e-6)
    sums[0] /= 50  # a source that holds less than its target gives all it has, the rest falls on the others
    expected = mixing.raked(sums, goals, 0.4 * sums.sum())
    rest = (0.4 * sums.sum() - sums[0].sum()) / 0.8
    assert expected[0] == pytest.approx(sums[0]) and expected.sum(axis=(1, 2))[1:] == pytest.approx(goals[0][1:] * rest, rel=1e-3)


def test_mixing_by_brute_force(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 60))), r.choice(["en", "de", None]), r.choice(["src0", "src1", "else"]), 0, 0, "k") for i in range(300)]
    mixed = mixing.mixed_table(spark.createDataFrame(rows, DOCS), *TOKENS, sources={"src0": 0.2, "src1": 0.5}, languages={"en": 0.5, "de": 0.3})
    got = {x.row.doc_id: x.mix for x in mixed.collect()}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(TOKENS[0]), special_tokens={})
    cells = {}
    for i, text, lang, source, *_ in rows:
        m = got[i]
        assert m.tokens == len(library.encode_ordinary(text)) and m.source == (source if source != "else" else "other") and m.lang == (lang or "other")
        assert m.kept or m.probability < 1
        cells.setdefault((m.source, m.lang, m.topic), []).append(m)
    expected = {c: sum(m.tokens for m in ms) * ms[0].probability for c, ms in cells.items()}
    assert all(len({m.probability for m in ms}) == 1 for ms in cells.values())
    total = sum(m.tokens for m in got.values())
    for axis, goal in ((0, {"src0": 0.2, "src1": 0.5, "other": 0.3}), (1, {"en": 0.5, "de": 0.3, "other": 0.2})):
        for c, share in goal.items():
            assert sum(x for k, x in expected.items() if k[axis] == c) == pytest.approx(share * 0.5 * total, rel=0.1)
    assert len({m.topic for m in got.values()}) > 1 and 0.3 < sum(m.tokens for m in got.values() if m.kept) / total < 0.7


THEMES = [[f"{a}{b}{i}" for b in ("ra", "to", "mi", "su", "pe", "lo")] for i, a in enumerate(("b", "c", "d", "f", "g", "h", "k", "z"))]


def themed(spark):
    """(rows, the theme of each id): 3100 texts of seven themes, and 31 of an eighth whose hashes are higher than 3000 of the others'."""
    r = random.Random(5)

    def made(i):
        return " ".join(r.choice(THEMES[i]) for _ in range(r.randint(25, 35)))

    usual = {made(i % 7): i % 7 for i in range(3100)}
    ranked = spark.createDataFrame([(t,) for t in [*usual, *(made(7) for _ in range(3000))]], "text string").select("text", F.xxhash64("text", F.lit(17)).alias("hash")).collect()
    above = sorted(x.hash for x in ranked if x.text in usual)[2999]
    rare = [x.text for x in ranked if x.text not in usual and x.hash > above][:31]
    assert len(usual) == 3100 and len(rare) == 31
    both = [*usual.items(), *((t, 7) for t in rare)]
    return [(i, t) for i, (t, _) in enumerate(both)], [k for _, k in both]


def test_topics_from_all_texts(spark):
    rows, themes = themed(spark)
    df = table(spark, [*rows, *[(9000 + i, rows[0][1]) for i in range(20)], (9999, "")])
    got = {x.row.doc_id: x.mix.topic for x in mixing.mixed_table(df, *TOKENS).collect()}
    pairs = {(k, got[i]) for i, k in enumerate(themes)}
    assert len(pairs) == 8 and (7, "t7") in pairs  # a topic a theme, the least one last
    counted = df.select(F.xxhash64("text").alias("hash"), mixing.features(df, *TOKENS).alias("f")).select("hash", "f.terms", "f.counts").distinct()
    one, other = mixing.fit_topics(counted), mixing.fit_topics(counted.repartition(7, "hash"))
    assert all(np.array_equal(a, b) for a, b in zip(one, other))
    distinct = [*(t for _, t in rows), ""]  # repeated texts count once
    have = np.zeros(mixing.TERMS)
    for t in distinct:
        have[sorted({int(h) >> 54 for h in word_hashes([t.encode()])[0]})] += 1
    assert one[0] == pytest.approx(np.log((len(distinct) + 1) / (have + 1)) + 0.1)


def test_tokens_by_distinct_words():
    ranks = bpe.ranks_of(TOKENS[0])
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counter, r, encoded = mixing.TokenCounter(ranks, P.PATTERN), random.Random(3), []
    whole = counter.ids
    counter.ids = lambda text: encoded.append(len(text)) or whole(text)
    usual = [" ".join(r.choice(WORDS) for _ in range(200)) for _ in range(50)]
    assert counter.counts(pa.array(usual)).tolist() == [len(library.encode_ordinary(t)) for t in usual]
    assert sum(encoded) < sum(map(len, usual)) / 5  # a word of many texts once
    spaces = [*map(chr, [*range(9, 14), 28, 31, 32, 32, 32, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B])]
    odd = ["", " ", "  ", "a b ", " a b", "a  b c", "a b\n c d", "a x\ny b c\n", mixing.NO_TOKEN + " a " + mixing.NO_TOKEN + " b"]
    odd += ["".join(r.choice([*spaces, "a", "'s", "it", "7", "...", "\u00e9", " the", " 's", " b", " c", " d"]) for _ in range(r.randint(0, 12))) for _ in range(5000)]
    assert counter.counts(pa.array(["x", *odd]).slice(1)).tolist() == [len(library.encode_ordinary(t)) for t in odd]
    other = mixing.TokenCounter(ranks, r"\S+ \S+|[\s\S]")  # a pattern whose matches hold spaces
    assert other.counts(pa.array(usual)).tolist() == [len(other.ids(t)) for t in usual]


def test_first_centres_read_few_times(spark, monkeypatch):
    rows, _ = themed(spark)
    df = table(spark, rows)
    counted = df.select(F.xxhash64("text").alias("hash"), mixing.features(df, *TOKENS).alias("f")).select("hash", "f.terms", "f.counts").distinct().cache()
    worth, jobs, least = mixing.damped(mixing.term_weights(counted)), [], mixing.least_like
    monkeypatch.setattr(mixing, "least_like", lambda *a: jobs.append(1) or least(*a))
    got = mixing.first_centres(counted, worth)
    kept = counted.orderBy("hash").toArrow().combine_chunks()
    x = mixing.term_vectors(*(kept.column(c).chunk(0) for c in ("terms", "counts")), worth, np.zeros((len(kept), mixing.TERMS)))
    want = [x[0]]  # the text of least hash, and each time the one least like those before
    while len(want) < mixing.TOPIC_COUNT:
        want.append(x[np.argmin((x @ np.array(want).T).max(axis=1))])
    assert np.array_equal(got, np.array(want)) and len(jobs) < mixing.TOPIC_COUNT


def test_term_counts_are_whole():
    texts_ = ["", "a " * 70_000 + "b " * 64 + "c " * 63 + "d", " \n", "B b"]
    terms, counts = mixing.term_counts(texts_)
    weights = np.linspace(0.5, 2, mixing.TERMS)
    got = mixing.term_vectors(terms.slice(1), counts.slice(1), mixing.damped(weights), np.ones((4, mixing.TERMS)))
    for row, text in zip(got, texts_[1:]):
        want = np.zeros(mixing.TERMS)
        for h in word_hashes([text.encode()])[0].tolist():
            want[h >> 54] += 1
        want = np.log1p(want) * weights
        assert row == pytest.approx(np.rint(want / max(np.linalg.norm(want), 1e-9) * mixing.UNIT), abs=1)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns and 0 < after.count() <= before.count(), name
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    last = corpus_pipeline.run(spark, sf)
    assert last.count() == before.count() and last.agg(F.sum("n_tokens")).first()[0] > 0


def test_pipeline_mixes_by_topics_of_all_texts(spark):
    import corpus_pipeline

    rows, themes = themed(spark)
    kept = {x.doc_id for x in corpus_pipeline.mixing_stage(spark, table(spark, rows), "").collect()}
    assert {i for i, k in enumerate(themes) if k == 7} <= kept  # a topic that is rare has a higher target than it holds
    assert 0.4 < len(kept) / len(rows) < 0.6


def brute_kept(rows, percent, words):
    """Ids that are the least of their component, all pairs tested."""
    sets, root = {}, {}
    for i, t in rows:
        w = t.lower().split()
        sets[i], root[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}, i
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {i for i in sets if root[i] == i}


def test_near_duplicates_stage(spark):
    import corpus_pipeline

    r = random.Random(8)
    rows = []
    for g in range(4):
        base = [f"g{g}w{r.randint(0, 900)}" for _ in range(200)]
        rows.append((1000 * g, " ".join(base)))
        for edits in range(1, 8):  # alone in its place: 4 edits link at 5 words and 0.8 only
            w = list(base)
            for k in range(edits):
                w[10 + 25 * k + r.randint(0, 9)] = f"e{g}x{edits}x{k}"
            rows.append((1000 * g + edits, " ".join(w)))
    odd = [(5, "a b c d e f g"), (5, "z y x w v u t"), (3, "z y x w v u t"), (5, "a b c d e f g"), (7, ""), (7, None), (None, "z y x w v u t"), (None, None)]
    left = corpus_pipeline.near_duplicates_stage(spark, table(spark, odd).withColumn("hash", F.lit(1)).withColumn("turn", F.lit(2)), "")
    assert sorted((x.doc_id or 0, x.text or "") for x in left.collect()) == [(0, ""), (0, "z y x w v u t"), (3, "z y x w v u t"), (5, "a b c d e f g"), (7, "")] and left.columns[-2:] == ["hash", "turn"]
    want = brute_kept(rows, 80, 5)
    assert want != brute_kept(rows, 90, 3)
    assert {x.doc_id for x in corpus_pipeline.near_duplicates_stage(spark, table(spark, rows), "").collect()} == want


def test_fingerprints_of_long_near_copies():
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    for n in (200, 1000, 5000, 20000):
        base = [r.choice(vocabulary) for _ in range(n)]
        for edits, least in ((0.003, 0.85), (0.02, 0.7)):  # likeness 0.97 and 0.82 on sets of five words
            w = list(base)
            for k in r.sample(range(n), max(1, round(edits * n))):
                w[k] = r.choice(vocabulary)
            one, copy, other = fingerprint.fingerprints([" ".join(base), " ".join(w), " ".join(r.choice(vocabulary) for _ in range(n))])
            a, b = ({tuple(x[k : k + 5]) for k in range(n - 4)} for x in (base, w))
            dice = 2 * len(a & b) / (len(a) + len(b))
            assert fingerprint.likeness(one, copy) == pytest.approx(dice, abs=0.15) and fingerprint.likeness(one, copy) > least
            assert fingerprint.likeness(one, other) < 0.1


def test_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = table(spark, ODD).withColumn("score", F.lit(1)).withColumn("mix", F.lit("m"))
    for rows in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == df.columns and out.count() <= rows.count(), name
