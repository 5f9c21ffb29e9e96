"""URL filters: rules, and the ratio of two character language models, by DataFrame functions only.

Rules are (host, path, verdict): a rule fits its host and all subdomains if the URL's path starts with
the rule's; the longest rule wins. URLs that no rule fits are judged by smoothed variable-order Markov
models of accepted and rejected URLs: the probability of a character after its longest known context
mixes, order by order, the context's own counts with the next shorter context's probability,
``(count + BLEND * shorter) / (total + BLEND)``. The score is the difference of the two log-likelihoods
divided by the number of characters.

Training needs no marked URLs. ``ACCEPTED`` and ``REJECTED`` are example names that fit a first pair of models; a host
of the table is a rejected example if these give it more than ``MARGIN``, any other an accepted one. The
final models count the examples and all keys (host and path, digits folded to 0) of the hosts whose crc32 is
even, each key with its number of rows. The hosts whose crc32 is odd are not counted; on them the threshold is calibrated, midway between
a high quantile of their accepted keys' scores and a low quantile of their rejected ones', but not below 0, where both are as likely; without both
it is ``MARGIN``. Every host is judged by the same models and threshold. A key is scored once, whatever its number of rows.
Keys, counts and scores are written to the shared folder as they are used more than once.

A null URL, or one without ``://``, has an empty host and path, which no rule fits and the method
allows. Repeated rows get equal verdicts; URLs of any length are scored whole; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.saved import Scratch
from tidelog.llm.skew import looked_up

#: The rules that the query applies.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Example names of sites to accept and to reject.
ACCEPTED = """library university museum city-council weather daily-news science-journal history-archive open-docs developer-guide recipes garden-club
    train-times health-ministry hospital school math-lectures music-review book-store travel-notes photo-blog chess-club cycling astronomy biology
    chemistry physics-forum encyclopedia dictionary translation radio theatre gallery economy law-review parliament statistics maps local-paper
    sports-results football research-lab software linux-manual wiki nature water-board kitchen""".split()
REJECTED = """casino-royal online-casino play-poker slots-bonus bet-now sportsbets lucky-jackpot roulette-spin cheap-pills pharma-discount buy-viagra
    meds-online diet-pills steroid-shop adult-cams adult-video xxx-movies porn-tube hot-singles sex-chat ads-server adtracker click-track banner-ads
    popunder-ads pixel-tracking spam-mail bulk-spam link-farm seo-backlinks article-spin free-followers free-money free-gift-card win-prizes
    winner-claim payday-loans fast-cash crypto-doubler get-rich phish-login account-verify malware-download cracked-keygen warez-serial replica-watches""".split()
ORDER, BLEND, QUANTILE, MARGIN = 4, 2.0, 0.02, 0.7


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict, or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # a longer one overrules
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(names: DataFrame, name: str, *kept: str) -> DataFrame:
    """A row for each character of a name: it and the ``ORDER`` characters before."""
    places = names.select(*kept, F.concat(F.lit("^" * ORDER), F.col(name)).alias("padded"), F.explode(F.sequence(F.lit(1), F.length(name))).alias("at"))
    return places.select(*kept, F.expr(f"substring(padded, at, {ORDER + 1})").alias("gram"))


def _ratios(counts: DataFrame) -> DataFrame:
    """(gram, n, ratio): the logarithm of each gram's rejected over its accepted probability. ``counts`` has (gram, n,
    bad, good), also with counts of 0. An order's contexts and their shorter ones are joined as distinct rows, so no row is hot."""
    before: DataFrame | None = None
    for k in range(ORDER + 1):
        own = counts.groupBy(F.expr(f"right(gram, {k + 1})").alias("g")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum("n").alias("n"))
        context = F.expr(f"left(g, {k})")
        sums = own.groupBy(context.alias("c")).agg(F.sum("bad").alias("bad_total"), F.sum("good").alias("good_total"))
        now = own.join(F.broadcast(sums) if k == 0 else sums, context == F.col("c")).drop("c")  # order 0 has one context
        if before is None:
            now = now.select("g", "n", "bad", "good", "bad_total", "good_total", F.lit(1 / 256).alias("p_bad"), F.lit(1 / 256).alias("p_good"))
        else:
            now = now.join(before.withColumnRenamed("g", "shorter"), F.expr(f"right(g, {k})") == F.col("shorter")).drop("shorter")
        mixed = [((F.col(x) + BLEND * F.col(f"p_{x}")) / (F.col(f"{x}_total") + BLEND)).alias(f"p_{x}") for x in ("bad", "good")]
        before = now.select("g", *(["n"] if k == ORDER else []), *mixed)
    return before.select(F.col("g").alias("gram"), "n", F.log(F.col("p_bad") / F.col("p_good")).alias("ratio"))


def _scores(names: DataFrame, name: str, ratios: DataFrame) -> DataFrame:
    """(name, score): the mean ratio of each distinct name."""
    return looked_up(_grams(names, name, name), ratios, "gram", "n", ["ratio"]).groupBy(name).agg(F.avg("ratio").alias("score"))


def judged_table(df: DataFrame, rules: list[tuple[str, str, str]] = RULES, accepted: list[str] = ACCEPTED, rejected: list[str] = REJECTED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score and held_out (the host was not counted) of every row."""
    spark = df.sparkSession
    host, path = url_parts(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    parts = df.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("key", F.regexp_replace(F.concat("host", "path"), "[0-9]+", "0"))
    scratch = Scratch(spark, "urls")
    keys = scratch.save(parts.filter("key != ''").groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("host").alias("host")))

    marks = [F.struct(F.lit(x).alias("name"), F.lit(y).alias("bad")) for y, xs in enumerate((accepted, rejected)) for x in xs]
    examples = spark.range(1).select(F.inline(F.array(*marks)))
    known = _grams(examples, "name", "bad").groupBy("gram").agg(F.lit(0).cast("long").alias("n"), F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))

    def ratios(there: DataFrame) -> DataFrame:
        both = there.unionByName(known).groupBy("gram").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        counts = scratch.save(both)
        out = scratch.save(_ratios(counts))
        scratch.drop(counts)
        return out

    hosts = keys.select("host").distinct().filter("host != ''")
    none = F.lit(0).cast("long")
    first = ratios(_grams(hosts, "host").groupBy("gram").agg(F.count(F.lit(1)).alias("n"), none.alias("bad"), none.alias("good")))
    bad = (F.coalesce("score", F.lit(0.0)) > MARGIN).cast("long")
    marked = scratch.save(keys.join(_scores(hosts, "host", first), "host", "left").select("key", "rows", bad.alias("bad"), (F.crc32(F.col("host").cast("binary")) % 2 == 1).alias("held_out")))
    fit = F.when(F.col("held_out"), 0).otherwise(F.col("rows"))
    final = ratios(_grams(marked.withColumn("fit", fit), "key", "fit", "bad").groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fit") * F.col("bad")).alias("bad"), F.sum(F.col("fit") * (1 - F.col("bad"))).alias("good")))
    scored = scratch.save(marked.join(_scores(marked, "key", final), "key").select("key", "rows", "bad", "held_out", "score"))
    scratch.drop(keys, first, marked, final)
    limits = scored.filter("held_out").agg(F.expr(f"percentile_approx(score, {1 - QUANTILE}, 10000) FILTER (WHERE bad = 0)").alias("high"), F.expr(f"percentile_approx(score, {QUANTILE}, 10000) FILTER (WHERE bad = 1)").alias("low"))
    limits = limits.select(F.coalesce(F.greatest((F.col("high") + F.col("low")) / 2, F.lit(0.0)), F.lit(MARGIN)).alias("threshold"))
    verdicts = looked_up(parts, scored, "key", "rows", ["score", "held_out"]).crossJoin(F.broadcast(limits))  # one row
    verdicts = verdicts.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("score") > F.col("threshold"), "block").otherwise("allow")
    return verdicts.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
