"""URL filter: allow and block rules, and gradient-boosted trees on lexical features where no rule fits.

All of it is DataFrame and MLlib work in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "parameters", "parameter_length", "suffix_rate", "gram_odds")
#: Hash buckets of the runs of three characters in hosts.
GRAMS = 4096


def _rest(url: F.Column) -> F.Column:
    """What follows the first ``://``, or ''."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: F.Column) -> F.Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: F.Column) -> F.Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _share(text: F.Column, pattern: str) -> F.Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def entropy(text: F.Column) -> F.Column:
    """Bits a character of the text, from the runs of its sorted characters."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    part = lambda run: F.when(run > 0, -(run / n) * F.log2(run / n)).otherwise(F.lit(0.0))
    empty = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s: F.Column, c: F.Column) -> F.Column:
        same = s["c"] == c
        return F.struct(c.alias("c"), F.when(same, s["run"] + 1).otherwise(F.lit(1.0)).alias("run"), F.when(same, s["sum"]).otherwise(s["sum"] + part(s["run"])).alias("sum"))

    return F.aggregate(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), empty, step, lambda s: s["sum"] + part(s["run"]))


def grams_of(host: F.Column) -> F.Column:
    """Bucket (from 1) of each run of three characters of a host, which begins and ends with a dot here."""
    chars = F.filter(F.split(F.concat(F.lit("."), host, F.lit(".")), ""), lambda c: c != "")
    n = F.length(host) + 2
    runs = F.arrays_zip(chars.alias("x"), F.slice(chars, F.lit(2), n).alias("y"), F.slice(chars, F.lit(3), n).alias("z"))
    return F.transform(F.filter(runs, lambda r: r["z"].isNotNull()), lambda r: (F.pmod(F.xxhash64(r["x"], r["y"], r["z"]), F.lit(GRAMS)) + 1).cast("int"))


def lexical(df: DataFrame) -> DataFrame:
    """Add the lexical features to (url, host, path); null urls count as ''."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    columns = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "labels": F.regexp_count(host, F.lit(r"\.")) + 1,
        "digits": _share(url, "[0-9]"),
        "host_digits": _share(host, "[0-9]"),
        "hyphens": F.regexp_count(host, F.lit("[-_]")),
        "entropy": entropy(host),
        "parameters": F.when(query == "", F.lit(0)).otherwise(F.size(F.split(query, "[&;]"))),
        "parameter_length": F.length(query),
    }
    return df.select("*", F.substring_index(host, ".", -1).alias("suffix"), *[c.cast("double").alias(k) for k, c in columns.items()])


#: Names that the default labels are made of.  Fixed values: stems of offers, and stems of plain sites.
OFFERS = "casino bet bets poker slots bingo jackpot pills viagra pharma diet loan loans cash credit prize bonus free win cheap deals adult porn cams dates hot spam farm seo hack crack warez coupon".split()
SITES = "news blog times post daily city park school music garden book library health travel food kitchen art museum science forum house home land river mountain school sport team photo world green history".split()


def seed_urls(spark: SparkSession, rows: int = 4000, part: int | None = None) -> DataFrame:
    """Labelled URLs (url, label 1 = block, kind) to train on, made by rule; a quarter is blocked.

    Both labels come with and without hyphens, digits, long paths, parameters and every suffix.  Blocked kinds: offers
    (one or two stems), generated hosts (random letters and digits), redirects (plain hosts with long parameters).
    Allowed kinds: site names of stems, pseudo-words of common syllables, hyphenated names, numbered sites.  part 0
    or 1 gives URLs of one half of all stems and syllables only, so that a test can hold the other half out.
    """
    half = (lambda xs: xs) if part is None else (lambda xs: xs[part::2])

    def pick(salt: int, options: list[str]) -> F.Column:
        return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))) + 1).cast("int"))

    def number(salt: int, below: int) -> F.Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(below)).cast("string")

    kind_no = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(16))
    syllables = half([a + b for a in "th he an er on re in st en nd ti or es ha ou".split() for b in ("", "a", "ed", "er", "tion", "ble", "ly", "ing")])
    word = lambda salt: F.concat(pick(salt, syllables), pick(salt + 1, syllables), pick(salt + 2, ["", "", "er", "an", "st"]))
    dash = lambda salt: pick(salt, ["-", "-", ""])
    offer = F.concat(pick(20, half(OFFERS)), dash(21), pick(22, half(OFFERS) + ["x", "4u", "online", "vip"]), pick(23, ["", "", "24", "777", "-club"]))
    random_host = F.concat(F.substring(F.translate(F.sha2(F.col("id").cast("string"), 256), "0123456789", "0q2x4z6w8v"), F.lit(1), (F.pmod("id", F.lit(12)) + 9).cast("int")))
    site = F.concat(pick(24, half(SITES)), dash(25), pick(26, half(SITES) + ["my", "the", "our"]))
    hyphenated = F.concat(pick(27, ["the", "my", "old", "new", "st"]), F.lit("-"), word(28))
    numbered = F.concat(word(32), pick(35, ["", "-"]), number(36, 100))
    kinds = [("offer", 1, offer), ("offer", 1, offer), ("generated", 1, random_host), ("redirect", 1, word(40))]
    kinds += [("site", 0, site), ("site", 0, site), ("hyphenated", 0, hyphenated), ("numbered", 0, numbered)] + [("word", 0, word(44))] * 8
    select = lambda i: F.element_at(F.array(*[F.lit(k[i]) if i < 2 else k[i] for k in kinds]), (kind_no + 1).cast("int"))
    front = pick(1, ["", "", "www.", "m.", "blog.", "shop."])
    suffix = F.concat(pick(2, [".example", ".example", "", ".site"]), pick(3, [".com", ".net", ".org", ".de", ".fr", ".es"]))
    path = F.concat(F.lit("/"), pick(4, ["en", "de", "fr", "es", "a/b", "2024/05/page"]), F.lit("/"), number(5, 10000), pick(6, ["", "", "/", ".html", "#top", "?page=2&ref=x", "?utm_source=feed", "?q=a&lang=en&sort=up"]))
    tail = F.when(select(0) == "redirect", F.concat(F.lit("/go?u="), F.sha2(F.concat(F.lit("r"), F.col("id")), 256), F.lit("&aff="), number(7, 100000), F.lit("&sid="), number(8, 100000), F.lit("&t=1"))).otherwise(path)
    url = F.concat(pick(9, ["http://", "https://"]), front, select(2), suffix, tail)
    return spark.range(0, rows, 1, 2).select(url.alias("url"), select(1).cast("double").alias("label"), select(0).alias("kind"))


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None
    suffixes: DataFrame | None  # suffix, suffix_rate; at most as many rows as the training sample
    base: float
    grams: list[float]  # log odds of block for each bucket of ``grams_of``


def _with_suffix_rate(df: DataFrame, suffixes: DataFrame, base: float) -> DataFrame:
    return df.join(F.broadcast(suffixes), "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(base)))


def _gram_odds(sample: DataFrame, base: float) -> list[float]:
    """Log odds of block of each bucket against those of all URLs, drawn towards 0 where few URLs have it; a bucket
    counts once a URL."""
    seen = sample.select("label", F.explode(F.array_distinct(grams_of(F.col("host")))).alias("g"))
    rows = seen.groupBy("g").agg(F.sum("label").alias("b"), F.count("*").alias("n")).collect()  # at most GRAMS rows
    out = [0.0] * GRAMS
    for r in rows:
        bad, good = r["b"] + 4 * base, r["n"] - r["b"] + 4 * (1 - base)
        out[r["g"] - 1] = math.log(bad / good) - math.log(base / (1 - base))
    return out


def _with_gram_odds(df: DataFrame, grams: list[float]) -> DataFrame:
    odds = F.lit(grams)
    found = F.transform(grams_of(F.col("host")), lambda g: F.element_at(odds, g))
    return df.withColumn("gram_odds", F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.length("host"), F.lit(1)))


def train_url_filter(labelled: DataFrame, *, max_rows: int = 5000, trees: int = 16, depth: int = 4) -> UrlModel:
    """Fit on at most ``max_rows`` labelled rows (url, label; the smallest hashed urls).  Without rows of both labels,
    all urls get the more common one (allow, if there are none)."""
    usable = labelled.filter("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label"))
    sample = usable.orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
    sample = lexical(sample.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label"))
    sample = stored(sample, "labelled-urls")
    counts = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)).alias("bad"), F.count("*").alias("n")).first()
    base = (counts["bad"] + 0.5) / (counts["n"] + 1) if counts["n"] else 0.0
    if counts["bad"] in (0, counts["n"]):
        return UrlModel(None, None, base, [])
    # Statistics of names come from one half of the sample and the trees learn from the other: so they see what such
    # statistics are worth on names that didn't enter them.
    first = F.pmod(F.xxhash64(F.lit("half"), F.col("url")), F.lit(2)) == 0
    suffixes = sample.filter(first).groupBy("suffix").agg(((F.sum("label") + 4 * F.lit(base)) / (F.count("*") + 4)).alias("suffix_rate"))
    grams = _gram_odds(sample.filter(first), base)
    ready = _with_gram_odds(_with_suffix_rate(sample.filter(~first), suffixes, base), grams)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(ready).select("features", "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=11, checkpointInterval=-1, maxBins=32).fit(data)
    return UrlModel(model, suffixes, base, grams)


def filter_urls(df: DataFrame, model: UrlModel, *, key_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(``key_col``, url, host, path, rule, score, verdict) for each row of df.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with the rule's; the longest rule
    wins, of equally long ones the first.  Where none fits, rule is null and the trees decide (score: chance of
    block).  A null url, or one without ``://``, has empty host and path and is decided by the trees too.
    """
    base = df.select(F.col(key_col).alias("key"), F.col(url_col).alias("url"))
    base = base.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = verdict = None
    for decision, host, path in ordered:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    rule = F.lit(None).cast("string") if rule is None else rule
    verdict = F.lit(None).cast("string") if verdict is None else verdict
    judged = lexical(base.select("*", rule.alias("rule"), verdict.alias("by_rule")))
    if model.trees is None:
        scored = judged.withColumn("score", F.lit(model.base))
    else:
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_with_gram_odds(_with_suffix_rate(judged, model.suffixes, model.base), model.grams))
        from pyspark.ml.functions import vector_to_array

        scored = model.trees.transform(assembled).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    by_trees = F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("key").alias(key_col), "url", "host", "path", "rule", "score", F.coalesce("by_rule", by_trees).alias("verdict"))
