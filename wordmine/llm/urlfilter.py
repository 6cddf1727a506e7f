"""URL filter: rules of hosts and paths, and a logistic regression on hashed character n-grams for the rest.

The model learns from a small table of labelled URLs (``url, label``; 1 = block).
A URL's features are the character n-grams of its host and of its path, each
hashed into one of ``N_BUCKETS`` buckets, as a vector of length one; digits count
as one character, so page numbers are no features. Training is full-batch
gradient descent with momentum: a step is one aggregation over the training table, and its
gradient, at most a number a bucket, is all that reaches the driver. Judging is
a projection over the rows: no join, no shuffle, nothing but SQL functions, with
the weights as one literal.

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path, no rule, and the model's verdict on no features at all; null or
unlabelled rows of the training table are left out; repeated rows are judged
each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.functions.text import sql_str
from wordmine.session import materialise

N_BUCKETS = 8192
HOST_GRAMS = (3, 4, 5)
PATH_GRAMS = (3, 4)
STEPS = 30
RATE = 0.1
MOMENTUM = 0.9
DECAY = 1e-3

# The labelled table: what is in a host's name or a path, and its label. Fixed values.
BLOCKED_NAMES = [
    "casino-win", "free-bets", "cheap-pills", "adult-x", "ads-track", "spam-farm", "poker-bonus", "slots-jackpot", "lottery-prize",
    "viagra-shop", "payday-loans", "porn-tube", "xxx-cams", "click-banner", "warez-crack", "replica-watches", "betting-odds",
    "pills-online", "casino-royal", "track-pixel", "adserver", "popup-ads", "free-casino", "win-cash", "link-farm", "seo-spam",
]
ALLOWED_NAMES = [
    "city-library", "garden-club", "weather-report", "open-science", "history-museum", "football-news", "cooking-school",
    "math-forum", "river-guide", "music-archive", "teacher-notes", "village-council", "street-atlas", "bird-watch", "planet-image",
    "national-journal", "health-service", "software-manual", "train-times", "mountain-huts", "letters-edition", "thermal-energy",
    "author-reading", "station-hall", "northern-lights", "onion-recipe", "theatre", "mathematics", "theory", "southern-trail",
    "brother", "earth", "health", "thousand", "throne", "thesaurus", "weather", "another", "gathering", "rhythm", "python", "method",
    "athens", "lighthouse", "youth-hostel", "birthday", "father", "leather", "anthology", "cathedral", "zeitung", "bibliothek",
    "wissenschaft", "strasse", "journal", "musique", "histoire", "ecole", "jardin", "ciudad", "noticias", "escuela", "biblioteca",
    "university", "hospital", "department", "parliament", "newspaper", "encyclopedia", "dictionary", "translation", "orchestra",
    "engineering", "biology", "chemistry", "physics", "geography", "economics", "philosophy", "literature", "painting", "sculpture",
]
# Both labels come with every kind of address, so that none of it tells them apart.
ADDRESSES = [
    ("https://www.", ".example.com", "/en/1204"), ("http://", ".example.org", "/de/77.html"), ("https://m.", ".example.net", "/fr/5310/?page=2&ref=x"),
    ("http://blog.", ".example.com", "/es/918#top"),
]
BLOCKED_PATHS = ["/ads/click", "/banner/track.gif", "/casino/bonus", "/xxx/cams", "/cheap/pills/buy"]
ALLOWED_PATHS = ["/news/article", "/library/books", "/docs/manual", "/en/garden", "/history/index.html"]


def labelled_urls() -> list[tuple[str, int]]:
    """The training table of the registered query: every name at one of the addresses, every path at one neutral host."""
    out = []
    for label, names, paths in ((1, BLOCKED_NAMES, BLOCKED_PATHS), (0, ALLOWED_NAMES, ALLOWED_PATHS)):
        for i, name in enumerate(names):
            before, after, path = ADDRESSES[i % len(ADDRESSES)]
            out.append((f"{before}{name}{after}{path}", label))
        out += [(f"https://pages.example.org{path}", label) for path in paths]
    return out


def url_table(spark: SparkSession, urls: list[tuple[str, int]]) -> DataFrame:
    """A few labelled URLs as a DataFrame (url, label)."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({sql_str(u)}, {int(y)})" for u, y in urls) + " AS t(url, label)")


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there up to ``?``, ``#`` or the end."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(coalesce(cast(`{url}` AS string), ''), instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest of ``rules`` (verdict, host, path) that fits, as text and verdict; nulls if none does.

    A rule fits its host and all subdomains of it, where the path starts with the rule's.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit(f".{h}"))) & F.startswith(F.col(path), F.lit(p))
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _grams(value: str, sizes: tuple[int, ...], mark: str) -> str:
    """SQL: the n-grams of a string between two marks, each behind the mark; none for an empty string."""
    framed = f"concat('^', translate({value}, '123456789', '000000000'), '$')"
    lists = [f"transform(sequence(1, greatest(length(v) - {n - 1}, 1)), i -> concat('{mark}{n}', substring(v, i, {n})))" for n in sizes]
    return f"IF({value} = '', array(), {_once('v', framed, f'concat({", ".join(lists)})')})"


def _once(name: str, value: str, then: str) -> str:
    """SQL: ``then`` with ``name`` bound to ``value``, which is so evaluated once a row."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _buckets(host: str, path: str) -> str:
    """SQL: the bucket of every n-gram, repeats included: four hexadecimal digits of its MD5, taken modulo their number."""
    grams = f"concat({_grams(host, HOST_GRAMS, 'h')}, {_grams(path, PATH_GRAMS, 'p')})"
    return f"transform({grams}, g -> cast(conv(substring(md5(g), 1, 4), 16, 10) AS int) % {N_BUCKETS})"


def train(labelled: DataFrame, steps: int = STEPS, rate: float = RATE, momentum: float = MOMENTUM, decay: float = DECAY) -> list[float]:
    """Weights by bucket, the bias last."""
    host, path = host_and_path()
    rows = labelled.filter("url is not null and label is not null").select(
        F.col("label").cast("double").alias("y"), host.alias("host"), path.alias("path"))
    counted = "transform(array_distinct(al), b -> named_struct('b', b, 'n', cast(size(filter(al, c -> c = b)) AS double)))"
    length = "sqrt(aggregate(f, 0D, (s, z) -> s + z.n * z.n))"
    scaled = _once("f", counted, _once("m", length, "transform(f, x -> named_struct('b', x.b, 'v', x.n / m))"))
    # written once: every step reads the features
    rows = materialise(rows.select("y", F.expr(_once("al", _buckets("host", "path"), scaled)).alias("f")), "url-features")
    weights, speed = [0.0] * (N_BUCKETS + 1), [0.0] * (N_BUCKETS + 1)
    features = F.concat("f", F.array(F.struct(F.lit(N_BUCKETS).alias("b"), F.lit(1.0).alias("v"))))
    for _ in range(steps):
        error = rows.select("f", (1 / (1 + F.exp(-_margin("f", weights))) - F.col("y")).alias("e"))
        gradient = (error.select("e", F.explode(features).alias("x")).groupBy("x.b")
                    .agg(F.sum(F.col("e") * F.col("x.v")).alias("g")).collect())
        speed = [momentum * m + decay * w for m, w in zip(speed, weights, strict=True)]
        for b, g in gradient:
            speed[b] += g
        weights = [w - rate * m for w, m in zip(weights, speed, strict=True)]
    return weights


def _margin(features: str, weights: list[float]) -> Column:
    """Weights (one literal) times features, plus the bias."""
    literal = f"from_json('{json.dumps(weights)}', 'array<double>')"
    return F.expr(f"aggregate({features}, {weights[-1]!r}D, (s, x) -> s + x.v * element_at({literal}, x.b + 1))")


def block_chance(weights: list[float], host: str = "host", path: str = "path") -> Column:
    """The model's probability that a URL is one to block.

    The length of the feature vector comes from the sorted buckets: a run of r
    equal ones adds r * r, that is, 2 r - 1 for its r-th entry.
    """
    literal = f"from_json('{json.dumps(weights)}', 'array<double>')"
    state = "named_struct('b', -1, 'r', 0, 'n', 0D, 's', 0D)"
    step = ("(a, b) -> named_struct('b', b, 'r', IF(a.b = b, a.r + 1, 1), 'n', a.n + IF(a.b = b, 2 * a.r + 1, 1), "
            f"'s', a.s + element_at({literal}, b + 1))")
    margin = f"IF(a.n > 0, a.s / sqrt(a.n), 0D) + {weights[-1]!r}D"
    return F.expr(f"aggregate(array_sort({_buckets(host, path)}), {state}, {step}, a -> 1 / (1 + exp(-({margin}))))")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], weights: list[float], id_col: str = "page_id",
          url_col: str = "url", least: float = 0.5) -> DataFrame:
    """Every page's id, host, path, rule, verdict (the rule's; without one, block from ``least`` on) and the model's ``chance``."""
    host, path = host_and_path(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    text, verdict = matching_rule(rules)
    rows = rows.select("page_id", "host", "path", text.alias("rule"), verdict.alias("ruled"), block_chance(weights).alias("chance"))
    own = F.when(F.col("chance") >= least, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "chance")
