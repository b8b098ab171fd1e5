"""Operator 9: URL filters, by rules and by a logistic regression on hashed character n-grams."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules (text, allow?): a host, then a slash and the path that a url's path must start with.
RULES = [("com/en/", False), ("example.com/en/7", True), ("net/de/", True), ("example.net/de/8", False), ("org/es/", False)]

#: The small labelled table that the regression is trained on by default, made by rule: a host joins
#: two words of its side, in both orders, with and without a hyphen, and comes with paths that both
#: sides share, so that these speak for neither. The words are general ones for unwanted and for
#: ordinary sites, and names of drawn syllables; no host and no letter group is taken from a table of pages.
_UNWANTED = "cheap pill casino bet spam link farm adult xxx ads track click popup loan payday prize winner lottery replica warez crack bonus slots viagra".split()
_ORDINARY = "weather news garden library museum school recipe travel history music hospital city science theatre market mountain radio book family forum".split()
_CONSONANTS, _VOWELS = "bcdfghklmnprstvz", "aeiou"
_PATHS = ["/en/{}", "/fr/{}.html", "/"]


def _hosts(words: list[str]) -> list[str]:
    """Pairs of words 1, 3, ... and 11 places apart, joined by a hyphen or by nothing, in turns."""
    n = len(words)
    return [f"{words[k]}{'-' if (k + step) % 2 else ''}{words[(k + step) % n]}" for k in range(n) for step in (1, 3, 5, 7, 9, 11)]


def _plain_names(n: int = 200) -> list[str]:
    """Names without meaning, of two to four syllables: most hosts are of no kind that words tell."""
    letter = lambda letters, *key: letters[zlib.crc32(repr(key).encode()) % len(letters)]
    return ["".join(letter(_CONSONANTS, k, i, 0) + letter(_VOWELS, k, i, 1) for i in range(2 + k % 3)) for k in range(n)]


def labelled_table() -> list[tuple[str, int]]:
    """(url, label) of every host with each path; label 1 is to block."""
    sides = [(_hosts(_UNWANTED), 1), (_hosts(_ORDINARY) + _plain_names(), 0)]
    tops = ["test", "invalid", "localhost"]
    return [(f"https://{'www.' if k % 3 == 0 else ''}{host}.{tops[k % 3]}{path.format(7 + 131 * k)}", label) for hosts, label in sides for k, host in enumerate(hosts) for path in _PATHS]


BUCKETS = 2048
NGRAMS = (3, 4)
ROUNDS = 40
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path; both empty where there is no ://, or no url."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def features(host: str, path: str) -> Column:
    """Buckets of the character n-grams of host and path, each n-gram once."""
    grams = []
    for name, column in (("h", host), ("p", path)):
        marked = f"concat('^', {column}, '$')"
        for n in NGRAMS:
            grams.append(f"transform(sequence(1, greatest(length({marked}) - {n - 1}, 1)), i -> cast(pmod(xxhash64('{name}', substring({marked}, i, {n})), {BUCKETS}) as int))")
    return F.expr(f"array_distinct(concat({', '.join(grams)}))")


def _literal(weights: list[float]) -> Column:
    return F.split(F.lit(",".join(repr(w) for w in weights)), ",").cast("array<double>")


def probability(found: str, weights: list[float], bias: float) -> Column:
    """The odds to block of a row of features. The weights are a constant of BUCKETS numbers."""
    total = F.aggregate(found, F.lit(float(bias)), lambda acc, f: acc + F.element_at(_literal(weights), f + 1))
    return 1 / (1 + F.exp(-total / F.sqrt(F.size(found))))


def train(labelled: DataFrame, rounds: int = ROUNDS, rate: float = 4.0, decay: float = 1e-3) -> tuple[list[float], float]:
    """Weights and bias by gradient descent; every round is one aggregation over `labelled`
    (url, label). No more than BUCKETS numbers reach the driver in a round."""
    rows = with_parts(labelled.where("label is not null")).select(F.col("label").cast("double").alias("label"), features("host", "path").alias("f"))
    rows = rows.cache()
    weights, bias, n = [0.0] * BUCKETS, 0.0, max(rows.count(), 1)
    for _ in range(rounds):
        error = ((probability("f", weights, bias) - F.col("label")) / F.sqrt(F.size("f"))).alias("e")
        grown = rows.select(error, "f").select("e", F.explode(F.concat("f", F.array(F.lit(-1)))).alias("k")).groupBy("k").agg(F.sum("e").alias("g")).collect()
        weights = [w * (1 - rate * decay) for w in weights]
        for row in grown:
            if row["k"] < 0:
                bias -= rate * row["g"] / n
            else:
                weights[row["k"]] -= rate * row["g"] / n * math.sqrt(BUCKETS) / 4
    rows.unpersist()
    return weights, bias


def with_parts(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return pages.withColumn("host", host).withColumn("path", path)


def longest_rule(rules: list[tuple[str, bool]]) -> Column:
    """The longest rule (text, allow) that fits columns host and path, or null.

    Of rules of equal length the later one wins. The rules are a constant; their number is the caller's.
    """
    out = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for text, allow in sorted(rules, key=lambda r: len(r[0])):
        host, slash, rest = text.partition("/")
        own = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits = own & F.col("path").startswith(slash + rest) if slash else own
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(allow).alias("allow"))).otherwise(out)
    return out


def judged(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, bool]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_odds of every row of `pages`.

    A rule's verdict stands; without one the regression blocks at odds of a half or more. A null
    url, or one without ://, has an empty host and path, no rule, and what the regression says of
    empty parts.
    """
    weights, bias = train(labelled)
    rows = with_parts(pages.select("page_id", F.col("url").cast("string").alias("url")))
    rows = rows.withColumn("fit", longest_rule(rules)).withColumn("f", features("host", "path"))
    rows = rows.withColumn("block_odds", probability("f", weights, bias))
    block = F.coalesce(~F.col("fit.allow"), F.col("block_odds") >= 0.5)
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.when(block, "block").otherwise("allow").alias("verdict"), "block_odds")


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_table(), "url string, label int")
