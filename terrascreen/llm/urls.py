"""URL filter rules found by their rarest literal token; only fetched rules run their regular expression."""

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascreen.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[^a-z0-9]+"
SALTS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host, path and query of an address; each of ``tokens`` stands whole in every address it can match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def site_rule(place: str, verdict: str) -> Rule:
    """A host and the start of a path, as ``example.com/en/``: fits the host and its subdomains. Longer rules go before shorter ones."""
    host, _, path = place.partition("/")
    tokens = [t for t in re.split(SEPARATORS, host) if t]
    if path.endswith("/"):
        tokens += [t for t in re.split(SEPARATORS, path) if t and re.fullmatch(r"[a-z0-9/._-]*", path)]
    quoted = re.sub(r"([^A-Za-z0-9/])", r"\\\1", place)
    return Rule(place, verdict, rf"^(?:[^/?#]*\.)?{quoted}", tuple(dict.fromkeys(tokens)), 1_000_000 + len(place))


def word_rule(words: str, verdict: str = "block") -> Rule:
    """Words in a row in any part of an address, apart by a hyphen, underscore, dot, plus sign or slash."""
    tokens = words.split()
    return Rule(words, verdict, r"(?:^|[^a-z0-9])" + r"[-_.+/]".join(tokens) + r"(?:[^a-z0-9]|$)", tuple(tokens), 0)


#: Stretches that web addresses of unwanted pages carry; stands in for a list of thousands.
WORDS = ["spam farm", "cheap pills", "casino", "casino bonus", "free slots", "adult", "xxx", "porn", "porno", "viagra", "payday loans", "essay writing service",
         "link farm", "warez", "keygen", "torrent", "replica watches", "online pharmacy", "escort", "click farm", "buy followers", "crypto giveaway"]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, number sign or the end; A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, number sign or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.name, r.verdict, r.pattern, list(r.tokens), r.rank) for r in rules]
    return spark.createDataFrame(rows, "rule string, verdict string, pattern string, tokens array<string>, rank int")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """``keep``, ``host``, ``path``, ``matched`` (name of the best rule or null), ``matched_rank`` and ``verdict``.

    Every different address is judged once. The tokens of all addresses are counted; each rule waits at its token that fewest addresses
    hold, the addresses' tokens fetch the rules, and only those run their pattern. Of several rules the highest rank wins, then the
    name. A null address has an empty host and path and, like one without a match, the ``default`` verdict; repeated rows stay.
    Rules without tokens are refused, since nothing could fetch them.
    """
    if rules.where(F.size("tokens") == 0).limit(1).count():
        raise ValueError("every rule needs a literal token")
    source = pages.select(F.struct(*[pages[c] for c in keep]).alias("kept"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"))
    low = F.translate(_rest(F.col("url")), UPPER, LOWER)
    fold = F.concat(host_of(F.col("url")), F.substring(_rest(F.col("url")), F.length(host_of(F.col("url"))) + 1, F.length("url")))
    distinct = written(source.select("url").distinct().select("url", fold.alias("address"), F.array_distinct(F.split(low, SEPARATORS)).alias("tokens")), "url-tokens")
    wanted = rules.select("rule", "verdict", "pattern", "rank", F.explode("tokens").alias("token"))
    counts = distinct.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    index = (wanted.join(counts, "token", "left").groupBy("rule", "verdict", "pattern", "rank")
             .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token")))
    # A token of every address would meet its rules in one task; each is dealt to SALTS places, where the rules are repeated.
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = distinct.select("url", "address", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("tokens").alias("token"))
    fetched = asked.join(salted, ["token", "salt"])
    lowered = F.translate("address", UPPER, LOWER)
    target = F.when(F.col("rank") > 0, F.col("address")).otherwise(lowered)
    best = (fetched.where(F.regexp_like(target, F.col("pattern"))).groupBy("url")
            .agg(F.max_by(F.struct("rule", "verdict", "rank"), F.struct("rank", "rule")).alias("best")))
    joined = source.join(best, "url", "left")
    own = ("host", "path", "matched", "matched_rank", "verdict")
    return joined.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep if c not in own], host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                         F.col("best.rule").alias("matched"), F.col("best.rank").alias("matched_rank"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
