"""URL filters: fixed host and path rules, and association rules mined by FP-growth from labels.

A URL's tokens are its scheme, its host, the parts of its host and of its path; parts
of digits become one token. FP-growth runs over the bad URLs alone, for every rule
"these tokens -> bad" has a set that is frequent there; the sets found, of at most
``max_tokens`` tokens, are then counted among all labelled URLs. Support is a number
of bad URLs, not a share, so a host with few pages can have its rule. A rule is kept
if its lift reaches ``min_lift`` and its confidence lies ``min_z`` standard errors
above the share of bad URLs, or if its confidence reaches ``min_confidence`` at that
significance; rules that a kept rule with fewer tokens implies are pruned. Rules match
by an inverted index: token sets, each distinct set once, meet the index on tokens,
and a rule fits a set that has all of its tokens.

Everything runs as DataFrame operations and Spark's own FP-growth. Defined
cases: null URLs and those without ``://`` have empty host and path, no tokens,
and no rule; labels without a URL and URLs without a label are not mined; URLs
with several labels are bad if one says so; without labels nothing is mined; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import ascii_lower, shuffle_parts, stored

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule whose host is the URL's or a parent of it and whose path begins the URL's; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(f"/{r.path}")
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL."""
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1)
    parts = lambda text, kind: F.transform(F.regexp_extract_all(text, F.lit(r"[^./\-_]+"), F.lit(0)), lambda t: F.concat(F.lit(kind), F.when(t.rlike("^[0-9]+$"), F.lit("#")).otherwise(t)))
    all_parts = F.concat(F.array(F.concat(F.lit("s:"), ascii_lower(scheme)), F.concat(F.lit("host:"), host_of(url))), parts(host_of(url), "h:"), parts(ascii_lower(path_of(url)), "p:"))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(all_parts)))


def mine_rules(pages: DataFrame, labels: DataFrame, *, min_count: int = 10, max_tokens: int = 3, min_lift: float = 1.5, min_confidence: float = 0.5, min_z: float = 4.0) -> DataFrame:
    """(rule_id, tokens, confidence, support, lift): from pages (page, tokens) and labels (page, bad); support: labelled URLs with the tokens."""
    spark = pages.sparkSession
    marked = labels.groupBy("page").agg(F.max(F.col("bad").cast("int")).alias("bad")).where("bad is not null")
    baskets = stored(pages.where(F.size("tokens") > 0).join(marked, "page").select("tokens", "bad"), "baskets")
    n, n_bad = baskets.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not n_bad:
        return spark.createDataFrame([], "rule_id bigint, tokens array<string>, confidence double, support bigint, lift double")
    # Tokens of one URL family stand together in all of its URLs; one of such tokens speaks for all, or their subsets would be without number.
    alone = baskets.select(F.explode("tokens").alias("token"), "bad", F.xxhash64("tokens").alias("url")).groupBy("token").agg(F.sum("bad").alias("n_bad"), F.count(F.lit(1)).alias("n"), F.sum(F.col("url").cast("decimal(38,0)")).alias("urls")).where(F.col("n_bad") >= min_count)
    # Equal counts and equal sums of digests: the same URLs. Tokens in all URLs say nothing.
    # Written, as is the index below, so that their size decides whether they or none are broadcast.
    speakers = stored(alone.where(F.col("n") < n).groupBy("n", "n_bad", "urls").agg(F.min("token").alias("token")).select("token"), "speakers")
    bad = baskets.where("bad = 1").withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("tokens").alias("token"))
    items = stored(bad.join(speakers, "token").groupBy("row").agg(F.collect_set("token").alias("items")), "items")
    n_rows = items.count()
    if not n_rows:
        return spark.createDataFrame([], "rule_id bigint, tokens array<string>, confidence double, support bigint, lift double")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_count / n_rows), minConfidence=1.0, numPartitions=shuffle_parts(spark)).fit(items)
    sets = model.freqItemsets.where(F.size("items") <= max_tokens).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("hits"))
    sets = stored(sets.withColumn("rule_id", F.xxhash64("tokens")), "sets")
    counts = _fitting(baskets.withColumn("key", F.monotonically_increasing_id()), sets).groupBy("rule_id").agg(F.count(F.lit(1)).alias("support"))
    base = n_bad / n
    found = sets.join(counts, "rule_id").withColumn("confidence", F.col("hits") / F.col("support"))
    found = found.withColumn("lift", F.col("confidence") / base)
    apart = F.col("confidence") - base >= min_z * F.sqrt(F.lit(base * (1 - base)) / F.col("support"))
    found = stored(found.where(apart & ((F.col("lift") >= min_lift) | (F.col("confidence") >= min_confidence))).select("rule_id", "tokens", "confidence", "support", "lift"), "rules")
    # A rule with more tokens than another that fits whenever it fits decides nothing.
    wide, narrow = found.alias("w"), found.select(F.explode("tokens").alias("token"), F.col("rule_id").alias("other"), F.size("tokens").alias("need"))
    implied = wide.select("rule_id", F.explode("tokens").alias("token")).join(narrow, "token").where("rule_id <> other").groupBy("rule_id", "other").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n = need").select("rule_id").distinct()
    return found.join(implied, "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "support", "lift")


def _fitting(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule_id) of every rule that fits a token set, by the inverted index.

    A rule is indexed by its rarest token among the rules, so that a token of many
    URLs and many rules meets few; its other tokens are looked up in the set.
    """
    tokens = rules.select("rule_id", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = tokens.join(common, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token")).join(rules.select("rule_id", F.col("tokens").alias("need")), "rule_id")
    index = stored(index, "index")
    hits = token_sets.select("key", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return hits.where(F.size(F.array_intersect("need", "tokens")) == F.size("need")).select("key", "rule_id")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule_id) of the most confident rule that fits each token set (key, tokens); sets without one are absent."""
    best = F.max_by("rule_id", F.struct("confidence", "rule_id")).alias("rule_id")
    return _fitting(token_sets, rules).join(rules.select("rule_id", "confidence"), "rule_id").groupBy("key").agg(best)


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", **mining: float) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule) for every page; labels: (page, bad)."""
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"))
    rows = rows.select(id_col, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), url_tokens(F.col("_url")).alias("_tokens"))
    rows = rows.withColumn("_key", F.array_join("_tokens", " "))
    mined = mine_rules(rows.select(F.col(id_col).alias("page"), F.col("_tokens").alias("tokens")), labels, **mining)
    sets = rows.select(F.col("_key").alias("key"), F.col("_tokens").alias("tokens")).distinct()
    # Written, so that Spark can broadcast the hits by their size or split the pages of one token set.
    hits = stored(match_rules(sets, mined).select(F.col("key").alias("_hit"), F.col("rule_id").alias("mined_rule")), "hits")
    rows = rows.join(hits, rows["_key"] == hits["_hit"], "left").withColumn("_fixed", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_fixed.verdict"), F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise("allow"))
    return rows.select(id_col, "host", "path", F.col("_fixed.rule").alias("rule"), verdict.alias("verdict"), "mined_rule")
