"""URL rules: fixed rules and token rules against plain computations."""

import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tracelake.llm.queries import URL_RULES, op6_url_rules
from tracelake.llm.url_rules import host_of, judge_urls, match_rules, mine_rules, path_of, url_tokens

LOWER = {c: c + 32 for c in range(65, 91)}


def split(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def fixed(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith(f".{r.host}")) and path.startswith(f"/{r.path}")]
    return max(fits, key=lambda r: len(r.text), default=None)


def mined(rows, *, min_count=10, max_tokens=3, min_lift=1.5, min_confidence=0.5, min_z=4.0):
    """token set -> confidence, by trying every set of at most ``max_tokens`` tokens; rows: (tokens, bad).

    Of tokens that stand in the same rows the least speaks for all, and tokens of all rows say nothing.
    """
    n, share = len(rows), sum(bad for _, bad in rows) / len(rows)
    where = {}
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            where.setdefault(t, set()).add(i)
    speakers = {}
    for t in sorted(where):
        if len(where[t]) < n:
            speakers.setdefault(frozenset(where[t]), t)
    both, alone = {}, {}
    for tokens, bad in rows:
        for k in range(1, max_tokens + 1):
            for s in combinations(sorted(set(tokens) & set(speakers.values())), k):
                alone[s] = alone.get(s, 0) + 1
                both[s] = both.get(s, 0) + bad
    found = {}
    for s, m in alone.items():
        c = both[s] / m
        if both[s] >= min_count and c - share >= min_z * (share * (1 - share) / m) ** 0.5 and (c / share >= min_lift or c >= min_confidence):
            found[s] = c
    return {s: c for s, c in found.items() if not any(set(o) < set(s) for o in found)}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(400):
        bad = i % 5 == 0
        host = f"{'spam' if bad and i % 10 else 'news'}{i % 3}.example.net"
        rows.append((i, f"https://{host}/{'casino/win' if bad and i % 3 else 'articles/list'}/{i}", bad))
    return spark.createDataFrame(rows, "page bigint, url string, bad boolean")


def test_mining_equals_all_sets(labelled):
    pages = labelled.select("page", url_tokens(F.col("url")).alias("tokens"))
    got = {tuple(r.tokens): r.confidence for r in mine_rules(pages, labelled.select("page", "bad"), min_count=10).collect()}
    want = mined([(r.tokens, r.bad) for r in pages.join(labelled, "page").collect()], min_count=10)
    assert got.keys() == want.keys() and got
    assert all(got[s] == pytest.approx(want[s]) for s in got)


def test_whole_query_on_planted_labels(spark, tmp_path):
    """Tables in which hosts and words of paths say what is bad: the mined verdicts are those of all token sets tried out."""
    rows = []
    for i in range(1500):
        kind = i % 7
        host = ("casino-win.net", "news.net", "blog.net", "ads-track.net", "shop.net", "spam-farm.net", "wiki.net")[kind]
        rows.append((i, f"https://www{i % 3}.{host}/{'buy/now' if i % 11 == 0 else 'page'}/{i}", kind in (0, 3, 5) and i % 10 != 9 or i % 11 == 0))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id bigint, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 0 if bad else 1, 0) for i, _, bad in rows if i % 2], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tokens = {r.page_id: r.t for r in pages.select("page_id", url_tokens(F.col("url")).alias("t")).collect()}
    rules = mined([(tokens[i], bad) for i, _, bad in rows if i % 2])
    got = {r.page_id: r for r in op6_url_rules(spark, str(tmp_path)).collect()}
    assert got.keys() == tokens.keys() and len(rules) > 3
    for i, url, _ in rows:
        assert got[i].verdict == ("block" if fixed(*split(url)) is None and any(set(s) <= set(tokens[i]) for s in rules) else (fixed(*split(url)).verdict if fixed(*split(url)) else "allow"))
    right = sum((got[i].verdict == "block") == bad for i, _, bad in rows if not i % 2)
    assert right > 0.85 * 750


def test_url_families_are_cheap(spark):
    """A family whose URLs share thirty tokens has one rule, not one for each of their subsets."""
    path = "/".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(30))
    rows = [(i, f"http://family.net/{path}/{i}" if i < 60 else f"http://host{i % 5}.net/p/{i}", i < 60) for i in range(400)]
    df = spark.createDataFrame(rows, "page bigint, url string, bad boolean")
    found = mine_rules(df.select("page", url_tokens(F.col("url")).alias("tokens")), df.select("page", "bad")).collect()
    assert len(found) == 1 and found[0].support == 60 and found[0].confidence == 1.0


def test_matching_needs_all_tokens(spark):
    rules = spark.createDataFrame([(1, ["a"], 0.7), (2, ["a", "b"], 0.9), (3, ["c", "d"], 0.95)], "rule_id bigint, tokens array<string>, confidence double")
    sets = spark.createDataFrame([("x", ["a", "b", "c"]), ("y", ["a"]), ("z", ["d"]), ("e", [])], "key string, tokens array<string>")
    assert {r.key: r.rule_id for r in match_rules(sets, rules).collect()} == {"x": 2, "y": 1}


def test_query(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    rows = op6_url_rules(spark, sf_dir).collect()
    assert {r.page_id for r in rows} == urls.keys() and len(rows) == len(urls)
    for r in rows:
        host, path = split(urls[r.page_id])
        rule = fixed(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None)
        assert r.verdict == (rule.verdict if rule else "block" if r.mined_rule is not None else "allow")


CASES = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG", "http://example.org/es/x", "http://example.org/es", "http://a.example.org/en/12?q", "http://org/", "http://notorg/", "http://x.org#f/",
    "https://shop.com/fr/a", "https://shop.com/de/a", "https://shop.com/de", "ftp://[::1]/a://b", "a://b://c/d", "x\ny://h.com/de/\nz", "http://ÄB.com/de/", "://com/fr/",
]


def test_fixed_rules(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "page_id bigint, url string")
    labels = spark.createDataFrame([], "page bigint, bad boolean")
    got = {r.page_id: r for r in judge_urls(df, labels, URL_RULES).collect()}
    for i, url in enumerate(CASES):
        host, path = split(url)
        rule = fixed(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule.text if rule else None, rule.verdict if rule else "allow")
    parts = df.select("page_id", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).collect()
    assert all((r.h, r.p) == split(CASES[r.page_id]) for r in parts)


def test_messy(spark, labelled):
    rows = [(1, None, 1, "r"), (1, None, 1, "r"), (None, "http://spam1.example.net/casino/win/5", 2, "r"), (2, "http://spam1.example.net/casino/win/5", 3, "r"), (2, "http://spam1.example.net/casino/win/5", 3, "r"), (3, "http://h/" + "a/" * 20_000, 4, "r")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule_id int, rule string").unionByName(labelled.select((F.col("page") + 100).alias("page_id"), "url"), allowMissingColumns=True)
    labels = labelled.select((F.col("page") + 100).alias("page"), "bad").unionByName(spark.createDataFrame([(None, True), (100, None), (999_999, True)], "page bigint, bad boolean"))
    got = judge_urls(pages, labels, URL_RULES, min_count=10)
    assert got.count() == pages.count()
    assert {r.verdict for r in got.where("page_id = 2 or page_id is null").collect()} == {"block"}
    assert {r.verdict for r in got.where("page_id = 1").collect()} == {"allow"}
    assert judge_urls(pages.limit(0), labels, URL_RULES).count() == 0
