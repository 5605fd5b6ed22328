import random
from collections import Counter

import numpy as np

from pinwatch.llm import url_filter
from pinwatch.llm.bloom import build_bloom


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:stop]


def judge(url, rules, listed=()):
    host, path = split(url)
    fits = []
    for verdict, rule in rules:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append(((len(h), len(rule)), rule, verdict))
    if fits:
        return host, path, *max(fits)[1:]
    return host, path, None, "block" if url in listed else "allow"


URLS = [
    None, "", "no scheme", "http://", "http:///path", "https://example.net", "https://example.net/", "https://EXAMPLE.net/en/x?q#f", "http://a.b.example.net/de/",
    "http://example.com/de/", "http://xexample.com/de/", "http://www.example.com/de", "ftp://z.example.org/fr/a", "http://org/fr/", "http://net/", "http://net?x/",
    "http://net#/", "http://a.net/\nb", "x://y://example.net/en/", "http://ÄB.example.org/fr/", "http://example.net./en/", "http://user@example.net/en/", "://example.net/en/1",
]


def test_stated_rules(spark):
    rows = [(i, u, "extra") for i, u in enumerate(URLS)] + [(3, URLS[7], "again"), (None, URLS[8], "no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").repartition(3)
    none = spark.createDataFrame([], "canonical string")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark), none).collect()
    want = Counter((r[0], *judge(r[1], url_filter.STATED_RULES)) for r in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want


def test_many_rules_and_listed_urls(spark):
    rng = random.Random(2)
    host = lambda: ".".join(rng.choices("abcd", k=rng.randrange(1, 4)))
    path = lambda: "/" + "".join(rng.choices("xy/", k=rng.randrange(0, 6)))
    rules = list({r: (rng.choice(["allow", "block"]), r) for r in (host() + path() for _ in range(300))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(2_000)]
    listed = [u for u in urls[:200]]
    canonical = spark.createDataFrame([(u, ) for u in listed], "url string").select(url_filter.canonical(__import__("pyspark").sql.functions.col("url")).alias("canonical"))
    names = {r.canonical for r in canonical.collect()}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark, rules), canonical).collect()
    form = {r.page_id: r.canonical for r in pages.select("page_id", url_filter.canonical(pages.url).alias("canonical")).collect()}
    for r in got:
        host_, path_, rule, verdict = judge(urls[r.page_id], rules)
        if rule is None and form[r.page_id] in names:
            verdict = "block"
        assert (r.host, r.path, r.rule, r.verdict) == (host_, path_, rule, verdict)
    assert len(got) == len(urls)


def test_odd_rules_fit_nothing(spark):
    rules = spark.createDataFrame([(None, None), ("block", "noslash"), ("block", "a.b/"), ("allow", "a.b/")], "verdict string, rule string")
    listed = spark.createDataFrame([(None,)], "canonical string")
    pages = spark.createDataFrame([(1, "http://noslash/"), (2, "http://x.a.b/c")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, listed).collect()}
    assert got == {1: (None, "allow"), 2: ("a.b/", "block")}
    assert url_filter.judge_urls(pages.filter("false"), rules, listed).count() == 0
    empty = rules.filter("false")
    assert {r.verdict for r in url_filter.judge_urls(pages, empty, listed).collect()} == {"allow"}


def test_the_filter_never_misses_a_key(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    table = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "hash long")
    for most in (1 << 20, 64, 1 << 10):  # a filter that is too small only lets more through
        bloom = build_bloom(table, most)
        assert bloom.words.nbytes <= max(most, 64) and bloom.may_hold(keys).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 50_000)
    assert build_bloom(table).may_hold(others).mean() < 0.02
    assert not build_bloom(table.filter("false")).may_hold(others).any()
