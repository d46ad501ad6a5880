from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sluice.llm.queries import URL_RULES
from sluice.llm.urls import END, ORDER, START, judge

SCHEMA = "page_id long, url string, html string, host string, score string"


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "h", "s") for i, u in enumerate(urls)], SCHEMA)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def rule_of(host, path):
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def corpus():
    good = [f"https://www.garden{i}.com/plants/rose{i}" for i in range(60)]
    bad = [f"http://win.casino{i}.net/es/jackpot{i}" for i in range(60)]
    open_ = [f"https://garden{i}.org/plants/rose{i}" for i in range(9)] + [f"http://casino{i}.org/jackpot{i}" for i in range(9)]
    odd = [None, "", "no scheme", "HTTP://EXAMPLE.com/EN/", "https://x.EXAMPLE.com/en/a?b://c", "a://www.example.com/en/", "a://example.com/en", "://", "x://com?q", "x://notcom/", "m://é.net/fr/ü#x", "https://garden1.org/plants/rose1"]
    return good + bad + open_ + odd


def test_hosts_paths_and_rules(spark):
    urls = corpus()
    got = {r.page_id: r for r in judge(frame(spark, urls), URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = parts(url)
        rule = rule_of(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name), url
        if rule:
            assert got[i].verdict == ("allow" if rule.allow else "block")


def test_the_method_judges_the_rest_like_its_classes(spark):
    urls = corpus()
    got = {r.page_id: r.verdict for r in judge(frame(spark, urls), URL_RULES).collect()}
    assert [got[i] for i in range(120, 129)] == ["allow"] * 9
    assert [got[i] for i in range(129, 138)] == ["block"] * 9


def test_scores_against_a_plain_model(spark):
    urls = corpus()
    frame_ = frame(spark, urls)
    held = {r.url for r in frame_.where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0).select("url").collect()}

    def grams(url):
        text = START * ORDER + (parts(url)[0] + url.split("://", 1)[1][len(parts(url)[0]) :]) + END
        return [text[i : i + ORDER + 1] for i in range(len(text) - ORDER)]

    counts = {True: Counter(), False: Counter()}
    for u in urls:
        rule = rule_of(*parts(u))
        if rule and u not in held:
            for g in grams(u):
                for k in range(ORDER + 1):
                    counts[rule.allow][g[ORDER - k :]] += 1
    follow = {c: defaultdict(list) for c in counts}
    for c in counts:
        for g, n in counts[c].items():
            follow[c][g[:-1]].append(n)

    def chance(c, g):
        p = 1 / 256
        for k in range(ORDER + 1):
            tail = g[ORDER - k :]
            seen = follow[c].get(tail[:-1])
            if seen:
                p = (counts[c][tail] + len(seen) * p) / (sum(seen) + len(seen))
        return p

    for r in judge(frame_, URL_RULES).collect():
        url = urls[r.page_id]
        if url and "://" in url and parts(url)[0]:
            odds = [math.log(chance(True, g) / chance(False, g)) for g in grams(url)]
            assert abs(r.score - sum(odds) / len(odds)) < 1e-9


def test_one_class_only_and_empty_table(spark):
    got = judge(frame(spark, ["https://a.com/x", "https://b.org/y"]), URL_RULES).collect()
    assert {r.verdict for r in got} == {"allow"}
    assert judge(frame(spark, []), URL_RULES).collect() == []
