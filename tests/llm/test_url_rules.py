"""URL rules against regular expressions run on every URL."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import url_rules
from tallyframe.llm.url_rules import pattern_rule, site_rule

RULES = [
    site_rule("net/", "block"), site_rule("example.net/en/", "allow"),
    site_rule("example.com/de/", "block"), site_rule("org/fr/", "allow"), site_rule("org/", "block"),
    pattern_rule("^pills^", "block", "host"), pattern_rule("||shop.*/cart|", "block"),
    pattern_rule("/ads/*.gif^", "block"), pattern_rule("ad*vert", "block"),
    pattern_rule("^same^", "block"), pattern_rule("^same^", "allow"), pattern_rule(".", "allow", "host"),
    pattern_rule("|a.b", "block"), pattern_rule("münchen^", "block"),
]

URLS = [
    "http://A.Net/x", "http://a.net", "https://example.net/en/", "https://www.example.net/en/1?q#f",
    "https://example.net/EN/1", "http://badexample.com/de/1", "http://x.example.com/de/1",
    "http://x.org/fr/", "http://x.org/frr/", "http://org/fr/", "http://x.org?/fr/", "http://cheap-pills.test/",
    "http://pillsbury.test/", "http://a.test/pills", "http://my.shop.de/cart", "http://my.shop.de/cart/",
    "http://h.test/ads/1/2.gif?x", "http://h.test/ads/1/2.gifs", "http://h.test/adxyzvertising",
    "http://h.test/same", "http://h/same", "http://a.b", "http://ca.b", "http://x/münchen/y", "http://x/xmünchen/y",
    None, "", "no scheme", "://", "http://", "mailto:a@b.net/", "x://u:p@h.net:80/", "x://h.net/?u=http://y.org/fr/",
    "x://h\n.net/a\nb", "x://" + "very/long/" * 20_000 + "same",
]


def plain(url, rules):
    """Host, path, and the best of all rules that fit, each run on the URL."""
    at = (url or "").find("://")
    behind = (url or "")[at + 3 :] if at >= 0 else ""
    host = re.match("[^/?#]*", behind).group()
    tail = behind[len(host) :]
    path = re.match("[^?#]*", tail).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, pattern, action, scope, tier in rules:
        if tier == 1:
            name, prefix = rule.split("/", 1)
            fits = (host == name or host.endswith("." + name)) and path.startswith("/" + prefix)
        else:
            text = re.escape(pattern.strip("|")).replace(r"\*", "(?s:.)*").replace(r"\^", "(\\A|\\Z|[^A-Za-z0-9])")
            text = ("\\A([^/?#]*[.])?" if pattern.startswith("||") else "\\A" if pattern.startswith("|") else "") + text
            fits = re.search(text + ("\\Z" if pattern.endswith("|") else ""), host if scope == "host" else host + tail)
        if fits:
            found = (-tier, -len(pattern), action != "allow", rule), (rule, action, tier)
            best = min(best, found) if best else found
    return (host, path) + (best[1] if best else (None, None, None))


def frame(spark, urls):
    rows = [(i, url, "html", 1) for i, url in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, tier int")
    return df.selectExpr("*", "'x' AS host", "'y' AS k", "'z' AS u")


def judged(spark, urls, rules, parts=3):
    table = spark.createDataFrame(rules, url_rules.RULES)
    rows = url_rules.judge(frame(spark, urls).repartition(parts), table).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.action, r.tier) for r in rows}


@pytest.fixture(params=["shipped", "joined"])
def way(request, monkeypatch):
    if request.param == "joined":
        monkeypatch.setattr(url_rules, "SHIPPED_BYTES", -1)
    return request.param


def test_best_rule_is_that_of_all_rules(spark, way):
    assert judged(spark, URLS, RULES) == {i: plain(u, RULES) for i, u in enumerate(URLS)}


def test_repeated_urls_null_keys_no_urls_and_no_rules(spark, way):
    rules = spark.createDataFrame(RULES + RULES + [(None,) * 5], url_rules.RULES)
    df = spark.createDataFrame([(1, "x://a.net/"), (1, "x://a.net/"), (None, "x://a.net/"), (None, None)], "page_id bigint, url string")
    rows = url_rules.judge(df, rules).collect()
    assert sorted((r.page_id or 0, r.rule or "") for r in rows) == [(0, ""), (0, "net/"), (1, "net/"), (1, "net/")]
    assert url_rules.judge(df.limit(0), rules).collect() == []
    assert {r.rule for r in url_rules.judge(df, rules.limit(0)).collect()} == {None}


def test_rules_are_listed_under_their_rarest_token(spark):
    urls = frame(spark, ["x://a.example.com/en/1", "x://b.example.com/de/", "x://c.example.net/en/"])
    rules = spark.createDataFrame(RULES[:4] + [pattern_rule("||*example*", "block")], url_rules.RULES)
    found = {r.rule: r.token for r in url_rules.index_rules(url_rules._prepared(urls, "page_id"), rules).collect()}
    assert found == {
        "net/": "net", "example.net/en/": "net", "example.com/de/": "de", "org/fr/": "org", "||*example*": None,
    }


PIECES = st.lists(st.sampled_from(["a", "b1", ".", "/", "-", "*", "^", "?", "é"]), min_size=1, max_size=6)


@settings(max_examples=500, deadline=None)
@given(PIECES, PIECES, st.sampled_from(["", "|", "||"]), st.sampled_from(["", "|"]))
def test_a_fitting_url_holds_all_literal_tokens(pattern, url, start, end):
    pattern = start + "".join(pattern) + end
    url = "".join(url).replace("*", "a").replace("^", "")
    if re.search(url_rules.expression(pattern), url):
        assert set(url_rules.literal_tokens(pattern)) <= set(re.findall(url_rules.TOKEN, url))
