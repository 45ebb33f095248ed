import random
import re

from tileweave.llm import urls

SCHEMA = "page_id bigint, url string, html string"


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_rules_against_plain_loop(spark):
    rng = random.Random(1)
    pieces = ["http", "://", "example.com", "www.", "Net", ".net", "/en/", "/es/", "/fr/", "/", "?q=/en/", "#x", "com", ".", "a"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 7)))) for i in range(400)]
    rows += [(i + 1000, u) for i, u in enumerate(["https://WWW.Example.com/en/1", "http://x.example.com/en/", "http://example.com", "http://notexample.com/en/", "ftp://net/es/", "x://a.net/fr", None, "", "no", "http:///en/"])]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()}
    for i, u in rows:
        want = brute(u)
        assert got[i][:3] == want[:3], u
        assert got[i][3] == want[3] if want[3] else got[i][3] in ("allow", "block")


def test_segments(spark):
    paths = ["/en/123.html", "/en/123", "/", "", "/a/b/c/d/e/f", "/2024/01/deadbeef99/some-very-long-segment-of-a-path"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", urls.segments_of("path").alias("s")).collect()
    got = {r.path: r.s for r in rows}
    assert got["/en/123.html"] == ["en", "*.html"] and got["/en/123"] == ["en", "*"] and got["/"] == got[""] == []
    assert got["/a/b/c/d/e/f"] == ["a", "b", "c", "d", "**"] and got["/2024/01/deadbeef99/some-very-long-segment-of-a-path"] == ["*", "*", "*", "*"]


def test_templates_around_blocked_urls_are_rejected(spark):
    rules = (urls.Rule("bad.org", "/spam/offer", "block"), urls.Rule("good.org", "/news/1", "allow"))
    rows = [(i, f"http://bad.org/spam/offer{i}-x", "") for i in range(60)] + [(100 + i, f"http://bad.org/spam/thing{i}", "") for i in range(60)]
    rows += [(300 + i, f"http://good.org/news/{i}", "") for i in range(30)]
    got = {r.page_id: (r.verdict, r.template) for r in urls.judge(spark.createDataFrame(rows, SCHEMA), rules, reject=0.5).collect()}
    assert got[5][1] == got[105][1] == "/spam/+"
    assert {got[100 + i][0] for i in range(60)} == {"block"} and {got[300 + i][0] for i in range(30)} == {"allow"}


def test_edges(spark):
    assert urls.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "http://a.net/es/1", ""), (1, "http://a.net/es/1", ""), (None, None, None), (2, "http://a.org/" + "x/" * 20_000, "")]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'h' as host", "'s' as segments", "1 as n_urls", "'t' as template")
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in urls.judge(table).collect()), key=repr)
    assert got == sorted([(1, "a.net", "net/es/", "block")] * 2 + [(None, "", None, "allow"), (2, "a.org", None, "allow")], key=repr)


def test_blocked_hosts_reject_what_no_rule_labels(spark):
    rules = (urls.Rule("org", "/bad/", "block"), urls.Rule("org", "/worse/", "block"), urls.Rule("com", "/", "allow"))
    rows = [(f"http://h{h}.org/{s}/{i}", s) for h in range(5) for s in ("bad", "worse", "open") for i in range(30)]
    rows += [(f"http://g{h}.com/{s}/{i}", s) for h in range(5) for s in ("a", "b") for i in range(30)] + [(f"http://plain.info/x/{i}", "x") for i in range(30)]
    table = spark.createDataFrame([(i, u, "") for i, (u, _) in enumerate(rows)], SCHEMA)
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(table, rules).collect()}
    assert {got[i] for i, (_, s) in enumerate(rows) if s == "open"} == {(None, "block")}
    assert {got[i] for i, (_, s) in enumerate(rows) if s == "x"} == {(None, "allow")}


def test_many_other_segments_do_not_change_a_labelled_one(spark):
    rules = (urls.Rule("a.org", "/bad/", "block"), urls.Rule("a.org", "/good/", "allow"))
    for extra in (10, 60):
        rows = [f"http://a.org/bad/{i}" for i in range(40)] + [f"http://a.org/good/{i}" for i in range(40)] + [f"http://a.org/other{chr(97 + i // 26)}{chr(97 + i % 26)}/1" for i in range(extra)]
        got = urls.judge(spark.createDataFrame([(i, u, "") for i, u in enumerate(rows)], SCHEMA), rules, reject=0.8).collect()
        assert {r.template for r in got if r.path.startswith("/bad/")} == {"/bad/+"}
        assert {r.verdict for r in got if r.path.startswith("/other")} == {"allow"}
