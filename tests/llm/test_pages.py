import html
import random
import re

import numpy as np

from tileweave.llm import pages

SCHEMA = "page_id bigint, url string, html string"
HEAD = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>'


def page(body, nav="<nav><ul><li>menu</li></ul></nav>", foot="<footer>&copy; foot</footer>"):
    return f'{HEAD}{nav}<div class="ad">buy</div><article>{body}</article>{foot}</body></html>'


def test_structure():
    cut = pages.blocks_of
    assert cut(page("<h1>A &amp; B</h1><p>one\n two<br>three</p><p>&lt;four&gt;&nbsp;five<p>six")) == ["A & B", "one two three", "<four> five", "six"]
    assert cut(page("<header><h2>Title</h2><p>by me</p></header><p>x</p><aside>y</aside><form>z</form><div id='comments'>c</div>")) == ["Title", "x"]
    assert cut("<body><div class='cookie-notice'>c</div><p>plain body</p><section class=comments><article>no</article></section>") == ["plain body"]
    assert cut("<nav>open<article><p>text</article>") == ["text"]
    assert cut('<p title="a>b">in</p><!-- <p>not</p> --><p>out') == ["in", "out"]
    assert cut("") == cut(None) == cut("<p>  </p>") == [] and cut("no tags") == ["no tags"]
    assert cut("<p>a</p><div hidden>b</div><p style='display: none'>c</p><p>d <a href='x") == ["a", "d"]


def test_given_pages_by_their_own_structure(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r.text for r in pages.extract_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def brute(streams, depth, share, least):
    different = sorted({tuple(s) for s in streams})
    seen = {}
    for k, s in enumerate(different):
        for p in range(len(s) - depth + 1):
            seen.setdefault(s[p : p + depth], set()).add(k)
    limit = max(least, share * len(different))
    out = []
    for s in streams:
        flags = [False] * len(s)
        for p in range(len(s) - depth + 1):
            if len(seen[tuple(s[p : p + depth])]) >= limit:
                flags[p : p + depth] = [True] * depth
        out.append(flags)
    return out


def test_names_do_not_cut_articles():
    cut = pages.blocks_of
    assert cut(page('<p class="share-price">up</p><section id="notice-of-meeting">now</section><div class="related-work">see</div><p class="share">tweet</p><div id="comments">c</div>')) == ["up", "now", "see"]
    assert cut('<body><p>outside</p><article class="post widget"><p>inside</p></article>') == ["inside"]
    assert cut('<main><article><p>the long story</p></article><article><p>teaser</p></article></main>') == ["the long story"]
    assert cut('<article><p>lead</p><article><p>quoted</p></article><p>rest</p></article>') == ["lead", "quoted", "rest"]
    assert cut('<article></article><main><p>body</p></main>') == ["body"]


def test_suffix_ranks_order_suffixes():
    rng = np.random.default_rng(1)
    for depth in (1, 2, 3, 7, 16):
        joined = rng.integers(0, 3, 120)
        joined[60:90] = joined[:30]
        rank = pages.suffix_ranks(joined, depth)
        heads = [tuple(joined[i : i + depth]) for i in range(120)]
        order = {h: k for k, h in enumerate(sorted(set(heads)))}
        assert rank.tolist() == [order[h] for h in heads]


def test_live_path_against_all_substrings(spark):
    """Substrings of 16 tokens and more on pages of one host, in one shard and in many."""
    rng = random.Random(7)
    notices = [[f"n{k}x{i}" for i in range(n)] for k, n in enumerate((15, 16, 17, 40))]
    streams = []
    for i in range(60):
        s = [f"u{i}x{j}" for j in range(rng.randint(60, 90))]
        for notice in notices:
            if rng.random() < 0.4:
                at = rng.randint(0, len(s))
                s[at:at] = notice[: rng.choice([len(notice), len(notice), 20])]
        streams.append(s)
    want = [" ".join(t for t, gone in zip(s, flags) if not gone) for s, flags in zip(streams, brute([tuple(s) for s in streams], pages.DEPTH, pages.SHARE, pages.LEAST))]
    assert sum(len(w.split()) for w in want) < 0.9 * sum(map(len, streams))
    for pad in ("", "<!--" + "x" * 200_000 + "-->"):
        rows = [(i, f"http://a.org/{i}", page(f"<p>{' '.join(s)}</p>") + pad) for i, s in enumerate(streams)]
        got = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert [got[i] for i in range(60)] == want


def test_host_boilerplate_goes_and_copies_stay(spark):
    rng = random.Random(2)
    notice = " ".join(f"notice{k}" for k in range(20))
    word = lambda n: " ".join("%x" % rng.getrandbits(40) for _ in range(n))
    bodies = [word(60) for _ in range(30)]
    rows = [(i, f"http://a.org/{i}", page(f"<p>{b}</p><p>{notice}</p>")) for i, b in enumerate(bodies)]
    copied = word(50)
    rows += [(100 + i, f"http://b.org/{i}", page(f"<p>{copied} {word(1)}</p>")) for i in range(20)]
    rows += [(200, None, page("<p>q</p>")), (201, "no-scheme", None), (201, "no-scheme", None), (None, "http://A.org", "<p>z</p>"), (202, "http://c.org", page("<p>" + "long " * 50_000 + "</p>"))]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as host", "'y' as blocks", "'z' as cell")
    got = {}
    for r in pages.extract_text(table).collect():
        got[r.page_id] = r.text
        assert r.n_chars == len(r.text)
    assert all(got[i] == b for i, b in enumerate(bodies))
    assert all(got[100 + i].startswith(copied) for i in range(20))
    assert got[200] == "q" and got[201] == "" and got[None] == "z" and got[202] == " ".join(["long"] * 50_000)
    assert pages.extract_text(table).count() == len(rows)
    assert pages.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_page_of_repeats_stays():
    assert pages.unique_text(["a b", "c"], np.array([True, True, False])) == "a b\nc"
    assert pages.unique_text(["a b", "c d"], np.array([True, False, False, False])) == "b\nc d"


def test_shards_of_a_host_count_together(spark):
    rng = random.Random(3)
    notice = " ".join(f"notice{k}" for k in range(20))
    word = lambda n: " ".join("%x" % rng.getrandbits(40) for _ in range(n))
    bodies = [word(60) for _ in range(19)] + [word(12)]
    rows = [(i, f"http://a.org/{i}", page(f"<p>{b}</p><p>{notice}</p>")) for i, b in enumerate(bodies)]
    rows.append((20, "http://a.org/20", page("<p>q</p>") + "<!--" + "x" * 40_000_000 + "-->"))
    got = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == dict(enumerate([*bodies, "q"]))
