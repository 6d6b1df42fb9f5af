"""Operator 11: texts against stated ones, templates against a plain count."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm import pages
from folioscope.llm.pagetree import Page
from folioscope.llm.q_pages import op11_html_extraction

SCHEMA = "page_id long, url string, html string, id long, key string, host int, text string, n_chars int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "k", 2, "t", 3) for i, u, h in rows], SCHEMA)


def text(html):
    return "\n".join(words for words, _ in pages.Reading(html).blocks())


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("plain  words\n here", "plain words here"),
        ("<p>a<p>b<div>c</div>d", "a\nb\nc\nd"),
        ("<article><h1>T &amp; U</h1><p><b>x<br><p>y &lt;b&gt; &#233;&nbsp;z</p></article><p>after</p>", "T & U\nx\ny <b> é z"),
        ("<nav><p>n</p></nav><header><h1>site</h1></header><main><p>m</p><aside>s</aside><form>f</form></main><footer>f</footer>", "m"),
        ("<article><header><h1>kept</h1><p>by me</p></header><p>t</p><div class='adBox ad'>buy</div><div id=comments><article class=comment>hi</article></div></article>", "kept\nt"),
        ("<script>var t='</p>';</script><style>p{}</style><p>a</p><!-- <p>no</p> --><noscript>js</noscript><p hidden>h</p><p style='display: none'>h</p>", "a"),
        ("<SCRIPT>x<p>y", ""),
        ("a < b and 3<4 <3 <p class=\"x>y\">c</p>", "a < b and 3<4 <3\nc"),
        ("<ul><li>one<li>two <i>too</i></ul><table><tr><td>x<td>y</table>", "one\ntwo too\nx\ny"),
        ("<div><a href=/>Home</a> <a href=/a>About</a></div><p>text with <a href=/>a link</a> in it</p>", "text with a link in it"),
        ("<div class=content-body><p>see</p><span class=ad>not</span><p>more</p></div>", "see\nmore"),
        ("<article>one</article><section class=related><article>teaser</article></section><article>two</article>", "one\ntwo"),
        ("<form id=aspnet><article>in a form</article><input></form>", "in a form"),
        ("</p></div>x</b>y<p", "xy"),
        ("<p>it's <a title='it\"s' href=x>so</a></p><p title=\"open>lost", "it's so\nlost"),
    ],
)
def test_texts(html, want):
    assert text(html) == want


def test_deep_and_long_pages():
    assert text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert text("<p>" + "word " * 200_000) == " ".join(["word"] * 200_000)


def site(n, box="<div class=box><p>Follow the site</p></div>"):
    rng = random.Random(n)
    own = [" ".join(rng.choice("abcdefgh") * rng.randint(2, 9) for _ in range(60)) for _ in range(n)]
    return own, [f"<body><div class=top><p>The Site</p></div><div class=c><p>{t}</p>{box}</div></body>" for t in own]


def test_what_recurs_on_a_host_goes(spark):
    own, html = site(12)
    alone = "<body><p>Follow the site</p><p>only here</p></body>"
    rows = [(i, f"https://U:p@Site.org:80/{i}", h) for i, h in enumerate(html)] + [(90, "http://other.org/", alone), (91, None, html[0]), (92, "nonsense", html[0])]
    got = {r["id"]: r for r in pages.extracted(frame(spark, rows).repartition(5)).collect()}
    assert [got[i]["text"] for i in range(12)] == own and all(got[i]["n_template"] == 2 for i in range(12))
    assert got[90]["text"] == "Follow the site\nonly here" and got[91]["text"] == got[92]["text"] == f"The Site\n{own[0]}\nFollow the site"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_copies_of_an_article_stay(spark):
    """Copies of a text on one host, on pages whose rest differs, aren't a template, nor are sentences that articles share."""
    own, _ = site(9)
    rows = [(i, f"http://h.org/{i}", f"<body><div class=x{i}><div class=menu-{i}>m{i}</div></div><div class=c><p>{own[0]}</p></div></body>") for i in range(6)]
    rows += [(10 + i, f"http://g.org/{i}", f"<article><p>{own[i]}</p><p>Shared.</p><ul><li>shared item</ul></article>") for i in range(9)]
    got = {r["id"]: r["text"] for r in pages.extracted(frame(spark, rows)).collect()}
    assert all(got[i] == own[0] for i in range(6)) and all(got[10 + i] == f"{own[i]}\nShared.\nshared item" for i in range(9))


def test_counts_against_brute_force(spark):
    """Subtrees by their surroundings, counted in plain Python."""
    rng = random.Random(7)
    parts = [f"<div class=b{i}><p>box {i}</p></div>" for i in range(5)]
    rows = []
    for i in range(60):
        host = rng.choice(["hot.org"] * 3 + ["a.org", "b.org"])
        inner = "".join(rng.sample(parts, rng.randint(0, 3)))
        rows.append((i, f"http://{host}/{i}", f"<body><p>text {i} {'w ' * 40}</p>{inner}<section>s {i % 7}{rng.choice(parts)}</section></body>"))
    rows += rows[:5]
    seen, hosts = {}, {}
    for i, u, h in set(rows):
        host = u.split("/")[2]
        hosts.setdefault(host, set()).add(h)
        for _, subtree, around in pages.Reading(h).subtrees():
            seen.setdefault((host, subtree), set()).add(around)
    want = set()
    for i, u, h in set(rows):
        host = u.split("/")[2]
        n = len(hosts[host])
        want |= {(i, k) for k, s, _ in pages.Reading(h).subtrees() if len(seen[host, s]) >= max(2, min(-(-n // 2), 3 + -(-n // 100)))}
    df = frame(spark, rows)
    keyed = pages._keyed(df, "page_id", "url", "html").select("id", "key").distinct()
    got = pages.templates(df, least=3).distinct().join(keyed, "key").select("id", "element").collect()
    assert {tuple(r) for r in got} == want and want


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "http://a.org/", "<p>x</p>"), (2, "http://a.org/", ""), (3, "http://a.org/1", "<p>y</p>"), (3, "http://a.org/1", "<p>y</p>"), (4, "http://a.org/2", "<p>\ud83d</p>".encode("utf-8", "replace").decode())]
    got = pages.extracted(frame(spark, rows)).collect()
    assert sorted((str(r["id"]), r["text"]) for r in got) == sorted([("1", ""), ("None", "x"), ("2", ""), ("3", "y"), ("3", "y"), ("4", "?")])
    assert pages.extracted(frame(spark, rows).limit(0)).count() == 0 and pages.templates(frame(spark, []).where("false")).count() == 0


def test_hashes_are_of_names_classes_and_words():
    made = [Page(h).hashes()[1] for h in ("<div class=a><p>x <b>y</b></p></div>", "<div  class='a'><p>x  <b>y</b></p></div>", "<div class=a style=''><p title=t>x <b>y</b></p></div>", "<div class=b><p>x <b>y</b></p></div>", "<div class=a><p>x <i>y</i></p></div>")]
    assert made[0] == made[1] == made[2] and len(set(made)) == 3


def test_query(spark):
    """Of these tables' pages: the article, block for block, by a plain pattern."""
    import re
    from html import unescape

    got = op11_html_extraction(spark, "/root/testdata/sf0.001")
    source = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = got.collect()
    assert {"page_id", "url", "text", "n_chars"} <= set(got.columns) and len(rows) == len(source)
    for r in rows:
        inner = re.search("(?s)<article>(.*)</article>", source[r["page_id"]]).group(1)
        parts = (" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])
    assert got.where(F.col("n_out") == 0).count() == 0
