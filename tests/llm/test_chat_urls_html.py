"""Chat formatting, URL filter and HTML extraction."""

import brute
import pytest
from pyspark.sql import functions as F

from vacanta.llm.chat import format_conversations, masked_texts, parse_turns
from vacanta.llm.html_text import Page, extract_text, main_text
from vacanta.llm.queries_urls import RULES
from vacanta.llm.urls import Rule, judge_urls, labelled_urls, train, train_from

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def formatted(spark, rows):
    out = format_conversations(spark.createDataFrame([(*r, "clash") for r in rows], TURNS))
    read = out.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"), masked_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r.conv_id: (r.formatted, [tuple(t) for t in r.turns], r.loss) for r in read.collect()}


def test_chat_merges_neighbours_and_reads_back(spark):
    out = formatted(spark, [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b\n### x: </turn>\\l"), (1, 3, "assistant", "d")])
    text, turns, loss = out[1]
    assert text.count("### user: ") == 1 and text.count("### assistant: ") == 1
    assert turns == [("user", "a"), ("user", "b\n### x: </turn>\\l"), ("assistant", "c"), ("assistant", "d")]
    assert loss == ["c", "d"]


def test_chat_awkward_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "x"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (2, 1, "a: b\n# <c>", "\\b\\l\\h\\c"),
        (3, 5, "assistant", "tie b"), (3, 5, "assistant", "tie a"), (4, 0, "assistant", "\U0001f600é" * 40_000),
    ]
    out = formatted(spark, rows)
    assert out[None][1] == [("", ""), ("user", "x")]
    assert out[2][1] == [("assistant", ""), ("assistant", ""), ("a: b\n# <c>", "\\b\\l\\h\\c")] and out[2][2] == ["", ""]
    assert out[3][2] == ["tie a", "tie b"]
    assert out[4][2] == ["\U0001f600é" * 40_000]
    assert formatted(spark, []) == {}


def test_chat_plan_is_native(spark):
    plan = format_conversations(spark.range(3).selectExpr("id conv_id", "id turn", "'user' role", "'x' text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_rule(host, path):
    best = max(((len(r.host + r.path), r) for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), default=None, key=lambda x: x[0])
    return (best[1].host + best[1].path, best[1].verdict) if best else (None, None)


def test_urls(spark):
    urls = [
        "http://Example.COM/en/x?y", "https://www.example.com/en/1", "http://a.www.example.com/en/", "http://x.net/fr/a#b", "http://net/es/", "http://x.net/EN/es/",
        "http://example.com", "http://example.com?x=/en/", "a://b://c/en/", "no scheme", "", None, "https://cheap-pills.example.org/de/1", "https://blog.thernd.example.org/de/1",
        "http://exampleXcom/en/", "http://notexample.com/en/", "http://ÄÖ.com/é", "http://x.net:80/fr/", "http://" + "a" * 50_000 + ".com/", "http://x.com/\n/en/",
    ]
    model = train_from(spark.createDataFrame(labelled_urls() + [(None, 1), ("x", None)], "url string, label int"))
    rows = judge_urls(spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls[:2])], "page_id long, url string, host string"), RULES, model).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        rest = (r.url or "").partition("://")[2] if "://" in (r.url or "") else ""
        host = rest
        for mark in "/?#":
            host = host.partition(mark)[0]
        path = rest[len(host) :]
        for mark in "?#":
            path = path.partition(mark)[0]
        host = host.translate(brute.LOWER)
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == (verdict or ("block" if r.block_score >= 0.5 else "allow"))
    by_url = {r.url: r for r in rows}
    assert by_url["https://cheap-pills.example.org/de/1"].verdict == "block"
    assert by_url["https://blog.thernd.example.org/de/1"].verdict == "allow"
    assert by_url[None].verdict == "allow" and by_url["no scheme"].host == ""


def test_url_ties_and_empty_tables(spark):
    rules = [Rule("a.com", "/x", "allow"), Rule("a.com", "/x", "block")]
    empty = train([])
    pages = spark.createDataFrame([("http://a.com/x",)], "url string")
    assert judge_urls(pages, rules, empty).first().verdict == "block"
    assert judge_urls(pages.limit(0), [], empty).count() == 0
    too_many = spark.range(10_001).selectExpr("cast(id as string) url", "1 label")
    with pytest.raises(ValueError):
        train_from(too_many)


def test_url_model_separates_unseen_hosts(spark):
    model = train_from(spark.createDataFrame(labelled_urls(), "url string, label int"))
    hosts = [("casino-royal.example.net", 1), ("pills-shop.example.com", 1), ("adult-films.example.org", 1), ("gardening.example.org", 0), ("physics.example.net", 0), ("my-notes.example.com", 0)]
    pages = spark.createDataFrame([(f"https://{h}/en/5", y) for h, y in hosts], "url string, y int")
    assert all((r.block_score >= 0.5) == bool(r.y) for r in judge_urls(pages, [], model).collect())


def test_url_model_allows_names_that_it_has_never_seen(spark):
    model = train_from(spark.createDataFrame(labelled_urls(), "url string, label int"))
    grams = lambda h: {h[i : i + 3] for i in range(len(h) - 2)}
    seen = set().union(*(grams(u.split("//")[1].split(".")[0]) for u, _ in labelled_urls()))
    hosts = [h for h in ("zyqwvkjx", "quoffjig", "xylovmur", "vexpwodg", "jukebrix", "gwyfozzk") if not grams(h) & seen]
    assert len(hosts) >= 4
    rows = judge_urls(spark.createDataFrame([(f"https://{h}.example.com/en/7",) for h in hosts], "url string"), [], model).collect()
    assert {r.verdict for r in rows} == {"allow"}


P1, P2, P3 = ("first " * 40).strip(), ("second " * 40).strip(), ("third " * 40).strip()


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("a < b <c", "a < b <c"),
        (f"<body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>T&amp;T</h1><p>{P1}<p>{P2}<br>x</article><footer>f</footer></body>", f"T&T {P1} {P2} x"),
        (f"<body><article><p>{P1}</p><aside>side</aside><section class='reader-comments'><p>{P2}</p></section><form>f</form></article></body>", P1),
        (f"<body><div id=sidebar><p>{P3}</p></div><div><div><p>{P1}</p></div><div><p>{P2}</p></div></div><div class='cookieNotice'>{P3}</div></body>", f"{P1} {P2}"),
        (f"<article><script>var a = '<p>{P3}</p>';</script><style>p{{}}</style><!-- <p>{P3}</p> --><p>{P1}</p>", P1),
        ("<article>one<b>two</b>three<p>four&nbsp;&nbsp;five\n\t six</p></article>", "onetwothree four five six"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul></article>", "a b c x y"),
        ("<article><p>open <b>bold<p>next</b> end</article> outside", "open bold next end"),
        ("<div class='menu-wrapper'><p>only text there is</p></div>", "only text there is"),
        ("<article>x<section class=comments>no</section>y</article>", "x y"),
        ("<article><p>unclosed comment <!-- gone", "unclosed comment"),
    ],
)
def test_main_text(source, text):
    assert main_text(source) == text


def test_html_long_deep_and_repeated_pages(spark):
    deep = "<div>" * 20_000 + "<p>inside</p>" + "</div>" * 20_000
    long = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    pages = spark.createDataFrame([(1, deep, "clash"), (1, deep, "clash"), (2, long, None), (3, None, None)], "page_id long, html string, text string")
    out = [(r.page_id, r.text) for r in extract_text(pages).collect()]
    assert sorted(out) == [(1, "inside"), (1, "inside"), (2, " ".join(["word"] * 30_000)), (3, "")]
    assert extract_text(pages.limit(0)).count() == 0


def test_density_prefers_text_over_links():
    page = Page(f"<body><div><a href=1>l l l l</a><a href=2>m m m m</a></div><div><p>{P1}</p><p>{P2}</p></div></body>")
    density, total = page.densities()
    first, second = (i for i, t in enumerate(page.tag) if t == "div")
    assert density[second] > density[first] and total[second] == max(total)
