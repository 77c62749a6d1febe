import random

import pandas as pd
import pytest

from tessera.llm import html_extract as he


def text(html, frame=()):
    return he.Page(html).text(frozenset(frame))


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><div class='ad'>Buy</div><article><h1>Head</h1><p><b>One<br><p>Two&copy; x\n y</p></article><footer>&copy; me</footer></body></html>", "Head\nOne\nTwo© x y"),
    ("<body><div id='header'>H</div><div class='site-menu'>M</div><div class='content'><p>A<p>B <i>c</i>d</div><div class='sidebar'>S</div><form>F</form><div id=comments><p>Nice!</p></div></body>", "A\nB cd"),
    ("<body><header>Site</header><main><article><header><h1>Title</h1></header><p>Body</p><aside>Note</aside><section class='comments'><p>c</p></section></article></main></body>", "Title\nBody"),
    ("<article><p>a &lt;b&gt; &#65;&#x42; &nbsp; &unknown; &am</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "a <b> AB &unknown; &am\nx\ny\n1\n2"),
    ("<article><p>cut off in the mid", "cut off in the mid"), ("<article><p>quote <a title=\"x>y</a> z</p></article>", "quote y z"), ("<article><p>1 < 2 and <3</p><!-- <p>no</p> --></article>", "1 < 2 and <3"),
    ("<article><p>a<span class='advert'>ad</span>b <button>Go</button></p></article>", "ab"), ("<div>x</div><script>if (a<b) {}", "x"), ("<article><pre>k\n  v</pre>tail</article>", "k v\ntail"),
    ("<form id='aspnet'><nav>m</nav><input><main><p>lead</p><article><p>in a form</p></article></main><p>field</p></form>", "lead\nin a form"), ("<form><label>L</label>no</form><p>yes</p>", "yes"),
    ("<body><div hidden>no</div><p>yes</p><div role='navigation'>no</div></body>", "yes"), ("<textarea><p>no</p></textarea><p>yes", "yes"), ("<article></article><p>only this</p>", "only this"),
])
def test_pages(html, want):
    assert text(html) == want


def brute_frames(pages):
    """Importance by the definition, over plain dictionaries."""
    by_host = {}
    for host, html in pages:
        by_host.setdefault(host, []).append(he.Page(html))
    out = {}
    import math

    for host, parsed in by_host.items():
        rows = []
        for path in {p for page in parsed for p in page.nodes}:
            having = [page for page in parsed if path in page.nodes]
            m = len(having)
            if m < he.MIN_PAGES or m < he.MIN_SHARE * len(parsed):
                continue
            looks, contents = {}, {}
            for page in having:
                k = "|".join(sorted(page.nodes[path][1]))
                looks[k] = looks.get(k, 0) + 1
            for page in parsed:
                for t in {b[3] for b in page.blocks if b[0] == path}:
                    contents[t] = contents.get(t, 0) + 1
            look = -sum(n / m * math.log(n / m, m) for n in looks.values())
            total = sum(contents.values())
            content = 1 - sum(n * math.log(n, m) for n in contents.values()) / total if total else None
            rows.append((path, having[0].nodes[path][0], look, content))
        if rows and (found := he.composite(pd.DataFrame(rows, columns=["path", "parent", "looks", "contents"]))):
            out[host] = set(found)
    return out


def site(rng, n):
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        paragraphs = "".join(f"<p>{' '.join(rng.choices(words, k=30))}</p>" for _ in range(rng.randint(2, 5)))
        out.append(f"<body><div class='k7'><span>Subscribe to our letter today</span></div><div class='b1'>{paragraphs}</div><div class='z'>All rights kept</div></body>")
    return out


def test_frames_are_learned_from_the_site(spark):
    rng = random.Random(2)
    pages = [("http://a.example/x", h) for h in site(rng, 40)] + [("https://user@B.example:80/y", h) for h in site(rng, 12)] + [("http://lone.example/", site(rng, 1)[0]), (None, None), ("mailto:x", "<p>odd</p>")]
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)] + [(None, "http://a.example/", pages[0][1])] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS frame", "1 AS salt", "2 AS text")
    got = he.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.url and ("a.example" in r.url or "B.example" in r.url):
            assert "Subscribe" not in r.text and "rights" not in r.text and r.text.count("\n") >= 1
    by_id = {r.page_id: r for r in got}
    assert "Subscribe" in by_id[52].text and by_id[53].text == "" and by_id[54].text == "odd"
    hosts = [("a.example", h) for u, h in pages[:40]] + [("b.example", h) for u, h in pages[40:52]]
    model = spark.createDataFrame(hosts, "host string, html string")
    assert {r.host: set(r.frame) for r in he.frames(model).collect() if r.frame} == brute_frames(hosts)
    assert he.extract(df.limit(0)).count() == 0


def test_article_text_stays_though_it_repeats(spark):
    page = "<body><nav>m</nav><article><p>Same text on every page of the site</p></article></body>"
    df = spark.createDataFrame([(i, "http://h.example/", page) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in he.extract(df).collect()} == {"Same text on every page of the site"}


def test_the_tree_decides_inside_the_article(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    heads = [say(3) for _ in range(6)]
    bodies = [[(rng.choice(heads), say(30)) for _ in range(3)] for _ in range(50)]
    page = lambda parts: "<article>" + "".join(f"<h2>{h}</h2><p>{p}</p>" for h, p in parts) + "<div class='q9'><span>Members read two more for free</span></div></article>"
    rows = [(i, "https://n.example/a", page(parts)) for i, parts in enumerate(bodies)] + [(90, "https://one.example/", page(bodies[0]))]
    rows += [(100 + i, "https://copies.example/", page(bodies[1])) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in he.extract(df).collect()}
    for i, parts in enumerate(bodies):  # headings that recur are text; what every page says is not
        assert got[i] == "\n".join(x for part in parts for x in part)
        assert text(rows[i][2]) == got[i] + "\nMembers read two more for free"
    assert got[90].endswith("for free")  # one page tells nothing
    assert all("w" in got[100 + i] and got[100 + i].endswith("for free") for i in range(20))  # nor do copies of one
    long = "<article>" + "<p>" + "very long text " * 200_000 + "</p></article>"
    assert he.extract(spark.createDataFrame([(1, "http://l.example/", long)], df.schema)).first().n_chars == 3_000_000 - 1


def test_hosts_hot_and_cold_are_extracted_alike(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "http://a.example/", h) for i, h in enumerate(site(rng, 40))] + [(100 + i, f"http://h{i % 3}.example/", h) for i, h in enumerate(site(rng, 30))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(tuple(r) for r in he.extract(df).collect())
    monkeypatch.setattr(he, "HOT_SHARE", 0.5)
    assert sorted(tuple(r) for r in he.extract(df).collect()) == want
    monkeypatch.setattr(he, "HOT_SHARE", 1.0)
    assert sorted(tuple(r) for r in he.extract(df).collect()) == want
