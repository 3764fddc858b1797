from __future__ import annotations

import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

from hexaloom.llm.html import _digest, extract_text, main_text, site_style_tree


def test_main_text_of_one_page():
    page = """<html><head><title>x</title></head><body class="home page"><header><h2>Site</h2></header><div class="cookie-notice">We use</div>
    <main><article class="post ad-free"><header><h1>Title &amp; x&nbsp;y &#233;</h1></header><p>One <b>two<br>three</p><p>a<p>b</b><ul><li>i<li>j</ul>
    <div class="share">s</div><section id="comments"><article>c1</article></section><table><tr><td>1<td>2</table>tail</article></main>
    <aside>q</aside><form>f</form><script>var t="</p>";</script><!-- no --><footer>F</footer></body></html>"""
    assert main_text(page) == "Title & x y é\nOne two three\na\nb\ni\nj\n1\n2\ntail"
    assert main_text("<div>plain<p>x</p></div><div class='sidebar'>no</div><p hidden>no</p>") == "plain\nx"
    assert main_text("no tags &lt;b&gt;") == "no tags <b>" and main_text("") == "" and main_text(None) == "" and main_text("<") == "<"
    assert main_text("<p>" * 5000 + "deep") == "deep" and main_text("<div>" * 5000 + "deep") == "deep"


def test_odd_markup():
    cases = {
        "<!-->x<p>y": "x\ny", "<a title=\"z>q</a>r": "qr", "a < b <": "a < b <", "<p class='nav'>n<p>m": "m", "<script>if(a<b)</scriptx>1</script >t": "t", "<title>&amp;<b></title>u": "u", "<!-- a --!>v": "v",
        "<p/>w": "w", "</p>x": "x", "<textarea><p>no</textarea>yes": "yes", "<DIV CLASS=ad>n</DIV>o": "o", "<?x?>z": "z", "<script>never ends": "", "<p hidden>n</p><p class='hidden-xs'>y": "y", "<!-- never ends": "",
        "<i>a</i><i>b</i> <i>c": "ab c", "a&nbsp;&#x41;&lt;p&gt;": "a A<p>", "<ol><li>1<ol><li>2</ol><li>3</ol>": "1\n2\n3", "<p style='color:red;display: none'>n</p>y": "y",
    }
    for page, text in cases.items():
        assert main_text(page) == text, page


def test_branches_alike_on_a_host_go(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        body = "".join(f"<p>{rng.random()} words</p>" for _ in range(rng.randint(1, 5)))
        host = "a.com" if i < 20 else "b.com"
        plain = "<div><div>Always the same line</div></div>" if host == "a.com" else f"<div><div>{rng.random()}</div></div>"
        rows.append((i, f"http://{host}/{i}", f"<body>{plain}<section>{body}</section></body>", "t"))
    rows += [(40, None, None, "t"), (41, "http://a.com/x", "", "t"), (42, "http://c.com/x", "<p>Always the same line</p>", "t")]
    rows += [(50 + i, "http://d.com/", "<article><h1>Copy</h1><p>of one page</p></article>", "t") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, N_CHARS string")
    dull = {r.host: len(r.dull) for r in site_style_tree(pages).collect()}
    assert dull["a.com"] >= 1 and "b.com" not in dull
    got = {r.page_id: r for r in extract_text(pages).collect()}
    assert all("Always" not in got[i].text and got[i].text for i in range(20))
    assert all(len(got[i].text.split("\n")) >= 2 for i in range(20, 40))
    assert (got[40].text, got[40].n_chars, got[41].text, got[42].text) == ("", 0, "", "Always the same line")
    assert all(got[50 + i].text == "Copy\nof one page" and got[50 + i].n_chars == 16 for i in range(12))
    assert extract_text(pages.limit(0)).count() == 0


def tree(html):
    """(tag and class, children) of simple whole markup, by the standard library's parser."""
    root = ("", [])
    stack = [root]

    class P(HTMLParser):
        def handle_starttag(self, tag, attrs):
            node = (".".join([tag, *sorted(w for w in dict(attrs).get("class", "").split() if w.isalpha())]), [])
            stack[-1][1].append(node)
            stack.append(node)

        def handle_endtag(self, tag):
            stack.pop()

        def handle_data(self, data):
            stack[-1][1].append(data)

    P().feed(html)
    return root


def text_of(node):
    return " ".join(" ".join(c.split()) if isinstance(c, str) else text_of(c) for c in node[1])


def brute_dull(pages, least, importance):
    """{site: paths of low importance}, from lists of all that is seen at each path."""
    distinct = {}
    for host, html in pages:
        article = next(iter(re.findall("<article>(.*?)</article>", html)), html)
        distinct.setdefault(host, {}).setdefault(article, html)
    seen = {}
    for host, of in distinct.items():
        for html in of.values():
            met = {}

            def walk(node, path, met=met):
                for c in node[1]:
                    if not isinstance(c, str):
                        below = f"{path}/{c[0]}"
                        shape = " ".join(d[0] for d in c[1] if not isinstance(d, str))
                        m = met.setdefault(below, ([], []))
                        m[0].append(shape)
                        m[1].append(text_of(c))
                        walk(c, below)

            walk(tree(html), "")
            for path, (shapes, texts) in met.items():
                seen.setdefault((host if len(of) >= least else None, path), []).append(("\n".join(shapes), "|".join(texts)))
    dull = {}
    for (site, path), rows in seen.items():
        m = len(rows)
        if m < least:
            continue
        entropy = lambda k, rows=rows, m=m: -sum(c / m * math.log(c / m) for c in Counter(r[k] for r in rows).values()) / math.log(m)
        if max(entropy(0), entropy(1)) < importance:
            dull.setdefault(site, set()).add(path)
    return dull


def templates(rng):
    """Pages of 14 hosts, three of them large, whose templates say nothing by their names, and their articles."""
    say = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    out = []
    for h in range(14):
        before = f'<div class="x1 k{"abc"[h % 3]}"><div>{say(6)}</div><ul><li>{say(1)}</li><li>{say(1)}</li></ul></div>'
        for _ in range(40 if h < 3 else 2):
            article = f"<h1>{say(5)}</h1>" + "".join(f"<p>{say(rng.randint(3, 20))}</p>" for _ in range(rng.randint(1, 4)))
            changing = f'<div class="q">{say(2)}</div>' if rng.random() < 0.5 else ""
            body = f"{before}<section>{article}</section>{changing}<div class=\"z\">Same on all hosts</div>"
            out.append((f"h{h}.org", f"<html><body>{body}</body></html>", re.sub("<[^>]*>", "\n", article).split("\n")))
    return out


def test_tree_equals_brute_force_and_decides(spark):
    pages = templates(random.Random(3))
    pages += [pages[0]] * 15 + [pages[-1]] * 15  # copies
    df = spark.createDataFrame([(i, f"http://{h}/{i}", html, "r", "x") for i, (h, html, _) in enumerate(pages)], "page_id long, url string, html string, row string, host string").repartition(4)
    brute = brute_dull([(h, html) for h, html, _ in pages], 8, 0.2)
    got = {r.host: set(r.dull) for r in site_style_tree(df).collect()}
    assert got == {site: {_digest(p) for p in paths} for site, paths in brute.items()}
    assert len(got) == 4 and len(got[None]) == 1 and all(len(v) >= 2 for k, v in got.items() if k)
    rows = {r.page_id: r for r in extract_text(df).collect()}
    assert (rows[0].row, rows[0].host) == ("r", "x")
    for i, (host, html, article) in enumerate(pages):
        alone, own = main_text(html), "\n".join(a for a in article if a)
        assert own in rows[i].text and "Same on all hosts" in alone and "Same on all hosts" not in rows[i].text
        assert rows[i].cut_by_tree >= 1 and rows[i].cut_by_name == 0
        if host in ("h0.org", "h1.org", "h2.org"):
            assert rows[i].text in (own, own + "\n" + rows[i].text.split("\n")[-1]) and rows[i].cut_by_tree >= 2


def test_a_very_long_page(spark):
    page = "<body><nav>n</nav><article>" + "".join(f"<p>word{i} &amp; more</p>" for i in range(60_000)) + "</article></body>"
    pages = spark.createDataFrame([(1, "http://a/b", page), (1, "http://a/b", page), (2, "http://a/b", "<div>" * 3000 + "<article>deep")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.n_chars, r.text[-12:]) for r in extract_text(pages).collect())
    own = "\n".join(f"word{i} & more" for i in range(60_000))
    assert got == [(1, len(own), own[-12:])] * 2 + [(2, 4, "deep")]


def test_copies_of_a_page_are_no_template(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    around = '<html><body><div class="top">Our site, all rights reserved</div>{}</body></html>'
    varied = [around.format(f"<article><h1>{say(4)}</h1><p>{say(30)}</p></article>") for _ in range(12)]
    copy = around.format(f"<article><h1>{say(4)}</h1><p>{say(30)}</p><table><tr><td>cell one</td></tr></table></article>")
    plain = around.format(f"<h1>title</h1><p>{say(30)}</p>")
    others = [around.format(f"<h2>{say(3)}</h2><p>{say(30)}</p>") for _ in range(9)]
    rows = [("http://a.org/x", h) for h in varied + [copy] * 20] + [("http://b.org/x", h) for h in [plain] * 200 + others]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert all("cell one" in got[i] for i in range(12, 32))
    # a host of copies without article: their text stays, what the site says on all pages goes
    assert all("title" in got[i] and len(got[i].split()) == 31 for i in range(32, 232))
    assert all(len(got[i].split()) == 33 for i in range(232, 241))
