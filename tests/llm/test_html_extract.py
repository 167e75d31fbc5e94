import math
import random

from glyphward.llm import html_extract as H


def tree_of(tree):
    kids = [[] for _ in tree.tags]
    for i, p in enumerate(tree.parent):
        if p >= 0:
            kids[p].append(i)
    return kids


def brute(tree):
    """Densities by walking down from every element, straight from the formula."""
    kids = tree_of(tree)

    def below(i):
        return [x for k in kids[i] for x in (k, *below(k))]

    def linked(i):
        while i >= 0:
            if tree.tags[i] == "a":
                return True
            i = tree.parent[i]
        return False

    def chars(ids, only_links=False):
        import html

        return sum(len(" ".join(html.unescape(t).split())) for i, t in tree.texts if i in ids and (not only_links or linked(i)))

    every = {0, *below(0)}
    ratio = chars(every, True) / max(1, chars(every))
    out = []
    for i in range(len(tree.tags)):
        b = below(i)
        c, lc = chars({i, *b}), chars({i, *b}, True)
        t, lt = max(1, len(b)), max(1, sum(tree.tags[k] == "a" for k in b))
        if not c:
            out.append(0.0)
            continue
        base = math.log(math.log(c / max(1, c - lc) * lc + ratio * c + math.e))
        inner = math.log(c / max(1, lc) * t / lt)
        out.append(c / t * (inner / base if base > 1e-9 else inner / 1e-9 if inner > 0 else 0.0))
    return out, [sum(out[k] for k in kids[i]) for i in range(len(tree.tags))]


def page(rng):
    tags = ["div", "p", "a", "span", "ul", "li", "b", "article"]
    out = ["<html><head><title>T</title><style>x{}</style></head><body>"]
    for _ in range(rng.randrange(1, 40)):
        t = rng.choice(tags)
        out.append(rng.choice([f"<{t}>", f"</{t}>", f"<{t} href='x>y'>", "<br>", "text " * rng.randrange(1, 9), "&amp;", "<!-- c -->", "<script>if(a<b)</script>"]))
    return "".join(out)


def test_densities_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        tree = H.parse(page(rng))
        got, want = H.densities(tree), brute(tree)
        for a, b in zip(got[0] + got[1], want[0] + want[1]):
            assert math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)


def test_article_is_found():
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(8))
    body = "".join(f"<p>Paragraph {i} has a good deal of plain text in it, more than any list.</p>" for i in range(5))
    source = f"<html><head><title>no</title></head><body><nav><ul>{links}</ul></nav><div class=ad>Buy now</div><article>{body}</article><footer><a href='x'>c</a></footer></body></html>"
    text, threshold = H.extract(source)
    assert text.count("\n") == 4 and text.startswith("Paragraph 0") and "link" not in text and "Buy" not in text and threshold > 0


def test_most_articles_of_the_pages_table_are_exact(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = lambda s: re.sub(r"\s+", "", html.unescape(re.sub("<[^>]*>", "", s)))
    want = {r["page_id"]: plain(re.search("<article>(.*?)</article>", r["html"], re.S).group(1)) for r in pages.collect()}
    got = {r["page_id"]: re.sub(r"\s+", "", r["text"]) for r in H.extract_pages(pages).collect()}
    assert sum(got[k] == want[k] for k in want) / len(want) > 0.85


def test_parsing():
    t = H.parse("<ul><li>a<li>b</ul><p>c<p>d<div>e</div><table><tr><td>1<td>2<tr><td>3</table>")
    assert [t.tags[p] if p >= 0 else None for p in t.parent] == [None, "body", "ul", "ul", "body", "body", "body", "body", "table", "tr", "tr", "table", "tr"]
    assert H.extract("<p title='a>b'>x</p>")[0] == "x" and H.extract('<p title="open>x</p>')[0] == "x"


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "just text"), (5, "<p>"), (6, "<!-- open"), (None, "<div><p>x</p></div>"), (4, "just text"), (7, "<div>" * 20_000 + "deep"), (8, "<p>" + "long " * 200_000)]
    pages = spark.createDataFrame([(i, h, "u", 1) for i, h in rows], "page_id long, html string, text string, threshold int")
    got = {}
    for r in H.extract_pages(pages).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[1] == [None] and got[2] == got[3] == got[5] == got[6] == [""] and got[4] == ["just text"] * 2 and got[None] == ["x"]
    assert got[7] == ["deep"] and len(got[8][0]) == 999_999
    assert H.extract_pages(pages.limit(0)).count() == 0
