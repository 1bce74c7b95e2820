from qcloom.llm import htmltext as H

SCHEMA = "page_id long, url string, html string"
MENU = "<div>Start</div><div>Shop</div><div>Contact us now</div>"


def test_lines():
    page = "<header><h1>Site</h1></header><nav><a>x</a></nav><article><header><h1>Title &amp; more</h1></header><p>One  two<br>three<p>a < b &nbsp;c<aside>side</aside><div class='ad-slot'>buy</div><script>if(a<b){'</p>'}</script><section id=comments><article>nice</article></section></article><form>f</form><footer>&copy;</footer>"
    assert H.lines_of(page) == (["Title & more", "One two three", "a < b c"], [1, 1, 1])
    assert H.lines_of(None) == ([], []) and H.lines_of("plain") == (["plain"], [0]) and H.lines_of("<p>a<p>b</div></p>c<!-- x --><!-- open")[0] == ["a", "b", "c"]
    assert H.lines_of("<title>t</title><style>p{}</style><p hidden>h</p><p style='display: none'>n</p><div role=navigation>r</div><b>x</b>y<textarea>z")[0] == ["xy"]
    assert H.lines_of("<div class='cookie-notice'>c</div><div class='article-body'>text</div><div class=sidebar>s</div>") == (["text"], [1])
    assert H.lines_of("<p>" + "long " * 50000)[0][0].count("long") == 50000


def test_common_lines():
    assert H.common_lines([1, 2, 3, 4, 5], [0, 2, 9, 4, 5]) == [1, 3, 4]
    assert H.common_lines([1, 1, 1], [1, 1]) == [0, 1] or len(H.common_lines([1, 1, 1], [1, 1])) == 2
    assert H.common_lines([], [1]) == [] and H.common_lines([1, 2], [3]) == []
    import random

    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = H.common_lines(a, b)
        it = iter(b)
        assert len(got) == best[-1][-1] and all(a[k] in it for k in got)


def test_differences_drop_what_pages_share(spark):
    rows = [(i, f"http://h.org/a/{i}", f"<body>{MENU}<div>{'Story number %d has its very own words. ' % i * 4}</div><div>All rights</div></body>") for i in range(9)]
    rows += [(20, "http://h.org/a/4", rows[4][2]), (30, "http://solo.org/x", f"{MENU}<div>text</div>"), (40, None, None), (41, "nothing", "<p>x</p>")]
    for parts in (1, 4):
        got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()}
        for i in range(9):
            assert got[i].text == " ".join([f"Story number {i} has its very own words."] * 4)
        assert got[20].text == got[4].text and got[30].text.endswith("text") and got[30].text.startswith("Start") and got[40].text == "" and got[41].text == "x"
        assert all(r.n_chars == len(r.text) for r in got.values())


def test_copies_and_articles_stay(spark):
    body = "<p>" + "the same story in two places. " * 5 + "</p>"
    rows = [(1, "http://h.org/a", body + "<p>one</p>"), (2, "http://h.org/b", body + "<p>two</p>"), (3, "http://g.org/a", f"<article>{body}</article><p>out</p>"), (4, "http://g.org/b", f"<article>{body}<p>own words here</p></article>")]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    story = " ".join(["the same story in two places."] * 5)
    assert got == {1: f"{story}\none", 2: f"{story}\ntwo", 3: story, 4: f"{story}\nown words here"}


def brute(rows):
    """{page: text} by trying everything on one machine, with a plain table for the longest common subsequence."""
    from collections import Counter

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        i, j, got = len(a), len(b), []
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                got.append(i)
            elif t[i - 1][j] >= t[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return got[::-1]

    def where(u):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host, _, path = (rest or "").partition("/")
        return host.lower(), "/" + path if path else ""

    pages = sorted((*where(u), H.digest(u, h), *H.lines_of(h)) for u, h in {(u, h) for _, u, h in rows})
    size = lambda p, ks, mark=None: sum(len(p[3][k]) for k in ks if mark is None or p[4][k] == mark)
    prefix = lambda a, b: len(__import__("os").path.commonprefix([a[1], b[1]]))
    may, count, on = {}, Counter(p[0] for p in pages), Counter()
    for n, p in enumerate(pages):
        near = sorted((q for q in pages[max(0, n - 1) : n] + pages[n + 1 : n + 2] if q[0] == p[0]), key=lambda q: -prefix(p, q))
        shared = [lcs(p[3], q[3]) for q in near]
        every = range(len(p[3]))
        got = next((g for g in shared if size(p, g) <= 0.6 * size(p, every)), None)
        copy, got = got is None, (shared[0] if shared else []) if got is None else got
        whole = size(p, got, 1) > 0.6 * size(p, every, 1)
        may[p[2]] = {k: p[4][k] == 0 and not copy for k in got if p[4][k] == 0 or not whole}
        on.update({(p[0], p[3][k]) for k in may[p[2]]})
    text = {}
    for p in pages:
        gone = {k for k, sure in may[p[2]].items() if sure or (n := on[p[0], p[3][k]]) >= 3 and 2 * n >= count[p[0]]}
        text[p[2]] = "\n".join(s for k, (s, m) in enumerate(zip(p[3], p[4])) if k not in gone and (m or 1 not in p[4]))
    return {i: text[H.digest(u, h)] for i, u, h in rows}


def site(seed, n=60):
    import random

    r = random.Random(seed)
    line = lambda w: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(w))
    rows, menus, quotes = [], {h: [line(r.choice([2, 9])) for _ in range(4)] for h in "xyz"}, [line(8) for _ in range(5)]
    for i in range(n):
        h = r.choice("xyz")
        body = [line(r.choice([3, 12])) for _ in range(r.randrange(1, 4))] + [r.choice(quotes)] * r.randrange(2)
        if rows and r.random() < 0.2:
            body = r.choice(rows)[3] + [line(2)]
        tag = r.choice(["div", "article", "article"])
        inner = "".join(f"<p>{x}</p>" for x in [menus[h][3], *body])
        rows.append((i, f"http://{h}.org/{r.choice('abc')}/{i % 23}", "".join(f"<div>{x}</div>" for x in menus[h][:3]) + f"<{tag}>{inner}</{tag}>", body))
    return [x[:3] for x in rows] + [(900, None, "<p>x"), (901, None, None), (902, "http://x.org/a/1", "")]


def test_against_brute_force(spark):
    for seed in range(3):
        rows = site(seed)
        want = brute(rows)
        for parts in (1, 5):
            got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()}
            assert got == want


def test_the_difference_decides(spark, monkeypatch):
    rows = [(i, f"http://h.org/a/{i}", f"<main>{MENU}<p>{f'Story {i} has its own words. ' * 9}</p><p>Read on</p></main>") for i in range(6)]
    rows += [(10 + i, f"http://t.org/a/{i}", f"<div>{'A long menu over the page. ' * 9}</div><p>Short {i}</p>") for i in range(6)]  # the template is most of the page
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r.text for r in H.extract(d).collect()}
    assert all(got[i] == " ".join([f"Story {i} has its own words."] * 9) and got[10 + i] == f"Short {i}" for i in range(6))
    monkeypatch.setattr(H, "template_lines", lambda *a: spark.createDataFrame([], "key binary, gone array<int>"))
    assert all(r.text != got[r.page_id] for r in H.extract(d).collect())


def test_edges(spark):
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0
    d = spark.createDataFrame([(1, "http://a/b", "<p>x</p>")] * 2, SCHEMA).selectExpr("*", "1 as text", "2 as key", "3 as gone")
    assert [(r.page_id, r.text) for r in H.extract(d).collect()] == [(1, "x")] * 2
