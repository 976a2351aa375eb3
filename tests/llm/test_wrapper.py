"""Main text of pages by wrapper induction."""

from opsweave.llm import wrapper


def page(title, body, cookie="We use cookies. Accept all."):
    return (
        f"<html><head><title>{title}</title><script>var a='<p>no</p>';</script><style>p{{}}</style></head><body>"
        f"<header><h1>Daily Site</h1></header><nav><ul><li>Home<li>News</ul></nav><div class='cookie-banner'>{cookie}</div>"
        f"<div class=wrap><article><h2>{title}</h2>{body}</article><aside>Other stories</aside></div>"
        "<section id=comments><p>Nice one</p></section><form><label>Mail</label><input></form><footer>Imprint</footer></body></html>"
    )


def extract(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in wrapper.extract(df).collect()}


def test_article_alone_stays(spark):
    rows = [(i, f"http://a.example/{i}", page(f"Title {i}", f"<p>First &amp; foremost {i}</p><p>Second\n  <b>bold</b> {i}</p>")) for i in range(8)]
    got = extract(spark, rows)
    for i in range(8):
        assert got[i].text == f"Title {i}\n\nFirst & foremost {i}\n\nSecond bold {i}"
        assert got[i].n_chars == len(got[i].text)


def test_template_text_goes(spark):
    rows = [(i, f"http://b.example/{i}", f"<div><p>Welcome to our site, dear reader</p><div><p>Unique story number {i}</p></div></div>") for i in range(10)]
    got = extract(spark, rows)
    assert {r.text for r in got.values()} == {f"Unique story number {i}" for i in range(10)}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://c.example/", "plain words"), (4, None, "<p>a<p>b<div"), (None, "http://c.example/2", "<ul><li>x<li>y</ul>"), (1, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS slot")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in wrapper.extract(df).collect())
    assert got == sorted([("1", "", 0), ("1", "", 0), ("2", "", 0), ("3", "plain words", 11), ("4", "a\n\nb", 4), ("None", "x\n\ny", 4)])


def test_no_pages(spark):
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_page(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    got = extract(spark, [(i, f"http://d.example/{i}", f"{deep}<p>{i}</p>") for i in range(3)])
    assert got[1].text == "1" or got[1].text == "deep text\n\n1"


def texts_of(spark, *bodies):
    """Texts of pages that share no host."""
    got = extract(spark, [(i, None, f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)])
    return [got[i].text for i in range(len(bodies))]


def test_names_lose_no_article(spark):
    names = ["class='layout has-sidebar'", "class=no-sidebar", "class=has-related", "class='share-enabled'", "id=social-science", "class='ad-hoc'", "class='related-work'", "class='notice-board'", "class=sidebar", "class='with-footer'"]
    article = "<article><h1>Head</h1><p>Body text</p></article>"
    assert texts_of(spark, *(f"<div {n}>{article}</div>" for n in names)) == ["Head\n\nBody text"] * len(names)
    plain = "<p>First words</p><p>More words</p>"
    assert texts_of(spark, *(f"<div {n}>{plain}</div>" for n in names)) == ["First words\n\nMore words"] * len(names)


def test_names_take_their_own(spark):
    for name in ("class=ad", "class='top site-footer'", "id=comments", "class='comment-list'", "class='cookie-banner'", "role=navigation", "class='nav-bar'", "class='ad ad-1'", "class=newsletter-form"):
        assert texts_of(spark, f"<p>Kept</p><div {name}><p>gone</p></div><article><p>Told</p><div {name}>gone</div></article>") == ["Told"]


def test_attributes_by_name(spark):
    assert texts_of(spark, "<p title='a hidden gem'>one</p><p data-hidden=0>two</p><p hidden>three</p><p aria-hidden=TRUE>four</p><blockquote class=social>five</blockquote>") == ["one\n\ntwo\n\nfive"]


def test_inline_fallbacks_and_menus(spark):
    article = "<article><p>Energy is <math><mi>E</mi></math> always <object>shown</object></p><menu><li>step</menu></article><menu><li>File</menu>"
    assert texts_of(spark, article) == ["Energy is E always shown\n\nstep"]


def brute_weight(a, b):
    """Simple tree matching by its definition."""
    if a[0] != b[0]:
        return 0
    x, y = a[1:], b[1:]
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + brute_weight(x[i - 1], y[j - 1]))
    return 1 + table[-1][-1]


def test_matching_of_random_trees(monkeypatch):
    import random

    rng = random.Random(11)

    def tree(depth):
        return (rng.choice("ab"), *(tree(depth - 1) for _ in range(rng.randrange(4) if depth else 0)))

    def node(t):
        n = wrapper.Node(t[0], False, False)
        n.children = [node(c) for c in t[1:]]
        return n

    for cells in (1 << 20, 4):
        monkeypatch.setattr(wrapper, "TABLE_CELLS", cells)
        for _ in range(60):
            a, b = tree(4), tree(4)
            shapes, one, two = wrapper.Shapes(), node(a), node(b)
            shapes.assign(one)
            shapes.assign(two)
            assert shapes.weight(one.shape, two.shape) == brute_weight(a, b)
            x, y = tuple(c.shape for c in one.children), tuple(c.shape for c in two.children)
            pairs = shapes._pairs(x, y)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
            if a[0] == b[0]:
                assert 1 + sum(shapes.weight(x[i], y[j]) for i, j in pairs) == brute_weight(a, b)


def test_wide_and_long_pages(spark):
    wide = [(i, "http://w.example/", "<article>" + "".join(f"<p>{k} {i}</p><div><b>{k}</b></div>" if (k + i) % 7 else f"<ul><li>{k}</ul>" for k in range(1500)) + "</article>") for i in range(2)]
    got = extract(spark, [*wide, (9, "http://w.example/", "<p>" + "long " * 300_000 + "</p>")])
    assert got[0].text.count("\n\n") > 2500 and got[9].n_chars == 5 * 300_000 - 1


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def plain_pages(host, seed, n):
    """Pages with neither article nor main, class or id, in two layouts, with what a reader would keep.

    Menus, notices and imprints are the same on most pages; asides vary, but outside of the content."""
    import random

    rng, rows, want = random.Random(seed), [], {}
    for i in range(n):
        title, parts = words(rng, 4), [words(rng, rng.randrange(30, 60)) for _ in range(rng.randrange(2, 6))]
        body = "".join(f"<p>{p}</p>" for p in parts)
        menu = "<ul><li>Home</li><li>News</li><li>Contact</li></ul>"
        if i % 2:
            page = f"<body><div>{menu}</div><div><h1>{title}</h1>{body}</div><div><p>{words(rng, 3)}</p></div><div><p>All rights kept</p></div></body>"
        else:
            page = f"<body><section>{menu}</section><table><tr><td><p>Weather: {words(rng, 2)}</p></td><td><h1>{title}</h1><p>Please read on</p>{body}</td></tr></table><section>All rights kept</section></body>"
        rows.append((seed * 1000 + i, f"https://{host}/{i}", f"<!DOCTYPE html><html><head><title>{title}</title></head>{page}</html>"))
        want[seed * 1000 + i] = "\n\n".join([title, *parts])
    return rows, want


def test_layouts_without_names(spark):
    first, one = plain_pages("plain.example", 1, 24)
    second, two = plain_pages("other.example", 2, 13)
    got = extract(spark, first + second)
    assert {k: r.text for k, r in got.items()} == {**one, **two}
    # Too few pages of a layout: nothing is induced and everything stays.
    few, _ = plain_pages("few.example", 3, 4)
    got = extract(spark, few)
    assert all("All rights kept" in r.text and "Home" in r.text for r in got.values())


def test_induction_overrules_no_veto(spark):
    """A region of varying text keeps out what varies beside it, and names keep out what varies in it."""
    import random

    rng = random.Random(5)
    rows, want = [], {}
    for i in range(9):
        parts = [words(rng, 40) for _ in range(3)]
        inner = f"<p>{parts[0]}</p><div class=ad>{words(rng, 5)}</div><p>{parts[1]}</p><aside>{words(rng, 4)}</aside><p>{parts[2]}</p><div class=comments><p>{words(rng, 6)}</p></div>"
        rows.append((i, f"http://veto.example/{i}", f"<body><div><p>{words(rng, 3)}</p></div><div><div>{inner}</div></div><div><p>{words(rng, 3)}</p></div></body>"))
        want[i] = "\n\n".join(parts)
    assert {k: r.text for k, r in extract(spark, rows).items()} == want


def test_long_comments_are_no_region(spark):
    """Comments that outweigh the story do not become the content."""
    import random

    rng = random.Random(6)
    rows, want = [], {}
    for i in range(9):
        story = words(rng, 20)
        rows.append((i, f"http://talk.example/{i}", f"<body><div><p>{story}</p></div><div id=comments><p>{words(rng, 300)}</p></div></body>"))
        want[i] = story
    assert {k: r.text for k, r in extract(spark, rows).items()} == want


def test_region_by_its_definition():
    """The smallest element with the share of the varying text, on random trees."""
    import random

    rng = random.Random(8)

    def markup(depth):
        return "".join(f"<div>{markup(depth - 1)}</div>" if depth and rng.random() < 0.6 else f"<p>{'x' * rng.randrange(1, 90)}</p>" for _ in range(rng.randrange(1, 4)))

    for _ in range(80):
        layout = wrapper.LayoutWrapper(f"<body>{markup(4)}</body>")
        varying = {n.slot: len(n.text) for n in layout.nodes if n.tag == "#" and rng.random() < 0.8}

        def mass(node):
            return varying.get(node.slot, 0) + sum(map(mass, node.children))

        total = mass(layout.tree)
        fit = [n for n in layout.nodes if n.tag == "div" and total and mass(n) >= wrapper.REGION * total]
        assert layout.region(varying) == (min(fit, key=lambda n: (mass(n), -n.slot)).slot if fit else 0)
        assert layout.path(layout.region(varying)) >= {0}


def test_repeats_and_partitions_change_nothing(spark):
    rows, want = plain_pages("same.example", 4, 16)
    df = spark.createDataFrame(rows * 3, "page_id long, url string, html string")
    for parts in (1, 7):
        assert {(r.page_id, r.text) for r in wrapper.extract(df.repartition(parts)).collect()} == set(want.items())
