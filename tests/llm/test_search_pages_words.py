"""Lexical search, page extraction and spelling groups against brute force, on odd rows and on several templates."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm import dom, lexical, spelling, wrappers
from chartloom.llm.tables import read, ready

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(items, docs, k=10):
    """items: (id, text); docs: (id, text). Lists of (-score, doc_id)."""
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    n, total, df = len(bags), sum(c.total() for _, c in bags), Counter(w for _, c in bags for w in c)
    out = {}
    for item, text in items:
        scored = []
        for i, c in bags:
            m = 100 - 90 + ((90 * c.total() * n) // total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(TERM.findall((text or "").translate(LOWER))) if w in c)
            scored += [(-s, i is None, i or 0)] if s > 0 else []
        out[item] = [(s, None if null else i) for s, null, i in sorted(scored)[:k]]
    return {i: x for i, x in out.items() if x}


def listed(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r.item_id), r["rank"])):
        assert r["rank"] == len(out[r.item_id]) + 1
        out[r.item_id].append((-r.score, r.doc_id))
    return dict(out)


def test_search_is_exact(spark):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    want = brute_ranks([tuple(r) for r in items.select("item_id", "text").collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert listed(lexical.rank_documents(items, docs).collect()) == want
    # Blocks of items, and small stretches and leaves, change nothing.
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lexical, "STRETCH_DOCS", 40)
        assert listed(lexical.rank_documents(items, docs.repartition(2), block_items=11).collect()) == want


def test_hierarchies_bound_what_is_below():
    random = np.random.default_rng(1)
    sizes = random.integers(0, 9, 700)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    plain = lexical.Level(ends, np.concatenate([np.sort(random.choice(50, s, replace=False)) for s in sizes]), random.integers(1, 1000, ends[-1]))
    weight = random.integers(0, 100, 50)
    levels = lexical.levels_of(lexical.reordered(plain, lexical.by_strongest(plain, weight)), 16, 8)
    exact = levels[0].products(np.arange(700), weight)
    assert sorted(exact) == sorted(plain.products(np.arange(700), weight)) and len(levels[-1].ends) == 2
    for level, width in zip(levels[1:], (16, 128, 1024)):
        bounds = level.products(np.arange(len(level.ends) - 1), weight)
        assert all(bounds[i] >= exact[i * width : (i + 1) * width].max() for i in range(len(bounds)))


def test_search_on_odd_rows(spark):
    ready(spark)
    rows = [(1, None), (2, ""), (3, " \n!?"), (None, "apple pie"), (4, "apple pie"), (5, "apple pie"), (5, "apple pie"), (6, "Äpfel ÄPFEL 日本語 x" + " word" * 5000), (7, "other words only")]
    rows += [(100 + i, "apple " + "filler " * (i % 3)) for i in range(40)]
    items = [(1, "Apple PIE pie"), (1, "Apple PIE pie"), (2, None), (3, ""), (None, "äpfel Äpfel 日本語"), (4, "nothing known")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(3)).withColumn("item", F.lit("x"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    got = lexical.rank_documents(asked, docs).collect()
    assert listed(got) == brute_ranks(dict(items).items(), rows)
    # Ties of the hot group: ascending ids, null last.
    assert [r.doc_id for r in got if r.item_id == 1][:4] == [4, 5, 5, None]
    assert lexical.rank_documents(asked, docs.limit(0)).count() == lexical.rank_documents(asked.limit(0), docs).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert [r.doc_id for r in lexical.rank_documents(asked.where("item_id = 1"), named).orderBy("rank").collect()][:3] == ["d4", "d5", "d5"]


def article(k, n=6):
    random = np.random.default_rng(k)
    return [" ".join(random.choice([f"word{i}" for i in range(400)], 25)) + f" & é{k}.{p}" for p in range(n)]


def markup(lines):
    return "".join(f"<p>{x.replace('&', '&amp;').replace('é', '&eacute;')}" + ("</p>" if i % 2 else "") for i, x in enumerate(lines))


TEMPLATES = {
    # Named by elements; menus and adverts vary from page to page.
    "elements.example": lambda k, body: f"<!doctype html><html><head><title>T{k}</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/{k}>link{k}</a><li><a>two{k}</a></ul></nav><main><article><h1>Title {k}</h1>{body}<aside>aside {k}</aside></article></main><!-- <p>gone</p> --><footer>&copy; {k}</footer></body></html>",
    # Named by words of class and id only.
    "words.example": lambda k, body: f"<body class='has-sidebar'><div id=top-menu>a{k} <a>b</a></div><div class='cookie-notice'>We use {k}</div><div class='post-content' id='post-{k}'><h1>Title {k}</h1>{body}</div><div class=sidebar>side {k}<div>deep {k}</div></div><div class='ad ad-{k}'>buy {k}</div><form>name<input></form><div id=comments><div class=comment-body><p>I say {k} {'very ' * 300}</div></div></body>",
    # No names at all: only what the pages share tells the template from the content.
    "plain.example": lambda k, body: f"<table><tr><td>Welcome to our site<td><div>{['Blue offer', 'Red offer'][k % 2]}</div></table><div><h1>Title {k}</h1>{body}</div><div>All rights reserved<div>Since 1999</div></div>",
}


@pytest.mark.parametrize("host", TEMPLATES)
def test_templates(spark, host):
    ready(spark)
    made = {k: article(k, 3 + k % 4) for k in range(12)}
    rows = [(k, f"https://{host}/a/{k}", TEMPLATES[host](k, markup(x))) for k, x in made.items()]
    # Copies of one article are not a template, and another host has its own.
    rows += [(100 + k, f"http://user@{host.upper()}:80/b/{k}", TEMPLATES[host](3, markup(made[3]))) for k in range(40)]
    rows += [(300, "https://other.example/", "<p>Welcome to our site</p>")]
    got = {r.page_id: r for r in wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, lines in made.items():
        assert got[k].text == "\n".join([f"Title {k}", *lines]) and got[k].n_chars == len(got[k].text), host
    assert all(got[100 + k].text == got[3].text for k in range(40)) and got[300].text == "Welcome to our site"
    # The verdicts joined rather than sent along.
    again = {r.page_id: r.text for r in wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), small_bytes=0).collect()}
    assert again == {i: r.text for i, r in got.items()}


def test_pages_of_the_tables(spark):
    pages = read(spark, SF, "pages")
    got = {r.page_id: r.text for r in wrappers.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", __import__("html").unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_odd_pages(spark):
    ready(spark)
    deep = "<div>" * 3000 + "<p>deep text</p>" + "</div>" * 3000
    wide = "".join(f"<section class=s{chr(97 + i % 26)}{chr(97 + i // 26)}>part {i}</section>" for i in range(600))
    rows = [
        (1, None, None), (2, "", ""), (None, "no url", "just text"), (4, "https://h.example/x", deep), (5, "https://h.example/y", wide), (6, "https://h.example/z", "<p>one</p> tail <a href='<x'>two"), (6, "https://h.example/z", "<p>one</p> tail <a href='<x'>two"),
        (7, "https://h2.example/", "<p>a &lt; b &amp;&#233; <b>bold\n\t text</b><br>next</p><p></p><p>last <a hre"), (8, "https://h3.example/", "<p>" + "long " * 200_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("text", F.lit(1))
    got = wrappers.extract_text(pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[1] == texts[2] == "" and texts[None] == "just text" and texts[4] == "deep text"
    assert texts[5].split("\n") == [f"part {i}" for i in range(600)]
    assert [r.text for r in got if r.page_id == 6] == ["one\ntail two"] * 2
    assert texts[7] == "a < b &é bold text next\nlast" and len(texts[8]) == 5 * 200_000 - 1
    assert wrappers.extract_text(pages.limit(0)).count() == 0


def test_simple_tree_matching():
    random = np.random.default_rng(4)

    def tree(depth):
        return (str(random.integers(0, 3)) if depth < 3 else "r", [tree(depth - 1) for _ in range(random.integers(0, 4))] if depth else [])

    def brute(a, b):
        if a[0] != b[0]:
            return 0

        def best(x, y):
            return max(best(x[1:], y), best(x, y[1:]), brute(x[0], y[0]) + best(x[1:], y[1:])) if x and y else 0

        return 1 + best(a[1], b[1])

    for _ in range(60):
        a, b = tree(3), tree(3)
        assert wrappers.Matching().weight(a, b) == brute(a, b)
        text = wrappers.skeleton_text(a)
        assert wrappers.skeleton_text(wrappers.tree_of(text)) == text
        both = wrappers.folded(a, b)
        # Everything of both trees is in the wrapper, and every node of a page has a slot of its own.
        for page in (a, b):
            slots = wrappers.slots_of(both, page)
            assert -1 not in slots and len(set(slots)) == len(slots)


def test_page_reader():
    page = dom.Page("<ul><li>a<li>b</ul><dl><dt>t<dd>d</dl><table><tr><td>1<td>2<tr><td>3</table><h1>x</h2><p>y<div>z</div></p><textarea><p>no</textarea>&nbsp;end")
    assert [(page.labels[n], t) for n, t, _ in page.blocks] == [("li", "a"), ("li", "b"), ("dt", "t"), ("dd", "d"), ("td", "1"), ("td", "2"), ("td", "3"), ("h1", "x"), ("p", "y"), ("div", "z"), ("h1", "end")]
    assert dom.label_of("div", " class='no-sidebar mainText x2' id=a-1 style='display: none'") == "div.a.hidden.main.text.x"


def brute_words(docs):
    c = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    words = {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}
    near = defaultdict(set)
    cuts = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cuts[i, w[:i] + w[i + 1 :]].add(w)
    for (_, k), some in cuts.items():
        for w in some:
            near[w] |= some - {w}
            if k in words:
                near[w].add(k)
                near[k].add(w)
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in near if near[w]}
    form = {w: best[w] if w in best and words[best[w]] >= 5 * n else None for w, n in words.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found_words(rows):
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("block_rows", [spelling.BLOCK_ROWS, 30])
def test_spelling(spark, block_rows):
    ready(spark)
    random = np.random.default_rng(5)
    letters = list("abcdeéÿ×÷")
    words = ["".join(random.choice(letters[:3], 7)) for _ in range(300)] + ["".join(random.choice(letters, random.integers(5, 9))) for _ in range(300)]
    words += [w[:3] + "x" + w[4:] for w in words[:100]] + ["é" * 100, "é" * 101, "a" * 70, "a" * 69 + "b", "a" * 71, "b" + "a" * 70, "straße", "strase", "STRASE"]
    docs = [(i, " ".join(random.choice(words, 60)) + "-" + "Abcdef " * (i % 3)) for i in range(400)] + [(None, " ".join(words)), (3, None), (4, ""), (5, "ABCDEF0abcdeg")]
    docs += [(None, "chainabc " * 7), (7, "chainabd " * 40), (8, "chainabe " * 220), (9, "chainabef " * 1200), (7, "chainabd " * 40)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("x"))
    got = found_words(spelling.spelling_groups(table, block_rows=block_rows).collect())
    assert got == brute_words(docs)
    # A chain: each step has five times the occurrences.
    assert got["chainabc"][1] == "chainabef"
    assert spelling.spelling_groups(table.limit(0)).count() == 0


def test_spelling_of_the_tables(spark):
    docs = read(spark, SF, "documents")
    assert found_words(spelling.spelling_groups(docs).collect()) == brute_words([(r.doc_id, r.text) for r in docs.collect()])


def test_one_edit():
    random = np.random.default_rng(6)
    words = ["".join(random.choice(list("ab"), random.integers(1, 6))).encode() for _ in range(200)] + [b"a" * 80, b"a" * 81, b"a" * 40 + b"b" + b"a" * 40, b"a" * 39 + b"b" + b"a" * 41]
    pairs = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if abs(len(a) - len(b)) <= 1]

    def brute(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    one, other = np.array(pairs).T
    assert spelling.one_edit(words, one, other).tolist() == [brute(words[i], words[j]) for i, j in pairs]
