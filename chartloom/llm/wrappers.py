"""Main text of web pages by wrapper induction: the pages of a host are aligned, and what they share is the template.

Every page gives its skeleton (`dom`). The skeletons of a host are folded into one wrapper tree by simple tree matching: the
best alignment of two trees that keeps order and parents; nodes without a partner are put in where they stand. Nodes of
the wrapper are the host's slots, and every text block fills one.

Over all pages of a host it is counted how often a slot's text comes back beside a different article (pages are told apart
by their longest block, so that copies of an article are no template). Constant nodes are template: a slot
where most texts come back, and, inside the article, a block that nearly all pages have. Varying slots become content,
except those whose element or words of class, id or role name them as furniture (menus, adverts, forms, comments and so on:
on many sites these vary as well) and those that are nearly all links. If a slot that is named an article, or else a main part,
holds enough of the host's varying text, only what it holds is content, on pages that have it.

Cases: null and empty html give an empty text; pages without a host in their url form a group of their own; a host with few
pages has no constants, and the names alone decide; repeated rows each give a row; null ids are kept; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm import dom
from chartloom.llm.bpe import slices
from chartloom.llm.tables import staged

#: Different articles that a host needs before a slot or a block can be constant, and the share at which it is.
SLOT_PAGES, SLOT_SHARE = 3, 0.5
BLOCK_PAGES, BLOCK_SHARE = 5, 0.8
#: Share of a slot's code points in links from which it is a menu, and of the host's varying text that an article slot holds.
LINK_SHARE, ARTICLE_SHARE = 0.8, 0.3
#: Different skeletons of a host that are folded in one task before the tasks' wrappers are.
FOLD_ROWS = 2000
#: Bytes of verdicts up to which they go to every task; above, they are joined by host and skeleton.
SMALL_BYTES = 32 << 20

# Elements and words that name furniture, and those that name the article.
FURNITURE_TAGS = set("nav footer aside form script style noscript template iframe object embed svg button select textarea fieldset menu dialog audio video canvas head title".split())
FURNITURE_WORDS = set(
    """nav navbar navigation navigations menu menubar breadcrumb breadcrumbs topbar toolbar pagination pager masthead banner footer footers copyright colophon contentinfo
    sidebar sidebars aside complementary rail widget widgets related recommended recommendations trending popular promo promos promotion teaser teasers
    notice notices cookie cookies consent gdpr alert alerts alertdialog disclaimer popup modal overlay toast announcement paywall dialog
    ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors outbrain taboola
    form search searchbox login signup signin subscribe subscription newsletter register share sharing social follow
    comment comments reply replies respond disqus feedback hidden""".split()
)
ARTICLE_WORDS = set("articlebody articlecontent postcontent postbody entrycontent storybody".split())
MAIN_WORDS = set("main content article post entry story text body maincontent".split())

Tree = tuple[str, list]


def _words(label: str) -> list[str]:
    words = label.split(".")[1:]
    return words + ["".join(words[i : i + 2]) for i in range(len(words) - 1)]


@lru_cache(100_000)
def is_furniture(label: str) -> bool:
    """By element, or by a word of class, id or role; the page's own frame is never furniture by its words."""
    tag = label.partition(".")[0]
    if tag in ("page", "html", "body"):
        return False
    return tag in FURNITURE_TAGS or not FURNITURE_WORDS.isdisjoint(label.split(".")[1:])


@lru_cache(100_000)
def article_rank(label: str) -> int:
    """2 for what is named an article, 1 for a main part, else 0."""
    tag, *words = label.split(".")
    if is_furniture(label) or tag in ("page", "html", "body") or tag in dom.FLOW:
        return 0
    if tag == "article" or {"article", "body"} <= set(words) or not ARTICLE_WORDS.isdisjoint(words):
        return 2
    return int(tag == "main" or not MAIN_WORDS.isdisjoint(words))


def tree_of(skeleton: str) -> Tree:
    """(label, children) from lines of depth and label."""
    root: Tree = ("", [])
    stack = [root]
    for line in skeleton.split("\n"):
        depth, _, label = line.partition(" ")
        del stack[int(depth) + 1 :]
        node: Tree = (label, [])
        stack[-1][1].append(node)
        stack.append(node)
    return root[1][0]


def skeleton_text(tree: Tree) -> str:
    out, todo = [], [(tree, 0)]
    while todo:
        (label, children), depth = todo.pop()
        out.append(f"{depth} {label}")
        todo += [(c, depth + 1) for c in reversed(children)]
    return "\n".join(out)


class Matching:
    """Simple tree matching of two trees with equal roots: the most pairs of nodes, in order and under paired parents."""

    def __init__(self) -> None:
        self._tables: dict[tuple[int, int], list[list[int]]] = {}

    def weight(self, a: Tree, b: Tree) -> int:
        if a[0] != b[0]:
            return 0
        key = (id(a), id(b))
        if key not in self._tables:
            rows = [[0] * (len(b[1]) + 1)]
            for x in a[1]:
                above, row = rows[-1], [0]
                for j, y in enumerate(b[1]):
                    row.append(max(row[-1], above[j + 1], above[j] + self.weight(x, y)))
                rows.append(row)
            self._tables[key] = rows
        return self._tables[key][-1][-1] + 1

    def children(self, a: Tree, b: Tree) -> list[tuple[int, int]]:
        """Paired children of two paired nodes."""
        self.weight(a, b)
        rows, i, j, out = self._tables[id(a), id(b)], len(a[1]), len(b[1]), []
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]


def folded(wrapper: Tree, page: Tree) -> Tree:
    """The wrapper with what the page has more: each unpaired child after the last paired one before it."""
    matching = Matching()

    def merged(a: Tree, b: Tree) -> Tree:
        pairs, out, i, j = matching.children(a, b), [], 0, 0
        for x, y in [*pairs, (len(a[1]), len(b[1]))]:
            out += a[1][i:x] + b[1][j:y]
            if x < len(a[1]) and y < len(b[1]):
                out.append(merged(a[1][x], b[1][y]))
            i, j = x + 1, y + 1
        return a[0], out

    return merged(wrapper, page)


def slots_of(wrapper: Tree, page: Tree) -> list[int]:
    """For each node of the page, in page order, its slot: the place of its partner in the wrapper (-1: none)."""
    places, todo = {}, [wrapper]
    while todo:
        node = todo.pop()
        places[id(node)] = len(places)
        todo += reversed(node[1])
    matching, out, todo = Matching(), [], [(page, wrapper)]
    while todo:
        node, partner = todo.pop()
        out.append(-1 if partner is None else places[id(partner)])
        paired = dict((j, partner[1][i]) for i, j in matching.children(partner, node)) if partner is not None else {}
        todo += [(c, paired.get(j)) for j, c in reversed(list(enumerate(node[1])))]
    return out


def _fold_all(skeletons: list[str]) -> str:
    """One wrapper of skeletons, the most frequent first."""
    wrapper = tree_of(skeletons[0])
    for s in skeletons[1:]:
        wrapper = folded(wrapper, tree_of(s))
    return skeleton_text(wrapper)


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, skeleton, its hash, article (hash of the longest block) and blocks (node, hash, points, linked, text) of every page.

    What is counted stands beside the texts, so that counting does not read them."""
    points = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("points", T.IntegerType()), T.StructField("linked", T.IntegerType())])
    schema = T.StructType([
        pages.schema["page_id"], pages.schema["url"], T.StructField("skeleton", T.StringType()), T.StructField("article", T.LongType()),
        T.StructField("marks", T.ArrayType(points)), T.StructField("texts", T.ArrayType(T.StringType())),
    ])
    kind = pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("points", pa.int32()), ("linked", pa.int32())]))

    def run(batches):
        for b in slices(batches, 64):
            skeletons, articles, marks, texts = [], [], [], []
            for markup in b.column(2).to_pylist():
                page = dom.Page(markup or "")
                nodes, place = dom.skeleton_of(page)
                skeletons.append("\n".join(f"{depth} {label}" for depth, label in nodes))
                marks.append([(place[node], xxhash.xxh3_64_intdigest(text) - (1 << 63), len(text), linked) for node, text, linked in page.blocks])
                texts.append([text for _, text, _ in page.blocks])
                articles.append(max(((size, h) for _, h, size, _ in marks[-1]), default=(0, None))[1])
            made = [pa.array(skeletons, pa.string()), pa.array(articles, pa.int64()), pa.array(marks, kind), pa.array(texts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=schema.names)

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    read = pages.select("page_id", "url", "html").mapInArrow(run, schema)
    return read.select("page_id", "url", host.alias("host"), "skeleton", F.xxhash64("skeleton").alias("shape"), "article", "marks", "texts")


def induce(skeletons: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """host and wrapper. skeletons: host, skeleton and n, one row for each different skeleton of a host.

    A host of many skeletons is folded in parts first, dealt by the skeletons' hashes, then the parts' wrappers are."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "skeleton"], ascending=[False, True])
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "skeleton": [_fold_all(rows["skeleton"].to_list())], "n": [rows["n"].sum()]})

    kind = "host string, skeleton string, n long"
    sizes = skeletons.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / fold_rows).alias("parts"))
    dealt = skeletons.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("skeleton"), F.col("parts")))
    parts = dealt.select("host", "part", "skeleton", "n").groupBy("host", "part").applyInPandas(fold, kind)
    return parts.groupBy("host").applyInPandas(fold, kind).select("host", F.col("skeleton").alias("wrapper"))


def verdicts(wrapper: str, slots: pd.DataFrame) -> tuple[list[bool], list[bool], list[bool]]:
    """Of each slot: whether its text is content on a page with the article slot, or on one without, and whether it lies in the article.

    slots: slot, articles (pages told apart), shared (of them with a text that comes back), points, linked (code points, copies once)."""
    labels, parents, stack = [], [], [-1]
    for line in wrapper.split("\n"):
        depth, _, label = line.partition(" ")
        del stack[int(depth) + 1 :]
        labels.append(label)
        parents.append(stack[-1])
        stack.append(len(labels) - 1)
    n = len(labels)
    furniture, rank = [False] * n, [0] * n
    for i, (label, parent) in enumerate(zip(labels, parents)):
        furniture[i] = is_furniture(label) or parent >= 0 and furniture[parent]
        rank[i] = 0 if furniture[i] else article_rank(label)
    stats = {r.slot: r for r in slots.itertuples()}
    varying = [False] * n
    points = [0] * n
    for i, r in stats.items():
        constant = r.articles >= SLOT_PAGES and r.shared >= SLOT_SHARE * r.articles
        # A page's banner stands outside its article; an article's own heading does not.
        varying[i] = not furniture[i] and not constant and r.linked < LINK_SHARE * max(1, r.points)
        points[i] = int(r.points) if not furniture[i] else 0
    below = list(points)
    for i in range(n - 1, 0, -1):
        below[parents[i]] += below[i]
    # The article: of the highest rank that holds enough, the slot with the most text, the inner one of equals.
    article = -1
    for kind in (2, 1):
        best = max((i for i in range(n) if rank[i] == kind), key=lambda i: (below[i], i), default=-1)
        if best >= 0 and below[best] >= ARTICLE_SHARE * max(1, below[0]):
            article = best
            break
    inside = [False] * n
    for i in range(n):
        inside[i] = i == article or parents[i] >= 0 and inside[parents[i]]
    banner = [False] * n
    for i, label in enumerate(labels):
        banner[i] = not inside[i] and (label.split(".")[0] == "header" or "header" in label.split(".")[1:] and rank[i] == 0 or parents[i] >= 0 and banner[parents[i]])
    within = [inside[i] and not furniture[i] for i in range(n)]
    without = [varying[i] and not banner[i] for i in range(n)]
    return (within if article >= 0 else without), without, inside


def _judged(read: DataFrame, shapes: DataFrame) -> DataFrame:
    """host, shape, keep (by node) and constants (hashes of template blocks of the host's article) of every skeleton.

    read: the pages read; shapes: host, shape, skeleton, n."""
    wrappers = staged(induce(shapes.select("host", "skeleton", "n")))

    def slotted(frames):
        for frame in frames:
            trees: dict[str, Tree] = {}
            slots = [slots_of(trees.setdefault(w, tree_of(w)), tree_of(s)) for w, s in zip(frame["wrapper"], frame["skeleton"])]
            yield pd.DataFrame({"host": frame["host"], "shape": frame["shape"], "slots": slots})

    mapped = shapes.join(wrappers, "host").select("host", "shape", "skeleton", "wrapper").mapInPandas(slotted, "host string, shape long, slots array<int>")
    mapped = staged(mapped)

    # A page's longest block tells its article from others; copies of a page then count once.
    rows = read.select("host", "shape", "article", F.inline("marks")).withColumnRenamed("hash", "text")
    rows = rows.groupBy("host", "shape", "node", "text", "article").agg(F.max("points").alias("points"), F.max("linked").alias("linked"))
    rows = rows.join(mapped, ["host", "shape"]).withColumn("slot", F.element_at("slots", F.col("node") + 1))
    once = rows.groupBy("host", "slot", "text", "article").agg(F.max("points").alias("points"), F.max("linked").alias("linked"))
    texts = once.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("articles"), F.max("points").alias("points"), F.max("linked").alias("linked"))
    texts = staged(texts)
    n_of = F.col("articles")
    slots = texts.groupBy("host", "slot").agg(
        F.sum("articles").alias("articles"), F.sum(F.when(n_of > 1, n_of).otherwise(0)).alias("shared"),
        F.sum(n_of * F.col("points")).alias("points"), F.sum(n_of * F.col("linked")).alias("linked"),
    )
    articles = read.select("host", "article").distinct().groupBy("host").agg(F.count("article").alias("all"))
    # Few texts can be frequent enough; only they meet their host's number.
    often = texts.where(F.col("articles") >= BLOCK_SHARE * BLOCK_PAGES).join(articles, "host").where((F.col("all") >= BLOCK_PAGES) & (F.col("articles") >= BLOCK_SHARE * F.col("all")))
    # At most as many for each host as a page has blocks, over the share.
    constants = often.groupBy("host").agg(F.collect_set("text").alias("constants"))

    def judge(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"host": [], "within": [], "without": [], "inside": []})
        within, without, inside = verdicts(left["wrapper"].iloc[0], right)
        return pd.DataFrame({"host": [key[0]], "within": [within], "without": [without], "inside": [inside]})

    judged = wrappers.groupBy("host").cogroup(slots.groupBy("host")).applyInPandas(judge, "host string, within array<boolean>, without array<boolean>, inside array<boolean>")
    by_shape = mapped.join(judged, "host").join(constants, "host", "left")
    has_article = F.expr("exists(slots, s -> s >= 0 and element_at(inside, s + 1))")
    keep = F.expr("transform(slots, s -> s >= 0 and if(has_article, element_at(within, s + 1), element_at(without, s + 1)))")
    return by_shape.withColumn("has_article", has_article).select("host", "shape", keep.alias("keep"), F.coalesce("constants", F.array().cast("array<long>")).alias("constants"))


def extract_text(pages: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    read = staged(read_pages(pages))
    shapes = staged(read.groupBy("host", "shape").agg(F.min("skeleton").alias("skeleton"), F.count(F.lit(1)).alias("n")))
    judged = staged(_judged(read, shapes).withColumnsRenamed({"host": "_host", "shape": "_shape"}))
    size = judged.agg(F.sum(F.size("keep") + 8 * F.size("constants") + F.length("_host") + 24)).first()[0] or 0
    side = F.broadcast(judged) if size <= small_bytes else judged
    met = read.join(side, (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape")), "left")
    # Most pages have no template inside their article.
    content = "element_at(keep, marks[i].node + 1) and (size(constants) = 0 or not array_contains(constants, marks[i].hash))"
    text = F.coalesce(F.array_join(F.expr(f"filter(texts, (x, i) -> coalesce({content}, false))"), "\n"), F.lit(""))
    return met.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
