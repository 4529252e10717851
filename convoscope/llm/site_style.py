"""Main text of web pages by site style trees.

The pages of a host are merged into one tree.  An element's place in it is the
place of the element around it, its presentation (tag, class, id; digits blurred)
and its number among siblings of the same presentation; the runs of text between
block boundaries are the leaves.  A place's style nodes are the different
sequences of children that pages have there.

Importance of a place that m pages share, of l style nodes with shares p:

* presentation: -sum p log_m p, 0 where all pages look alike, 1 where each differs;
* content of a leaf: 1 - the mean over the occurrences of its features (words, link
  targets, image sources) of (e^H - 1) / (m - 1), where H is the entropy of the
  feature's occurrences over pages, so that e^H is the number of pages it is spread
  over: a word that every page repeats counts nothing, one of a single page fully.
  (With log_m in place of e^H, a word on a tenth of 5,000 pages would count as three
  quarters template, and long prose on large sites would sink below any threshold;
  with a mean over different features, one page number would outweigh a footer.)
* an element: (1 - g^l) presentation + g^l times the mean of its children on the page, g = 0.9.

What a page itself declares goes into the same values: parts declared to be no
article (elements such as nav, footer, form; roles; names in class or id such as
sidebar, comments) have importance 0, ``article`` and ``main`` have importance 1.
A branch goes if its root and everything in it stay below ``LEAST``.  A place that
fewer than ``MIN_PAGES`` pages share has importance 1: nothing can be learnt there.
Pages that are equal are counted once, so copies of an article don't make it look
like a template, and pages without a host are a site each.

Spark does the merging: pages are read once in tasks and written (blocks, places,
features); counts per place are aggregates; the statistics meet the different page
outlines of each host, not the pages, so a host with a third of all pages brings a
handful of rows.  Only outlines that lose a branch come back to the pages.

Defined results: null or empty html gives an empty text; null urls have no host;
repeated pages and ids are extracted each; no pages give no rows; further columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoscope.llm import html_tree
from convoscope.llm.tables import stored

GAMMA = 0.9
LEAST = 0.3
MIN_PAGES = 3
DROPS_BROADCAST = 50_000  # outlines that lose a branch are broadcast below this number of rows and leaves
WORD = re.compile(r"\w+")

NODE = "place:long,above:int,style:long,leaf:boolean,fixed:double"
READ = (
    f"page_id {{page_id}}, url string, host string, copy long, outline long, nodes array<struct<{NODE}>>, "
    "features array<struct<place:long,feature:long,times:int>>, blocks array<struct<leaf:int,text:string>>"
)


def _hash(*values: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, values))) - (1 << 63)


def outline(source: str) -> tuple[list[dict], list[dict], list[dict]]:
    """(nodes, features, blocks) of a page.

    Parts that the page declares are a single node with a fixed importance.  A block
    names the node it hangs on (its leaf, or the declared part); blocks that are
    declared outside the article are left out.
    """
    page = html_tree.read(source)
    main = page.main()
    children: list[list[tuple[str, int]]] = [[] for _ in page.tag]  # (presentation, element, or ~run)
    roots: list[tuple[str, int]] = []
    for node, parent in enumerate(page.parent):
        (children[parent] if parent >= 0 else roots).append((page.sign[node], node))
    for run, node in enumerate(page.run_of):
        (children[node] if node >= 0 else roots).append(("#text", ~run))
    nodes: list[dict] = []
    features: list[dict] = []
    leaf_of: dict[int, int] = {}  # run -> node it hangs on
    kept_in: dict[int, int] = {}  # element within a declared article -> node
    todo = [(~0, _hash("site"), -1, roots)]
    while todo:
        _, place, above, below = todo.pop()
        number: Counter = Counter()
        for sign, child in below:
            number[sign] += 1
            at = _hash(place, sign, number[sign])
            row = len(nodes)
            if child < 0:
                run = ~child
                leaf_of[run] = row
                nodes.append({"place": at, "above": above, "style": 0, "leaf": True, "fixed": None})
                words = Counter(w.lower() for w in WORD.findall(page.run_text[run])) + Counter(page.run_links[run])
                features += [{"place": at, "feature": _hash(w), "times": n} for w, n in words.items()]
                continue
            style = _hash(*(s for s, _ in children[child]))
            fixed = 0.0 if page.outside[child] else 1.0 if main[child] else None
            nodes.append({"place": at, "above": above, "style": style, "leaf": False, "fixed": fixed})
            if fixed is None:
                todo.append((child, at, row, children[child]))
            elif fixed:
                kept_in[child] = row
    for node, parent in enumerate(page.parent):  # parents come first
        if parent in kept_in and not page.outside[node]:
            kept_in[node] = kept_in[parent]
    blocks = []
    for run, node in enumerate(page.run_of):
        leaf = leaf_of.get(run, kept_in.get(node))
        if leaf is not None:
            blocks.append({"leaf": leaf, "text": page.run_text[run]})
    return nodes, features, blocks


def read_pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    schema = READ.format(page_id=rows.schema["page_id"].dataType.simpleString())
    arrow = rows.sparkSession.createDataFrame([], schema)  # for its Arrow types
    types = {f.name: f for f in _arrow_schema(arrow.schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("copy", "outline", "nodes", "features", "blocks")}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                nodes, features, blocks = outline(html)
                out["copy"].append(_hash(html))
                out["outline"].append(_hash(*((n["place"], n["above"], n["fixed"]) for n in nodes)))
                out["nodes"].append(nodes)
                out["features"].append(features if host else [])
                out["blocks"].append(blocks)
            columns = [batch.column(n) for n in ("page_id", "url", "host")] + [pa.array(out[n], types[n].type) for n in out]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", *out])

    return rows.mapInArrow(run, schema)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def importance(read: DataFrame) -> DataFrame:
    """(host, place, pages, styles, presentation, content) of the places that enough pages share."""
    site = read.where("host <> ''")
    seen = site.select("host", "copy", F.explode("nodes").alias("n")).where("n.fixed IS NULL").select("host", "copy", "n.place", "n.style")
    each = seen.distinct().groupBy("host", "place", "style").agg(F.count("*").alias("c"))
    spread = F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")
    styles = each.groupBy("host", "place").agg(
        F.sum("c").alias("pages"), F.count("*").alias("styles"), (spread / F.log(F.sum("c"))).alias("presentation")
    )
    shared = styles.where(F.col("pages") >= MIN_PAGES)
    words = site.select("host", "copy", F.explode("features").alias("f")).select("host", "copy", "f.place", "f.feature", "f.times").distinct()
    entropy = F.log(F.sum("times")) - F.sum(F.col("times") * F.log("times")) / F.sum("times")
    features = words.groupBy("host", "place", "feature").agg(F.sum("times").alias("times"), F.exp(entropy).alias("over"))
    weighted = F.sum(F.col("times") * (F.col("over") - 1)) / F.sum("times")
    leaves = features.groupBy("host", "place").agg(weighted.alias("over"))
    content = F.lit(1.0) - F.col("over") / (F.col("pages") - 1)
    return shared.join(leaves, ["host", "place"], "left").select(
        "host", "place", "pages", "styles", "presentation", F.coalesce(content, F.lit(1.0)).alias("content")
    )


def low_branches(nodes: list[dict]) -> list[int]:
    """Numbers of a page's nodes that go: they and all below them are of low importance."""
    below: list[list[float]] = [[] for _ in nodes]
    highest = [0.0] * len(nodes)  # of the node and all below
    for j in range(len(nodes) - 1, -1, -1):  # nodes below come later
        n = nodes[j]
        if n["fixed"] is not None:
            value = n["fixed"]
        elif n["pages"] is None:
            value = 1.0
        elif n["leaf"]:
            value = n["content"]
        else:
            weight = GAMMA ** n["styles"]
            inner = sum(below[j]) / len(below[j]) if below[j] else 0.0
            value = (1 - weight) * n["presentation"] + weight * inner
        highest[j] = max(highest[j], value)
        if n["above"] >= 0:
            below[n["above"]].append(value)
            highest[n["above"]] = max(highest[n["above"]], highest[j])
    gone = [h < LEAST for h in highest]
    for j, n in enumerate(nodes):  # a branch goes with its root
        gone[j] = gone[j] or (n["above"] >= 0 and gone[n["above"]])
    return [j for j, g in enumerate(gone) if g]


DROPS = "host string, outline long, drops array<int>"


def _drops(read: DataFrame, places: DataFrame) -> DataFrame:
    """(host, outline, drops) for the outlines of a host that lose a block."""
    outlines = read.where("host <> ''").select("host", "outline", "nodes").dropDuplicates(["host", "outline"])
    nodes = outlines.select("host", "outline", F.posexplode("nodes").alias("number", "n"))
    valued = nodes.select("host", "outline", "number", "n.place", "n.above", "n.leaf", "n.fixed").join(places, ["host", "place"], "left")
    row = F.struct("number", "above", "leaf", "fixed", "pages", "styles", "presentation", "content")
    whole = valued.groupBy("host", "outline").agg(F.sort_array(F.collect_list(row)).alias("nodes"))  # the nodes of one page

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = [low_branches(nodes) for nodes in batch.column("nodes").to_pylist()]
            columns = [batch.column("host"), batch.column("outline"), pa.array(drops, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "outline", "drops"])

    return whole.mapInArrow(run, DROPS).where(F.size("drops") > 0)


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text): blocks of the main text, two line ends between them."""
    read = stored(read_pages(pages), "page-blocks")
    drops = stored(_drops(read, importance(read)), "page-drops")
    size = drops.agg(F.count("*"), F.coalesce(F.sum(F.size("drops")), F.lit(0))).first()
    if max(size) <= DROPS_BROADCAST:
        drops = F.broadcast(drops)
    kept = F.filter("blocks", lambda b: F.col("drops").isNull() | ~F.array_contains("drops", b.leaf))
    text = F.array_join(F.transform(kept, lambda b: b.text), "\n\n")
    return read.join(drops, ["host", "outline"], "left").select("page_id", "url", text.alias("text"))
