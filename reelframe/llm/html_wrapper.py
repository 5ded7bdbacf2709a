"""Main text of web pages by wrapper induction over the pages of a host.

The trees of a host's pages are aligned by simple tree matching and merged into
a template, whose nodes know on how many pages they stand, whether their text
changes, and how much of it there is. Text that stays the same on pages with
different titles belongs to the template; slots whose text varies are content,
but for parts that are menus, adverts and the like by name, or that lie outside
the node which holds the article: the one marked so, or else the smallest that
holds most of the varying text that is not in links.

Plan: every task merges the pages it has into one template a host; these small
trees are merged in two rounds, the first salted, so a host with a third of all
pages is shared by all tasks. Pages are read again with their host's template:
broadcast where all templates are within a checked size, else joined by host,
where adaptive execution splits a hot host. A page is never moved unless the
templates are many.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.llm import page_tree
from reelframe.llm.common import cut, pieces, table
from reelframe.llm.page_tree import ENOUGH, REPEATED, Node, Shape, aligned, merged, own_text, packed, read_page, role_of, shape_of, tag_of, unpacked
from reelframe.llm.url_filter import parts

#: Hosts whose templates a task holds before it passes them on.
HELD_HOSTS = 1_000
#: Bytes of templates up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: Of the text outside links, the share that the smallest node must hold to be the article where no element says so.
MOST = 0.6
#: The same for an element that says so: some pages mark teasers as articles.
SOME = 0.2
#: Of a list's text, the share in links from which on it is a menu, outside a marked article.
LINKED = 0.7
TEMPLATES = "host string, place long, template string"


def seed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "big", signed=True)


def page_shape(page: str | None) -> Shape:
    root, title = read_page(page or "")
    # pages without a title are told apart by all that they hold
    return shape_of(root, seed(" ".join(title.split()) or page or ""), seed)


def induced(pages: DataFrame) -> DataFrame:
    """(host, template) of pages (host, html), one row a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shape] = {}
        first: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            names = list(held)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([first[x] for x in names], pa.int64()), pa.array([json.dumps(packed(held[x])) for x in names], pa.string())], ["host", "place", "template"])

        for batch in batches:
            for part in pieces(iter([batch]), "html"):
                for place, host, page in zip(*(part.column(c).to_pylist() for c in ("place", "host", "html"))):
                    new = without_nodes(page_shape(page))
                    first.setdefault(host, place)
                    held[host] = merged(held[host], new) if host in held else new
                if len(held) >= HELD_HOSTS:
                    yield out()
                    held, first = {}, {}
        if held:
            yield out()

    def join(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("place")  # the same order, whichever task came first
        shape = None
        for x in rows["template"]:
            new = unpacked(json.loads(x))
            shape = new if shape is None else merged(shape, new)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "place": [int(rows["place"].iloc[0])], "template": [json.dumps(packed(shape))]})

    salts = max(1, math.isqrt(pages.rdd.getNumPartitions()))
    each = pages.select("host", "html", F.monotonically_increasing_id().alias("place")).mapInArrow(run, TEMPLATES)
    some = each.withColumn("salt", F.pmod(F.shiftright("place", 33), F.lit(salts))).groupBy("host", "salt").applyInPandas(join, TEMPLATES)
    return some.groupBy("host").applyInPandas(join, TEMPLATES).select("host", "template")


def without_nodes(shape: Shape) -> Shape:
    shape.nodes = []
    for x in shape.kids:
        without_nodes(x)
    return shape


def holds_main(shape: Shape) -> bool:
    return any(role_of(x.label) == "main" for x in page_tree.walk(shape) if x is not shape)


def is_around(shape: Shape, heads: bool = True) -> bool:
    """Whether a node is a menu, advert or the like, or, outside an article, heads the page. Not if the article is in it."""
    role = role_of(shape.label)
    return (role == "around" or heads and role == "head") and not holds_main(shape)


def is_constant(shape: Shape) -> bool:
    return shape.value is not None and not shape.varies and not shape.many and len(shape.titles) >= ENOUGH


def mass(shape: Shape) -> int:
    """Characters of varying text outside links, in what is not around the article; 0 in lists of links."""
    if is_around(shape):
        return 0
    own = 0 if is_constant(shape) else max(0, shape.chars - shape.links)
    return own + sum(map(mass, shape.kids))


def linked(shape: Shape) -> bool:
    chars, links = (sum(getattr(x, c) for x in page_tree.walk(shape)) for c in ("chars", "links"))
    return chars > 0 and links >= LINKED * chars


class Wrapper:
    """What a template says of its nodes: those that hold the article, those to leave out."""

    def __init__(self, template: Shape):
        self.template = template
        whole = mass(template)
        marked = self.mains(template)
        self.marked = bool(marked) and sum(map(mass, marked)) >= SOME * whole
        for x in marked if self.marked else [self.densest(template, whole)]:
            x.region = True
        self.known: dict[tuple[int, bool], bool] = {}

    def left_out(self, template: Shape, inside: bool) -> bool:
        """Whether a node of the template is around the article, or a list of links in a region that no element marks."""
        if (key := (id(template), inside)) not in self.known:
            lists = inside and not self.marked and tag_of(template.label) not in ("p", "li", "#root") and linked(template)
            self.known[key] = lists or is_around(template, heads=not inside)
        return self.known[key]

    def mains(self, shape: Shape) -> list[Shape]:
        """Outermost article elements outside of what is around; the articles in a main element, if they hold most of it."""
        out = []
        for x in shape.kids:
            if is_around(x, heads=False):
                continue
            if role_of(x.label) == "main":
                inner = [] if tag_of(x.label) == "article" else self.mains(x)
                out += inner if inner and sum(map(mass, inner)) >= MOST * mass(x) else [x]
            else:
                out += self.mains(x)
        return out

    def densest(self, template: Shape, whole: int) -> Shape:
        """The smallest container that holds most of the varying text outside links."""
        at = template
        while True:
            inside = [(mass(x), k) for k, x in enumerate(at.kids) if tag_of(x.label) not in REPEATED and not is_around(x)]
            best = max(inside, default=(0, 0))
            if not best[0] or best[0] < MOST * whole:
                return at
            at = at.kids[best[1]]

    def text(self, page: str) -> str:
        """A page's main text: its blocks in page order."""
        root, _ = read_page(page)
        shape = shape_of(root, 0, lambda _: 0)
        role: dict[int, str] = {}
        self.compare(shape, self.template, role, False)
        blocks: list[str] = []
        emit(root, role, False, blocks)
        return " ".join(blocks)

    def compare(self, own: Shape, template: Shape, role: dict[int, str], inside: bool) -> None:
        """Marks a page's elements by their place in the template: region, constant or around."""
        inside = inside or template.region
        if not template.region and self.left_out(template, inside):
            role.update((id(x), "around") for x in own.nodes)
            return
        told = ("region" if template.region else "") + (" constant" if is_constant(template) else "")
        role.update((id(x), told) for x in own.nodes)
        left, right, pairs = aligned(own.kids, template.kids)
        met = dict(pairs)
        for i, x in enumerate(left):
            if i in met:
                self.compare(x, right[met[i]], role, inside)
            elif is_around(x, heads=not inside):
                role.update((id(n), "around") for n in x.nodes)


def emit(node: Node, role: dict[int, str], inside: bool, blocks: list[str]) -> None:
    """The text of a page's elements within a region, one entry for each run of text between elements."""
    own = role.get(id(node), "")
    if node.hidden or own == "around":
        return
    inside = inside or own.startswith("region")
    run: list[str] = []

    def close() -> None:
        if run and inside and not own.endswith("constant"):
            if words := " ".join(html.unescape("".join(run)).split()):
                blocks.append(words)
        run.clear()

    for x in node.parts:
        if type(x) is tuple:
            run.append(x[0])
        else:
            close()
            emit(x, role, inside, blocks)
    close()


def main_texts(pages: DataFrame, url: str = "url", page: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages with `text`, the main text, and `n_chars`, its code points.

    A null or empty page has an empty text, as has one without an article. A null
    url is a host of its own, with other urls that have none. Repeated rows count
    once in what a template tells apart, by their title, and get the same text
    each. Columns text and n_chars of pages are replaced. No rows give no rows.
    Every page of any length is read whole, twice; memory is in proportion to it.
    """
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    boxed = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), parts(F.col(f"`{url}`"))[0].alias("host"), F.col(f"`{page}`").alias("html"))
    templates = cut(induced(boxed.select("host", "html")))
    size = templates.agg(F.coalesce(F.sum(F.octet_length("template") + F.octet_length("host")), F.lit(0))).first()[0]
    added = T.StructType([boxed.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch], held: dict[str, str] | None) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, Wrapper] = {}
        for batch in pieces(batches, "html"):
            out = []
            given = batch.column("template").to_pylist() if held is None else [None] * batch.num_rows
            for host, page, template in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), given):
                if host not in wrappers:
                    if len(wrappers) >= HELD_HOSTS:
                        wrappers.clear()
                    wrappers[host] = Wrapper(unpacked(json.loads(template if held is None else held[host])))
                out.append(wrappers[host].text(page) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["row", "text", "n_chars"])

    if size <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["template"] for r in templates.collect()})  # at most broadcast_bytes
        done = boxed.mapInArrow(lambda batches: run(batches, shared.value), added)
    else:
        done = boxed.join(templates.hint("merge"), "host").select("row", "host", "html", "template").mapInArrow(lambda batches: run(batches, None), added)
    return done.select(*(F.col("row").getField(c).alias(c) for c in kept), "text", "n_chars")


def op12_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
