"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of elements (tag, class and id). For
each node the corpus is counted: on how many pages it occurs, in which presentations (what follows
what inside it), and which texts its own lines have on how many pages. Importance of a node is the
entropy of its presentations, or of its content, against the number of its pages: what looks or
reads the same everywhere tells nothing. All blocks of all pages are counted. Composite importance of
a node is that of its own lines; of a branch without any, it blends its presentations with the content
below it. It is weighed by the evidence of names: nothing in what names itself noise (navigation,
adverts, forms, reader comments and so on, as tag, role, class or id), half where a name has a noise
word inside. Repeated lines of low nodes are template, on however small a share of the host's pages; each
node is judged for itself, so a line that tells something stays although its branch is low. Pages that
say the same are counted as one, so copies of a page don't make a template of it.

Counts are summed before they move, by host, path, value and page, so a host with a third of all pages is
spread over all tasks; trees are never gathered. What a page needs of its tree are the template lines
of its host: those on a share of its pages as one list, which the share bounds, and rarer ones
joined to the pages that have them.

Defined results: null html has no text; a null or odd url is the host of its own kind; rows of one
page_id are pages each; of a host with fewer than ``MIN_PAGES`` different pages only names tell noise; an
empty table stays empty; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from packwise.llm.common import col, fresh, written
from packwise.llm.html_blocks import Block, Element, read

#: On how many different pages of a host a line of template is at least.
MIN_PAGES = 5
#: Lines on this share of a host's pages are listed per host, rarer ones per page.
LISTED_SHARE = 0.05
MIN_IMPORTANCE = 0.2
DECAY = 0.9
#: Names of noise: tags and roles, then whole names among class and id. Those of the second kind say it
#: anywhere; those of the first kind inside an article or main part too.
NOISE_TAGS = frozenset("nav form button menu select input audio video".split())
OUTER_TAGS = frozenset("footer aside".split())
NOISE_ROLES = frozenset("navigation search menu menubar form toolbar".split())
OUTER_ROLES = frozenset("banner contentinfo complementary dialog alert alertdialog".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsored comment comments commentlist comment-list "
    "comments-area respond disqus disqus_thread share sharing share-bar sharebar share-buttons social-share "
    "social-sharing cookie-notice cookie-banner cookie-consent navbar breadcrumb breadcrumbs sidebar pagination".split())
OUTER_NAMES = frozenset(
    "banner sponsor promo cookie cookies consent gdpr newsletter subscribe signup login nav navigation menu footer "
    "masthead related recommended social popup modal overlay widget pager toolbar hidden".split())
PARTS = ("article", "main")
#: Words inside longer names that make a node doubtful, outside an article or main part.
DOUBTFUL_WORDS = frozenset(w for name in NOISE_NAMES | OUTER_NAMES for w in re.split("[-_]", name)) | frozenset(
    "notice notification alert promotion subscription reply header topbar".split()) - frozenset(("list", "area", "bar"))
WORD = re.compile(r"[a-z]+")
HEADER_NAMES = frozenset(("header", "masthead", "topbar"))
#: Headings carry ids made from their text, and a page's root names its whole layout.
UNNAMED = frozenset("html body h1 h2 h3 h4 h5 h6".split())
DIGITS = re.compile(r"\d+")


def host_of(url: Column) -> Column:
    """The host of a url, lower-cased; of anything else the text itself, and '' for null."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(F.when(host != "", host), url, F.lit("")))


def is_noise(e: Element) -> bool:
    """Noise by its own name. What only a page's own parts are called (header, footer, promo) says
    nothing inside an article or main part."""
    role, style = e.attrs.get("role", "").lower(), e.attrs.get("style", "").replace(" ", "").lower()
    if e.tag in NOISE_TAGS or role in NOISE_ROLES or e.attrs.get("hidden", "until-found").lower() != "until-found":
        return True
    if "display:none" in style or "visibility:hidden" in style or (e.tag == "dialog" and "open" not in e.attrs):
        return True
    names = set() if e.tag in UNNAMED else set(f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}".lower().split())
    if e.tag in ("article", "main"):
        return not {"comment", "comments", "ad"}.isdisjoint(names)
    if not NOISE_NAMES.isdisjoint(names):
        return True
    outer = e.tag in OUTER_TAGS or e.tag == "header" or role in OUTER_ROLES or not OUTER_NAMES.isdisjoint(names)
    outer = outer or not HEADER_NAMES.isdisjoint(names)
    return outer and not any(x.tag in PARTS or x.attrs.get("role", "").lower() in PARTS for x in e.above())


def is_doubtful(e: Element) -> bool:
    """Whether a word of its class or id sounds like noise: evidence, not proof."""
    if e.tag in UNNAMED or not e.attrs or any(x.tag in PARTS or x.attrs.get("role", "").lower() in PARTS for x in e.above()):
        return False
    return not DOUBTFUL_WORDS.isdisjoint(WORD.findall(f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}".lower()))


def node_path(e: Element) -> int:
    """The node of the style tree that an element belongs to."""
    names = []
    for x in e.above():
        look = DIGITS.sub("0", f"{x.attrs.get('class', '')}#{x.attrs.get('id', '')}") if x.attrs else ""
        names.append(f"{x.tag}.{look}")
    return xxhash.xxh64_intdigest("/".join(names)) - (1 << 63)


def evidence_of() -> Callable[[Element], float]:
    """How much a node's place lets its content count: nothing in noise, half where a name has a noise
    word, else all of it. Remembered for the elements of one page."""
    known: dict[int, float] = {}

    def evidence(e: Element) -> float:
        if id(e) not in known:
            above = 1.0 if e.parent is None else evidence(e.parent)
            known[id(e)] = above and min(above, 0.0 if is_noise(e) else 0.5 if is_doubtful(e) else 1.0)
        return known[id(e)]

    return evidence


def lines_of(page: str | None) -> list[tuple[Block, float, str]]:
    """All blocks of a page, each with its evidence and its text: without the pieces that are noise
    inside it, or as it is if it is noise whole."""
    evidence, out = evidence_of(), []
    for b in read(page)[0]:
        most = max(evidence(e) for e, t in b.pieces if not t.isspace())
        out.append((b, most, b.text((lambda e: evidence(e) > 0) if most else None)))
    return out


def line_key(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path} {text}") - (1 << 63)


def features(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, path, kind, value, page), each once a page. Kinds: 0 the node occurs (value: its
    evidence in tenths), 1 a presentation, 2 a line of its own, 3 a node above it (page is 0), and at
    path 0: 4 the key of the row. ``page`` is the hash of what the page says outside noise, so copies of
    a page are one page."""
    for batch in pages:
        out = ([], [], [], [], [])
        for host, key, html in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html"))):
            rows = {(0, 0, 10), (0, 4, key)}
            paths: dict[int, int] = {}
            evidence, lines = evidence_of(), lines_of(html)
            page = xxhash.xxh64_intdigest("\n".join(text for _, most, text in lines if most)) - (1 << 63)
            for b, _, text in lines:
                chain = []
                for e in b.holder.above():
                    if id(e) not in paths:
                        paths[id(e)] = node_path(e)
                        look = [c for i, c in enumerate(e.children) if not i or c != e.children[i - 1]]
                        rows.add((paths[id(e)], 0, round(10 * evidence(e))))
                        rows.add((paths[id(e)], 1, xxhash.xxh64_intdigest(" ".join(look)) - (1 << 63)))
                    chain.append(paths[id(e)])
                rows.add((chain[0], 2, line_key(chain[0], text)))
                rows.update((chain[0], 3, up) for up in chain)
            for path, kind, value in sorted(rows):
                for values, x in zip(out, (host, path, kind, value, 0 if kind == 3 else page)):
                    values.append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int8()),
             pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], ["host", "path", "kind", "value", "page"])


def seen(pages: DataFrame) -> DataFrame:
    """The features of pages(host, key, html), each once for each page that differs; written."""
    rows = pages.mapInArrow(features, "host string, path long, kind byte, value long, page long")
    return written(rows.distinct(), "style-rows")


def counts(rows: DataFrame) -> DataFrame:
    """On how many different pages each feature is; written."""
    k = rows.where("kind < 4").groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("k"))
    return written(k, "style-tree")


def style_tree(counted: DataFrame) -> DataFrame:
    """Nodes of the trees of ``counts``: host, path, pages (that differ), total (of the host), own (has
    lines of its own), presentation and content (importance of either, 0 to 1), evidence, composite."""
    k, kind = F.col("k"), F.col("kind")
    of = lambda n, x: F.coalesce(F.sum(F.when(kind == n, x)), F.lit(0.0))
    nodes = counted.where("kind < 3").groupBy("host", "path").agg(
        F.sum(F.when(kind == 0, k)).alias("pages"), F.max(F.when(kind == 0, F.col("value") / 10)).alias("evidence"),
        of(1, F.lit(1)).alias("looks"),
        of(1, k).alias("s1"), of(1, k * F.log(k)).alias("l1"), of(2, k).alias("s2"), of(2, k * F.log(k)).alias("l2"))
    spread = F.log("pages")
    nodes = nodes.select(
        "host", "path", "pages", "evidence", "looks", "s2",
        F.when(F.col("pages") == 1, 1.0).otherwise((F.log("s1") - F.col("l1") / F.col("s1")) / spread).alias("presentation"),
        F.when(F.col("pages") == 1, 1.0).otherwise(1 - F.col("l2") / F.col("s2") / spread).alias("content"))
    total = nodes.where("path = 0").select("host", F.col("pages").alias("total"))
    own = nodes.where("path <> 0")
    below = (
        counted.where("kind = 3").select("host", "path", F.col("value").alias("up"))
        .join(own.where("s2 > 0").select("host", "path", "s2", (F.col("s2") * F.col("content")).alias("c")), ["host", "path"])
        .groupBy("host", F.col("up").alias("path")).agg((F.sum("c") / F.sum("s2")).alias("below"))
    )
    fade = F.pow(F.lit(DECAY), F.col("looks"))
    leaf = F.col("s2") > 0
    composite = F.when(leaf, F.col("content")).otherwise((1 - fade) * F.col("presentation") + fade * F.col("below"))
    return own.join(below, ["host", "path"]).join(total, "host").select(
        "host", "path", "pages", "total", leaf.alias("own"), "presentation", "content",
        "evidence", (F.col("evidence") * composite).alias("composite"))


def templates(counted: DataFrame) -> DataFrame:
    """Template lines (host, line, common): repeated lines of low nodes. A line that few pages have is
    content, whatever its node's other lines are. Noise by name goes without being listed."""
    low = F.col("own") & (F.col("evidence") > 0) & (F.col("pages") >= MIN_PAGES) & (F.col("composite") < MIN_IMPORTANCE)
    nodes = style_tree(counted).where(low).select("host", "path", "total")
    lines = counted.where((F.col("kind") == 2) & (F.col("k") >= MIN_PAGES)).join(nodes, ["host", "path"])
    return lines.select("host", F.col("value").alias("line"), (F.col("k") >= LISTED_SHARE * F.col("total")).alias("common"))


def low_by_host(found: DataFrame) -> DataFrame:
    """host, low: the common template lines. Each is on a share of the host's pages, so they are few."""
    return found.where("common").groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("low"))


def low_by_page(found: DataFrame, rows: DataFrame) -> DataFrame:
    """host, key, low: the rarer template lines of each page that has any, in ``rows`` of ``seen``."""
    rare = found.where("NOT common").select("host", F.col("line").alias("value"))
    low = rows.where("kind = 2").join(rare, ["host", "value"]).groupBy("host", "page").agg(
        F.sort_array(F.collect_set("value")).alias("low"))
    keys = rows.where("kind = 4").select("host", "page", F.col("value").alias("key"))
    return keys.join(low, ["host", "page"]).groupBy("host", "key").agg(F.first("low").alias("low"))


def main_text(page: str | None, low: set[int]) -> str:
    """The lines of a page outside noise, without those whose keys are in ``low``."""
    lines = [(b, t) for b, evidence, t in lines_of(page) if evidence]
    if low:
        lines = [(b, t) for b, t in lines if line_key(node_path(b.holder), t) not in low]
    return "\n".join(t for _, t in lines if t)


def extract(pages: DataFrame) -> DataFrame:
    """pages(url, html) with the column text, the main text (a longer name on a clash)."""

    @pandas_udf("string")
    def text_of(html: pd.Series, common: pd.Series, rare: pd.Series) -> pd.Series:
        low = (set().union(*(x.tolist() for x in (a, b) if x is not None)) for a, b in zip(common, rare))
        return pd.Series([main_text(p, x) for p, x in zip(html, low)], dtype=object)

    names = fresh(pages, "_host", "_key", "_low_host", "_low", "_rare_host", "_rare_key", "_rare", "text")
    host, key, low_host, low, rare_host, rare_key, rare, text = names
    sited = pages.withColumn(host, host_of(col("url"))).withColumn(key, F.xxhash64(col("html")))
    rows = seen(sited.select(F.col(host).alias("host"), F.col(key).alias("key"), col("html").alias("html")))
    found = written(templates(counts(rows)), "templates")
    common = written(low_by_host(found), "templates-host").toDF(low_host, low)
    by_page = written(low_by_page(found, rows), "templates-page").toDF(rare_host, rare_key, rare)
    both = sited.join(common, F.col(host) == F.col(low_host), "left").join(
        by_page, (F.col(host) == F.col(rare_host)) & (F.col(key) == F.col(rare_key)), "left")
    return both.select(*map(col, pages.columns), text_of(col("html"), F.col(low), F.col(rare)).alias(text))
