"""HTML extraction by nearest-URL page differencing.

The lines of every page are aligned by longest common subsequence with those of its nearest pages by URL path within
the host, and lines they share are the site's. Markup then checks this exactly: what lies in menus, headers, footers,
sidebars, forms, adverts, notices and comments is dropped, shared or not, and a shared line within an article or main
element stays if any of its text is more than a link, for pages share lines of their articles too: copies, licences,
quoted passages. Shared lines that are links only, and all shared lines of pages without such an element, are deleted.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import offsets
from .common import written
from .url_filters import host_of, path_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CHROME = frozenset("nav footer aside form menu dialog".split())
#: Names of site furniture, and words that may stand beside them in a name: cookie-notice, ad_box, comments.
SITE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion promotions banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter"
    " subscribe subscription signup sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager share sharing social related recommended comment comments commentlist respond replies"
    " disqus footer masthead topbar toolbar search searchbox complementary contentinfo dialog".split()
)
BESIDE = frozenset("site page main global top bottom left right inner outer box bar container wrapper wrap section area block list item items links link form header head inline primary secondary mobile".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that another block or the end of what holds them closes.
CLOSED_BY = {"p": None, "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr")}


def furniture(names: str) -> bool:
    """Whether one of the names says site furniture and nothing else: related-work and content-menu-free do not."""
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_]+|(?<=[a-z])(?=\d)", name) if x and not x.isdigit()]
        if any(x in SITE for x in parts) and all(x in SITE or x in BESIDE for x in parts):
            return True
    return False


def blocks(page: str) -> tuple[bool, list[str], list[tuple[str, bool, bool]]]:
    """(whether an article or main element frames them, the page's lines outside site furniture, all lines outside furniture
    in page order with whether they lie in a frame and whether they are links only).

    Furniture is told by the kind of a block element and by names that say nothing else; headings and, within a
    frame, inline elements always stay. What is left out ends where its element does, by an end tag or implied.
    """
    lines: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    plain: list[bool] = []
    inside, skip, depth, at, link = 0, "", 0, 0, False

    def end() -> None:
        nonlocal link
        link = False  # one that was never closed ends with its block
        if parts:
            if line := " ".join(html.unescape("".join(parts)).split()):
                lines.append((line, inside > 0, not any(plain)))
            parts.clear()
            plain.clear()

    def take(text: str) -> None:
        parts.append(text)
        plain.append(not link and not text.isspace())

    for m in TOKEN.finditer(page):
        if m.start() > at and not skip:
            take(page[at : m.start()])
        at = m.end()
        if not (name := m[3]):
            continue
        name, closing = name.lower(), bool(m[2])
        if name == "a":
            link = not closing and "href" in m[4].lower()
        frame = name in ("article", "main")
        if skip:
            if frame and (closing and inside or not closing and skip not in CHROME):
                skip = ""  # an element that was never closed
            elif skip in CLOSED_BY and depth == 1 and name != "br" and name not in INLINE and (name != skip if closing else CLOSED_BY[skip] is None or name in CLOSED_BY[skip]):
                skip = ""
            else:
                if name == skip and not m[4].endswith("/"):
                    depth += -1 if closing else 1
                    skip = skip if depth else ""
                continue
        if name in INLINE and (inside or not m[4]):
            continue
        if not closing:
            said = " ".join(a or b or c for a, b, c in NAMES.findall(m[4])) if "=" in m[4] else ""
            if name in CHROME or name == "header" and not inside or said and name not in HEADINGS and furniture(said) and name not in ("html", "body", "article", "main", "br", "hr", "img", "input", "meta", "link"):
                end()
                skip, depth = name, 1
                continue
        if name not in INLINE:
            end()
        if frame:
            inside = max(0, inside + (-1 if closing else 1))
    if not skip and page[at:]:
        take(page[at:])
    end()
    framed = any(x for _, x, _ in lines)
    return framed, [x for x, y, _ in lines if y == framed], lines


def common_lines(a: list, b: list) -> set[int]:
    """Places of `a` on one longest common subsequence with `b`."""
    where: dict[object, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    heads: list[tuple[int, tuple | None]] = []
    for i, line in enumerate(a):
        for j in where.get(line, ()):
            k = bisect_left(tails, j)
            node = (i, heads[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                heads.append(node)
            else:
                tails[k], heads[k] = j, node
    found, node = set(), heads[-1] if heads else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def shared_lines(lines: list, sizes: list[int], others: list[list], most: float = 0.5) -> set[int]:
    """Places of the lines shared with a neighbour; one that shares over `most` of the text is a copy of
    the page and tells nothing about the site."""
    gone: set[int] = set()
    size = sum(sizes)
    for other in others:
        same = common_lines(lines, other)
        if sum(sizes[i] for i in same) <= most * size:
            gone |= same
    return gone


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = 512) -> DataFrame:
    """(id, url, text, n_chars): the main text of every page, one line a block, whole.

    Null html, or nothing left: empty text. Null urls have the empty host. All pages are sorted
    by (host, path, url, id) and compared with the pages before and after them of the same host; a task has a chunk
    of that order and the page on either side of it. Only 128-bit hashes of the lines go there, and only the places of deleted
    lines come back to the texts. Repeated rows are copies and delete nothing from each other; other columns are ignored.
    """
    kind = dict(pages.select(F.col(id_col).alias("id")).dtypes)["id"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [blocks(x) if x else (True, [], []) for x in pdf["html"]]
            yield pd.DataFrame({
                "id": pdf["id"], "url": pdf["url"], "host": pdf["host"], "path": pdf["path"],
                "lines": [x for _, x, _ in got], "keys": [[xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x, _, _ in told] for _, _, told in got],
                "sizes": [[len(x) for x, _, _ in told] for _, _, told in got],
                # A line's place among those of the text if it goes when shared, else -1.
                "may": [places(framed, told) for framed, _, told in got],
            })

    def places(framed: bool, told: list[tuple[str, bool, bool]]) -> list[int]:
        out, n = [], 0
        for _, inside, links in told:
            out.append(n if inside == framed and (links or not framed) else -1)
            n += inside == framed
        return out

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = now = None

        def out(left, row, right) -> list[tuple]:
            if row.chunk != row.home:  # only seen as a neighbour here
                return []
            near = [list(x.keys) for x in (left, right) if x is not None and x.host == row.host and x.chunk == row.chunk]
            gone = [int(row.may[i]) for i in sorted(shared_lines(list(row.keys), list(row.sizes), near)) if row.may[i] >= 0]
            return [(row.row, gone)] if gone else []

        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                if now is not None:
                    rows += out(before, now, row)
                before, now = now, row
            yield pd.DataFrame(rows, columns=["row", "gone"])
        if now is not None:
            yield pd.DataFrame(out(before, now, None), columns=["row", "gone"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    told = rows.mapInPandas(parse, f"id {kind}, url string, host string, path string, lines array<string>, keys array<binary>, sizes array<int>, may array<int>")
    parsed = written(told.withColumn("row", F.monotonically_increasing_id()), "blocks")
    order = ["host", "path", "url", "id"]
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = parsed.select(*order, "row", "keys", "sizes", "may").repartitionByRange(n, *order).sortWithinPartitions(*order)
    keyed = written(keyed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "keyed")
    before = offsets(keyed.groupBy("part").agg(F.count("*").alias("before")), "part", ["before"])
    # A row for each partition is joined, so the plan is the same however many there are.
    ranked = keyed.join(F.broadcast(before), "part").withColumn("rank", F.col("at").bitwiseAND(2**33 - 1) + F.col("before"))
    home = F.floor(F.col("rank") / chunk)
    around = F.array_distinct(F.array(F.floor((F.col("rank") - 1) / chunk), F.col("home"), F.floor((F.col("rank") + 1) / chunk)))
    dealt = ranked.withColumn("home", home).withColumn("chunk", F.explode(around)).repartition(n, "chunk").sortWithinPartitions("chunk", "rank")
    gone = dealt.select("row", "host", "keys", "sizes", "may", "home", "chunk").mapInPandas(pair, "row long, gone array<int>")
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    # Texts meet the places only where a line can go.
    can = F.coalesce(F.array_max("may"), F.lit(-1)) >= 0
    some = parsed.where(can).select("row", "id", "url", "lines").join(gone, "row", "left").select("id", "url", left.alias("lines"))
    whole = parsed.where(~can).select("id", "url", "lines").unionByName(some).withColumn("text", F.array_join("lines", "\n"))
    return whole.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
