"""Main text of pages by nearest-URL page differencing.

Pages of one host are ordered by URL path. Each page is paired with the
neighbour that shares the longer start of its path, the lines of both are
aligned by longest common subsequence, and lines that both have are template
text. Two articles can share a passage too, so a check of the element a line
stands in follows: shared lines go unless they stand in the article, and lines
in menus, forms and other furniture go even where the neighbour differs.

The order is a global range sort in slices, so a host with a third of all pages
is spread over many tasks; only hashes of lines travel, never texts.

A null or empty page has the text "". A page without URL, or alone on its host,
has no neighbour and is judged by its elements. Repeated rows give repeated
results. An empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.catalog import query, table
from pairloom.runtime import stage

# Elements and names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset(
    "aside button canvas datalist dialog fieldset footer form head header iframe input label map math "
    "menu nav noembed noframes noscript object script select style svg template textarea title".split()
)
FURNITURE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
    "toolbar".split()
)
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disclaimer footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notices pagination popup promo promoted promotion related replies respond "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
ARTICLE, FURNISHING, OTHER = 2, 0, 1

#: Bits of alignment rows held at once; longer alignments are split in halves.
ALIGN_BITS = 1 << 27

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[^a-z0-9]+")


def _zone(tag: str, attributes: str, around: int) -> int:
    """Zone of an element inside the zone ``around``."""
    if around == FURNISHING or tag in FURNITURE:
        return FURNISHING
    inside = ARTICLE if tag in ("article", "main") else around
    if not attributes or attributes.isspace():
        return inside
    found = {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    if role in FURNITURE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return FURNISHING
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return FURNISHING
    if tag not in ("html", "body"):
        names = set()
        for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
            if not name.startswith(("has-", "with-", "no-")):
                names.update(_NAME.split(name))
        if tag in ("article", "main"):
            names &= {"comment", "comments", "replies"}
        if names & FURNITURE_NAMES:
            return FURNISHING
    return ARTICLE if role in ("main", "article") or found.get("itemprop") == "articleBody" else inside


def page_lines(page: str | None) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with the zone it stands in."""
    lines: list[tuple[str, int]] = []
    if not page:
        return lines
    pieces: list[str] = []
    held: list[tuple[str, int]] = []  # open elements and the zones inside them
    zone = OTHER

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                lines.append((text, zone))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            text = page[at:upto]
            pieces.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                pieces.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, attributes = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag == "p" or any(t == tag for t, _ in held):
                if tag in BLOCK:
                    flush()
                for k in range(len(held) - 1, -1, -1):
                    if held[k][0] == tag:
                        inner = zone
                        zone = held[k - 1][1] if k else OTHER
                        del held[k:]
                        if zone != inner:
                            _split(pieces, lines, inner)
                        break
            continue
        if tag in BLOCK:
            flush()
            closes = ("p",) if tag != "li" else ("p", "li")
            for k in range(len(held) - 1, -1, -1):
                if held[k][0] in closes:
                    zone = held[k - 1][1] if k else OTHER
                    del held[k:]
                    break
                if held[k][0] in BLOCK:
                    break
        if tag in VOID:
            continue
        inner = _zone(tag, attributes, zone)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        if inner != zone:
            _split(pieces, lines, zone)
        held.append((tag, inner))
        zone = inner
    flush()
    return lines


def _split(pieces: list[str], lines: list[tuple[str, int]], zone: int) -> None:
    """End a block where an inline element changes the zone."""
    text = " ".join("".join(pieces).split())
    pieces.clear()
    if text:
        lines.append((text, zone))


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Alignment rows: in row i, bit j is 0 where b[j] lengthens the common subsequence of a[:i+1]."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def _lengths(row: int, n: int) -> np.ndarray:
    """Length of the common subsequence with every start of b, from an alignment row."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """For every element of ``a``: is it part of a longest common subsequence with ``b``?"""
    start, stop_a, stop_b = 0, len(a), len(b)
    while start < min(stop_a, stop_b) and a[start] == b[start]:
        start += 1
    while stop_a > start and stop_b > start and a[stop_a - 1] == b[stop_b - 1]:
        stop_a, stop_b = stop_a - 1, stop_b - 1
    flags = [True] * start + [False] * (stop_a - start) + [True] * (len(a) - stop_a)
    todo = [(start, stop_a, start, stop_b)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        x, y = a[a0:a1], b[b0:b1]
        if not x or not y:
            continue
        if len(x) * len(y) > ALIGN_BITS and len(x) > 1:
            middle = len(x) // 2
            head = _lengths(_last(x[:middle], y), len(y))
            tail = _lengths(_last(x[middle:][::-1], y[::-1]), len(y))[::-1]
            cut = int(np.argmax(head + tail))
            todo += [(a0, a0 + middle, b0, b0 + cut), (a0 + middle, a1, b0 + cut, b1)]
            continue
        rows = _rows(x, y)
        i, j = len(x) - 1, len(y) - 1
        while i >= 0 and j >= 0:
            if rows[i] >> j & 1:
                j -= 1
            elif i and not rows[i - 1] >> j & 1:
                i -= 1
            else:
                flags[a0 + i] = True
                i, j = i - 1, j - 1
    return flags


def _last(a: list[int], b: list[int]) -> int:
    """The last alignment row alone."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return row


def main_text(page: str | None, neighbour: list[int] | None) -> str:
    """Lines of the page that are neither shared template lines nor furniture."""
    lines = page_lines(page)
    flags = shared_lines([line_hash(t) for t, _ in lines], neighbour or []) if lines else []
    has_article = any(zone == ARTICLE for _, zone in lines)
    wanted = ARTICLE if has_article else OTHER
    return " ".join(
        text
        for (text, zone), shared in zip(lines, flags)
        if zone == wanted and (zone == ARTICLE or not shared)
    )


def _line_hashes(page: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def hashes(pages: pd.Series) -> pd.Series:
        return pd.Series([[line_hash(t) for t, _ in page_lines(p)] for p in pages], dtype=object)

    return hashes(page)


def _main_text(page: Column, neighbour: Column) -> Column:
    @F.pandas_udf("string")
    def text(pages: pd.Series, neighbours: pd.Series) -> pd.Series:
        return pd.Series(
            [main_text(p, None if n is None else [int(x) for x in n]) for p, n in zip(pages, neighbours)],
            dtype=object,
        )

    return text(page, neighbour)


def _common_start(a: Column, b: Column) -> Column:
    """Path segments that two URLs share from the left."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda s: F.coalesce(s["x"] == s["y"], F.lit(False)))
    place = F.array_position(same, F.lit(False))
    return F.when(b.isNull(), -1).otherwise(F.when(place == 0, F.size(same)).otherwise(place - 1))


def neighbours(pages: DataFrame) -> DataFrame:
    """``page_id, url, version, neighbour`` of the distinct rows of ``page_id, url,
    version, lines``: the line hashes of the nearest page of the same host.

    Slices of the global order are pinned on shared storage; the pages at their
    edges, two per slice, take their neighbour from the next slice's edge.
    """
    spark = pages.sparkSession
    whole = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
    keyed = pages.select(
        "*",
        F.lower(F.regexp_extract("url", whole, 1)).alias("host"),
        F.regexp_extract("url", whole, 2).alias("path"),
    ).where(F.length("host") > 0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "url", "page_id", "version"]
    sliced = stage(
        keyed.repartitionByRange(parts, *order).withColumn("slice", F.spark_partition_id()), "page-slices"
    )
    inside = Window.partitionBy("slice").orderBy(*order)
    near = F.struct("host", "path", "lines")
    placed = sliced.select(
        "*", F.lag(near).over(inside).alias("before"), F.lead(near).over(inside).alias("after")
    )
    # One row per slice: its first and its last page.
    first = F.min_by(near, F.struct(*order))
    last = F.max_by(near, F.struct(*order))
    edges = sliced.groupBy("slice").agg(first.alias("first"), last.alias("last"))
    by_slice = Window.orderBy("slice")
    edges = edges.select(
        "slice",
        F.lag("last").over(by_slice).alias("edge_before"),
        F.lead("first").over(by_slice).alias("edge_after"),
    )
    placed = placed.join(edges, "slice").select(
        "page_id",
        "url",
        "version",
        "host",
        "path",
        F.coalesce("before", "edge_before").alias("before"),
        F.coalesce("after", "edge_after").alias("after"),
    )

    def closeness(side: str) -> Column:
        other = F.col(side)
        return F.when(other["host"] == F.col("host"), _common_start(F.col("path"), other["path"])).otherwise(-1)

    return placed.select(
        "page_id",
        "url",
        "version",
        F.when((closeness("before") < 0) & (closeness("after") < 0), None)
        .when(closeness("after") > closeness("before"), F.col("after")["lines"])
        .otherwise(F.col("before")["lines"])
        .alias("neighbour"),
    )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    named = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.col(html).alias("html"),
        F.xxhash64(F.col(html)).alias("version"),
    )
    lines = named.where(F.col("url").isNotNull()).select(
        "page_id", "url", "version", _line_hashes(F.col("html")).alias("lines")
    )
    near = neighbours(lines.dropDuplicates(["page_id", "url", "version"]))
    joined = named.alias("p").join(
        near.alias("n"),
        F.col("p.page_id").eqNullSafe(F.col("n.page_id"))
        & (F.col("p.url") == F.col("n.url"))
        & (F.col("p.version") == F.col("n.version")),
        "left",
    )
    return joined.select(
        "p.page_id", "p.url", _main_text(F.col("p.html"), F.col("n.neighbour")).alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))


@query("op1_html_text")
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
