"""Line deduplication by site-relative frequency, with DataFrame functions only.

Pages are grouped by host. A line whose share of its host's pages exceeds `max_ratio` (and that stands on at least
`min_pages` of them) is boilerplate and is dropped from every page of that host.

Plan. A page contributes each distinct line once, as two independent 64-bit hashes (16 bytes instead of the text), so
the one wide exchange carries hashes only and is pre-aggregated by (host, line). A host keeps fewer than
(mean lines a page) / max_ratio boilerplate lines, whatever its page count, so they fit an array per host. The texts
themselves are not shuffled while the table of arrays is small (its rows and bytes are counted first); beyond that it is
joined by host, where adaptive skew handling splits a hot host, as pages are not grouped afterwards.

Copies. Where copies have not been dropped before, `copies_once` counts a host's pages of equal text as one page: else a
text with copies on over `max_ratio` of a host's pages would lose all its lines, in every copy. Near copies are folded in
a second count, over the lines that the first found. A page of which those lines hold `COPIED` of the characters or more
is a suspect: such pages are one page by their signature, the smallest hash among their found lines. Near copies of one
text differ in few lines, so a group has at most one signature more than the lines in which its members differ, however
many they are. A line then stays boilerplate only if enough different pages and groups carry it. Counts are of distinct
(host, line, page), which spreads a common line over tasks.

Defined cases: null text is empty; a null host is the empty host; white space around a line is ignored when lines are
compared, and blank lines neither count nor go; every row counts as a page, repeated ids included; a text that loses
nothing comes back byte for byte, null included; an empty table gives an empty result; all other columns are kept, also
those whose names clash with the ones that this module uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, fresh, small

MAX_RATIO = 0.1
MIN_PAGES = 3
#: Share of a page's characters in lines above the ratio from which on it may be a near copy.
COPIED = 0.6


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def _over(lined: DataFrame, paged: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, drop: array of hash pairs): the lines above the ratio. lined: (host, line) for each page; paged: (host) for each page."""
    counts = lined.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    totals = paged.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    over = counts.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    return over.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("drop"))


def _bounded(found: DataFrame) -> DataFrame:
    """The table of arrays, to be broadcast if its bytes allow it."""
    return small(found, 20_000, 40 + F.length("host") + 40 * F.size("drop"))


def boilerplate(pages: DataFrame, host: Column, lines: Column, max_ratio: float, min_pages: int, page: Column | None = None) -> DataFrame:
    """(host, drop: array of hash pairs) of the lines above the ratio. Pages with one value of `page` count as one, and
    near copies do so too, as far as the module's docstring says."""
    one = [] if page is None else ["page"]
    named = pages.select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), lines.alias("lines"), *([] if page is None else [page.alias("page")]))
    keys = F.filter(F.array_distinct(F.transform("lines", _key)), lambda x: x != "")
    seen = named.select("host", *one, F.explode(keys).alias("key")).select("host", *one, _hashes(F.col("key")).alias("line"))
    if page is None:
        return _over(seen, named.select("host"), max_ratio, min_pages)

    first = _bounded(cut(_over(seen.distinct(), named.select("host", "page").distinct(), max_ratio, min_pages)))
    hit = named.join(first, "host", "left").select("host", "page", keys.alias("keys"), F.coalesce("drop", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("drop"))
    hit = hit.select("host", "page", "keys", F.filter("keys", lambda x: F.array_contains(F.col("drop"), _hashes(x))).alias("found"))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    suspect = (F.size("found") > 0) & (chars("found") >= COPIED * chars("keys"))
    marks = F.transform("found", _hashes)
    hit = hit.select("host", F.struct(suspect.alias("copied"), F.when(suspect, F.array_min(marks).getField("a")).otherwise(F.col("page")).alias("is")).alias("page"), marks.alias("found"))
    hit = cut(hit)  # a hash pair for each found line: small beside the texts
    again = hit.select("host", "page", F.explode("found").alias("line")).distinct()
    return _over(again, hit.select("host", "page").distinct(), max_ratio, min_pages)


def line_dedup(pages: DataFrame, text: str = "text", host: Column | str = "source", lines: Column | None = None, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False, counts: tuple[str, str] = ("__lines", "__dropped")) -> DataFrame:
    """pages with `text` cleaned, and two columns named by `counts` (lines before, lines dropped) appended. `lines` may
    give another way to part a page into lines; they are joined by newlines again."""
    host = F.col(host) if isinstance(host, str) else host
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n") if lines is None else lines
    page = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if copies_once else None
    h, every, drop, keep, of = fresh(pages, "page_host", "page_lines", "page_drop", "page_keep", "host_of_lines")
    found = cut(boilerplate(pages, host, lines, max_ratio, min_pages, page))
    table = _bounded(found).select(F.col("host").alias(of), F.col("drop").alias(drop))
    rows = pages.withColumns({h: F.coalesce(host.cast("string"), F.lit("")), every: lines}).join(table, F.col(h) == F.col(of), "left")
    left = F.filter(every, lambda x: (_key(x) == "") | ~F.array_contains(F.col(drop), _hashes(_key(x))))
    rows = rows.withColumn(keep, F.when(F.col(drop).isNull(), F.col(every)).otherwise(left))
    dropped = F.size(every) - F.size(keep)
    cleaned = F.when(dropped == 0, F.col(text)).otherwise(F.array_join(keep, "\n")).alias(text)
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    return rows.select(*(cleaned if c == text else quoted(c) for c in pages.columns), F.size(every).cast("long").alias(counts[0]), dropped.cast("long").alias(counts[1]))


def html_lines(html: str = "html") -> Column:
    """Non-blank, trimmed pieces of text between the tags of a page; scripts, styles and comments are left out."""
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "\n")
    bare = F.regexp_replace(bare, r"<[^>]*>", "\n")
    return F.filter(F.transform(F.split(bare, "\n"), _key), lambda x: x != "")


def page_host(url: str = "url") -> Column:
    """Host of a URL in lower case, '' if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_line_dedup(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text) of raw web pages."""
    rows = pages.select("page_id", page_host().alias("host"), html_lines().alias("lines")).withColumn("text", F.array_join("lines", "\n"))
    done = line_dedup(rows, "text", "host", F.col("lines"), max_ratio, min_pages, counts=("n_lines", "n_dropped"))
    return done.select("page_id", "host", "n_lines", "n_dropped", "text")


ORACLE = rf"""
WITH bare AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS t
  FROM pages),
p AS (SELECT page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x != '') AS lines, row_number() OVER () AS r FROM bare),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT r, host, unnest(lines) AS line FROM p) GROUP BY host, line),
b AS (SELECT host, list(line) AS bad FROM c JOIN n USING (host) WHERE c.n >= {MIN_PAGES} AND c.n > {MAX_RATIO}::DOUBLE * pages GROUP BY host),
k AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""
