"""Line dedup by site-relative frequency: lines that too many pages of a host carry are boilerplate.

Per host, the pages that contain a line are divided by the host's pages; a line whose share exceeds `ratio`, on at
least `least` pages, is dropped from all pages of that host. Pages with equal text count once, so that a page with
many copies is not taken for a template. DataFrame functions only.

**Scale.** Lines are counted as 16-byte digests with map-side aggregation, distinct (host, line, page) first, so neither
a hot host nor a hot line meets in one task. The lines to drop are few by definition: the shares of a host's lines sum
to its mean number of lines a page, so fewer than that mean divided by `ratio` exceed the ratio. They are gathered to
one row per host and written once; that table is broadcast if it is at most `BROADCAST_LINES` digests, and otherwise
joined by host, where adaptive execution splits a hot host. Texts are never shuffled in the first case.

**Cases.** Lines are compared without surrounding white space; empty lines are never boilerplate and stay. Null texts
stay null, pages with a null host form one site. Copies and ties are treated alike. Other columns stay as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.llm.columns import set_aside
from runweave.llm.storage import checkpointed

RATIO = 0.1
LEAST = 3
BROADCAST_LINES = 200_000
BLANK = " \t\n\x0b\x0c\r"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def html_text(html: Column) -> Column:
    """Text of a page with a line for each block element; tags, scripts, styles and comments are left out."""
    hidden = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
    block = (r"(?i)</?(?:html|head|title|body|p|div|br|hr|li|ul|ol|dl|dt|dd|nav|h1|h2|h3|h4|h5|h6|article|section|aside|main"
             r"|header|footer|table|tr|td|th|pre|blockquote|form)\b[^>]*>")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, hidden, ""), block, "\n"), r"<[^>]*>", "")


def digest_of(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line, F.lit(BLANK)).cast("binary")))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """_host, _drop: digests of the lines to drop, one row per host that has any. Written to the shared folder."""
    page = pages.select(F.coalesce(host, F.lit("")).alias("_host"), F.unhex(F.md5(text.cast("binary"))).alias("page"), text.alias("text"))
    # a null text has no lines; a filter would be moved below the text's own expressions and work them out a second time
    # one more empty line for each page: the pages that have it are all pages
    line = page.select("_host", "page", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split("text", "\n")))).alias("line"))
    line = line.select("_host", "page", digest_of(F.col("line")).alias("line"))
    empty = digest_of(F.lit(""))
    seen = line.groupBy("_host", "line").agg(F.count_distinct("page").alias("n"))
    seen = checkpointed(seen.filter((F.col("n") >= least) | (F.col("line") == empty)))
    totals = seen.filter(F.col("line") == empty).select("_host", F.col("n").alias("pages"))
    common = seen.filter(F.col("line") != empty).join(totals, "_host").filter((F.col("n") > ratio * F.col("pages")) & (F.col("n") >= least))
    return checkpointed(common.groupBy("_host").agg(F.collect_set("line").alias("_drop")))


def split_lines(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """Columns of pages (none named `_host`, `_drop`, `lines` or `kept`) and `lines` (all), `kept` (those that stay); both null where the text is null."""
    drop = boilerplate(pages, host, text, ratio, least)
    size = drop.agg(F.sum(F.size("_drop"))).first()[0] or 0
    drop = F.broadcast(drop) if size <= BROADCAST_LINES else drop
    joined = pages.withColumn("_host", F.coalesce(host, F.lit(""))).join(drop, "_host", "left").withColumn("lines", F.split(text, "\n"))
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("_drop"), digest_of(x)))
    return joined.withColumn("kept", F.when(F.col("_drop").isNull(), F.col("lines")).otherwise(kept)).select(*pages.columns, "lines", "kept")


def deduplicated(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """The columns of docs with boilerplate lines taken out of the text; `n_chars`, where there is one, follows."""
    rows, restored = set_aside(docs, *dict.fromkeys([host, text]))
    out = split_lines(rows, F.col(host), F.col(text), ratio, least)
    out = restored(out.withColumn(text, F.array_join("kept", "\n")))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(pages: DataFrame) -> DataFrame:
    """page_id, host, n_lines, n_dropped and sha256 of what is left of each page's text."""
    source = pages.select("page_id", host_of(F.col("url")).alias("host"), html_text(F.col("html")).alias("text"))
    out = split_lines(source, F.col("host"), F.col("text"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(size("lines")).cast("bigint")
    n_kept = F.when(F.col("kept").isNull(), 0).otherwise(size("kept")).cast("bigint")
    return out.select(
        "page_id", "host", n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"),
        F.sha2(F.coalesce(F.array_join("kept", "\n"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
