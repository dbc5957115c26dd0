"""Line dedup by site-relative frequency.

For every host the pages that hold a line are divided by the host's pages; lines above the ratio are
boilerplate of that host and are dropped from its pages.  Distinct lines of a page are counted once,
folded before the shuffle.  What goes back to the pages is one list of line hashes per host: as each
counted line needs more than ``ratio`` of the host's pages, a list has at most (mean distinct lines
per page) / ratio entries.

Copies of a page are no evidence of boilerplate.  :func:`folded_boilerplate` counts equal pages, and
pages that share most of their text with others, as one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook.llm.common import free_name, staged, text_of

#: A line on more than this share of its host's pages, and on at least so many pages, is boilerplate.
RATIO = 0.1
LEAST_PAGES = 5
#: The share for folded counts, where it is enough to be reached: a line on every fiftieth different page
#: of a host is part of its frame.  Copies do not raise the count, so the share can be this low.
FOLDED_RATIO = 0.02


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _host(column: str) -> Column:
    """Null-free form of the host: '=name', or the empty string for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def boilerplate(
    pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, host_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """host, pages, lines: per host with boilerplate its size and the hashes of the lines to drop.

    Lines are compared as they are, without surrounding blanks; blank lines are never boilerplate.
    Pages without a host form a host of their own.
    """
    hosted = pages.select(_host(host_col).alias("host"), text_of(text_col).alias("text"))
    sizes = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hashes = F.array_distinct(F.transform(_lines(F.col("text")), lambda line: F.when(F.trim(line) != "", F.xxhash64(F.trim(line)))))
    holding = (
        hosted.select("host", F.explode(hashes).alias("line"))
        .where(F.col("line").isNotNull())
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("holding"))
        .where(F.col("holding") >= least_pages)
    )
    return (
        holding.join(sizes, "host")
        .where(F.col("holding") > F.col("pages") * F.lit(ratio))
        .groupBy("host")
        .agg(F.first("pages").alias("pages"), F.sort_array(F.collect_list("line")).alias("lines"))
    )


def folded_boilerplate(
    pages: DataFrame, ratio: float = FOLDED_RATIO, least_pages: int = LEAST_PAGES, host_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """host, pages, lines as in :func:`boilerplate`, with copies of a page counted as one page.

    Pages of a host with the same set of lines are one page.  A line on ``least_pages`` of these is
    common; a page that has more than half of its characters in common lines is a copy and is counted
    under the rarest of them (then the least hash).  Copies of one page that differ by e lines each
    are so counted at most e + 1 times, however many they are, and no two pages are ever compared.  A line is
    boilerplate if ``ratio`` of the pages so counted hold it, and ``least_pages`` at least.  Pages
    without lines are one page of their host.
    """
    line = F.transform(
        _lines(F.col("text")), lambda x: F.struct(F.xxhash64(F.trim(x)).alias("line"), F.length(F.trim(x)).alias("chars"))
    )
    held = F.array_sort(F.array_distinct(F.filter(line, lambda x: x.chars > 0)))
    # Only hashes move: equal pages meet under the digest of their lines, one row a task.
    distinct = staged(
        pages.select(_host(host_col).alias("host"), text_of(text_col).alias("text"))
        .select("host", held.alias("held"))
        .groupBy("host", F.sha2(F.to_json(F.col("held.line")), 256).alias("page"))
        .agg(F.first("held").alias("held")),
        "distinct-pages",
    )
    chars = F.aggregate("held", F.lit(0).cast("long"), lambda total, x: total + x.chars)
    rows = distinct.select("host", "page", chars.alias("page_chars"), F.inline("held"))
    common = rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("holding")).where(F.col("holding") >= least_pages)
    marked = staged(
        rows.join(common, ["host", "line"])
        .groupBy("host", "page")
        .agg(
            (F.sum("chars") * 2 > F.first("page_chars")).alias("copy"),
            F.min(F.struct("holding", "line")).getField("line").cast("string").alias("rarest"),
            F.collect_list("line").alias("lines"),
        )
        .select("host", "copy", F.when(F.col("copy"), F.col("rarest")).otherwise(F.col("page")).alias("unit"), "lines"),
        "common-lines",
    )
    spare = (
        marked.where("copy")
        .groupBy("host", "unit")
        .count()
        .groupBy("host")
        .agg((F.sum("count") - F.count(F.lit(1))).alias("spare"))
    )
    sizes = (
        distinct.groupBy("host")
        .agg(F.count(F.lit(1)).alias("all"))
        .join(spare, "host", "left")
        .select("host", (F.col("all") - F.coalesce("spare", F.lit(0))).alias("pages"))
    )
    holding = (
        marked.select("host", "unit", F.explode("lines").alias("line"))
        .distinct()
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("holding"))
        .where(F.col("holding") >= least_pages)
    )
    return (
        holding.join(sizes, "host")
        .where(F.col("holding") >= F.col("pages") * F.lit(ratio))
        .groupBy("host")
        .agg(F.first("pages").alias("pages"), F.sort_array(F.collect_list("line")).alias("lines"))
    )


def drop_boilerplate(
    pages: DataFrame,
    ratio: float | None = None,
    least_pages: int = LEAST_PAGES,
    spare_copies: bool = False,
    fold_copies: bool = False,
    host_col: str = "source",
    text_col: str = "text",
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``pages`` with the boilerplate lines gone from the text, all columns and rows kept.

    With ``fold_copies`` the copies of a page count as one (:func:`folded_boilerplate`).
    With ``spare_copies`` a page that would lose all its lines stays as it is: it is a copy of a whole
    page rather than a page with boilerplate, which is for the duplicate operators to decide.  A null
    text stays null.  Line ends are "\\n"; the rest of a kept line is untouched.  ``counts`` names two
    columns to add: lines with text, and lines dropped.
    """
    count, usual = (folded_boilerplate, FOLDED_RATIO) if fold_copies else (boilerplate, RATIO)
    bad = staged(count(pages, usual if ratio is None else ratio, least_pages, host_col, text_col), "boilerplate")
    host, drop = free_name(pages, "_host"), free_name(pages, "_drop")
    bad = bad.select(F.col("host").alias(host), F.col("lines").alias(drop))
    lines = _lines(F.col(text_col))
    is_bad = lambda line: F.array_contains(F.col(drop), F.xxhash64(F.trim(line)))
    has_text = lambda line: F.trim(line) != ""
    kept = F.filter(lines, lambda line: ~is_bad(line) | ~has_text(line))
    text = F.array_join(kept, "\n")
    if spare_copies:
        text = F.when(F.exists(kept, has_text), text).otherwise(F.col(text_col))
    text = F.when(F.col(drop).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(text)
    marked = pages.withColumn(host, _host(host_col)).join(bad, host, "left")
    added = []
    if counts:
        full = F.filter(F.coalesce(lines, F.array().cast("array<string>")), has_text)
        gone = F.when(F.col(drop).isNull(), 0).otherwise(F.size(F.filter(full, is_bad)))
        added = [F.size(full).alias(counts[0]), gone.alias(counts[1])]
    return marked.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in pages.columns], *added)
