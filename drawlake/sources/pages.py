"""Draws out of landed result pages (page_id, url, html, lottery_type, month)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from drawlake.functions.arrays import first_numbers
from drawlake.functions.text import ascii_digits, drop_invisible, normalise_page, visible_text
from drawlake.operators.pin import pin
from drawlake.operators.validate import number_errors
from drawlake.spec import POOLS, PoolSpec, by_pool, clean_type, is_known_type

# Labels and shapes of the result pages.
ROW_PATTERN = r"^第0*(\d+)回\s+(\d{4}/\d{2}/\d{2})\s*\|\s*([\d ]+)\s*\|\s*([\d ]+)$"
CELL_LABEL = r"^第0*(\d+)回$"
BLOCK_LABEL = "回号"
# A row ends at its closing tag, or where the next row, the table's end or the page's end comes first.
TABLE_ROW = r"(?is)(<tr\b[^>]*>.*?)(?=</?tr\b|</table\b|\z)"


def block_pattern(pool: PoolSpec) -> str:
    """Fixed shape of one labelled block; the counts come from the pool."""
    return (
        rf"{BLOCK_LABEL}\s*第0*(\d+)回\s*"
        r"抽せん日\s*(\d{4}/\d{2}/\d{2})\s*"
        rf"本数字\s*((?:\d+\s+){{{pool.pick - 1}}}\d+)\s*"
        rf"ボーナス数字\s*((?:\(?\d+\)?\s*){{{pool.bonus}}})"
    )


def month_spine(spark: SparkSession, ranges: DataFrame) -> DataFrame:
    """One row per (lottery_type, month) between two dates: month text and page key."""
    month = F.explode(
        F.sequence(F.trunc("start_date", "MM"), F.trunc("end_date", "MM"), F.expr("interval 1 month"))
    )
    return ranges.select("lottery_type", month.alias("_month")).select(
        "lottery_type",
        F.date_format("_month", "yyyyMM").alias("month"),
        F.concat_ws("/", "lottery_type", F.date_format("_month", "yyyyMM")).alias("page_key"),
    )


def missing_months(spine: DataFrame, pages: DataFrame) -> DataFrame:
    """Months without a landed page."""
    landed = pages.select(clean_type("lottery_type").alias("lottery_type"), "month").distinct()
    return spine.join(landed, ["lottery_type", "month"], "left_anti")


def _draw(kind: Column, no: Column, day: Column, main: Column, bonus: Column) -> Column:
    return F.struct(
        no.try_cast("bigint").alias("draw_no"),
        F.replace(day, F.lit("/"), F.lit("-")).alias("draw_date"),
        first_numbers(main, by_pool(kind, "pick")).alias("main_numbers"),
        first_numbers(bonus, by_pool(kind, "bonus")).alias("bonus_numbers"),
    )


def _complete(draws: Column) -> Column:
    return F.filter(draws, lambda d: d["main_numbers"].isNotNull() & d["bonus_numbers"].isNotNull())


def labelled_draws(kind: Column, html: Column) -> Column:
    """Draws from labelled blocks in the page text."""
    text = normalise_page(visible_text(html, "\n"))

    def blocks(pool: PoolSpec) -> Column:
        pattern = block_pattern(pool)
        return F.transform(
            F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)),
            lambda b: _draw(kind, *[F.regexp_extract(b, pattern, g) for g in (1, 2, 3, 4)]),
        )

    first, second = POOLS
    return _complete(F.when(kind == first, blocks(POOLS[first])).otherwise(blocks(POOLS[second])))


def table_rows(html: Column) -> Column:
    """Text of each table row, cells joined by `` | ``."""
    return F.transform(
        F.regexp_extract_all(html, F.lit(TABLE_ROW), F.lit(1)),
        lambda r: ascii_digits(F.regexp_replace(visible_text(r, " | "), r"[\s\x{00a0}\x{3000}]+", " ")),
    )


def row_draws(kind: Column, html: Column) -> Column:
    """Draws from ``label date | mains | bonuses`` table rows."""
    matching = F.filter(table_rows(html), lambda r: r.rlike(ROW_PATTERN))
    return _complete(
        F.transform(
            matching,
            lambda r: _draw(kind, *[F.regexp_extract(r, ROW_PATTERN, g) for g in (1, 2, 3, 4)]),
        )
    )


def _known_pool(pages: DataFrame) -> DataFrame:
    return pages.withColumn("lottery_type", clean_type("lottery_type")).filter(is_known_type("lottery_type"))


def unknown_pool_pages(pages: DataFrame) -> DataFrame:
    """Pages whose pool is missing or unknown: the rejects of the page readers."""
    return pages.filter(~is_known_type(clean_type("lottery_type"))).select("page_id", "lottery_type", "url")


def _may_hold(label: str) -> Column:
    """Most pages of a crawl hold no draw; a substring test skips their parsing.

    A label may also be written as a numeric reference.
    """
    return F.col("html").contains(label) | F.col("html").contains("&#")


def page_draws(pages: DataFrame, *, strict_page: bool = False) -> DataFrame:
    """Every draw found, with its page, position and ``errors``.

    Labelled text first; table rows only if that found nothing. Parsing stays
    inside the row of its page, so no shuffle. ``strict_page`` drops a page
    that holds any invalid draw, otherwise the rows carry their errors. Pages of
    an unknown pool have no row form; ``unknown_pool_pages`` lists them.
    """
    kind = F.col("lottery_type")
    candidates = _known_pool(pages).filter(_may_hold("第") & _may_hold("回"))
    readable = pin(candidates, _html=drop_invisible(F.col("html")))
    # Blocks begin with this label; most pages have rows only.
    block = F.col("_html").contains(BLOCK_LABEL) | F.col("_html").contains("&#")
    labelled = pin(readable, _full=F.when(block, labelled_draws(kind, F.col("_html"))))
    found = F.when(F.size("_full") > 0, F.col("_full")).otherwise(row_draws(kind, F.col("_html")))
    parsed = pin(labelled, _found=found).select(
        "page_id", "lottery_type", "month", F.col("url").alias("source_url"), "_found"
    )

    def errors(d: Column) -> Column:
        return number_errors(d["main_numbers"], d["bonus_numbers"], kind, d["draw_no"], d["draw_date"])

    if strict_page:
        parsed = parsed.filter(F.forall("_found", lambda d: F.size(errors(d)) == 0))
    # Draws are judged as rows of their own, by a compiled projection.
    page = ["page_id", "lottery_type", "month", "source_url"]
    rows = parsed.select(*page, F.posexplode("_found").alias("pos", "_draw"))
    return rows.select(*page, "pos", "_draw.*", errors(F.col("_draw")).alias("errors"))


def latest_page_draws(pages: DataFrame) -> DataFrame:
    """First well-formed row of each page whose cells hold one value each.

    Six-pick rows have exactly nine cells, seven-pick rows at least eleven. A draw
    that breaks the rules of its pool carries its ``errors``.
    """
    kind = F.col("lottery_type")
    pick, bonus = by_pool(kind, "pick"), by_pool(kind, "bonus")

    def parse(cells: Column) -> Column:
        values = F.transform(F.slice(cells, F.lit(3), pick + bonus), lambda c: c.try_cast("int"))
        fits = F.when(kind == "loto6", F.size(cells) == 9).otherwise(F.size(cells) >= 11)
        label = F.get(cells, F.lit(0)).rlike(CELL_LABEL)
        return F.when(
            label & fits & F.forall(values, lambda v: v.isNotNull()),
            F.struct(
                F.regexp_extract(F.get(cells, F.lit(0)), CELL_LABEL, 1).try_cast("bigint").alias("draw_no"),
                F.replace(F.get(cells, F.lit(1)), F.lit("/"), F.lit("-")).alias("draw_date"),
                F.slice(values, F.lit(1), pick).alias("main_numbers"),
                F.slice(values, pick + 1, bonus).alias("bonus_numbers"),
            ),
        )

    rows = pin(_known_pool(pages).filter(_may_hold("第")), _rows=table_rows(drop_invisible(F.col("html"))))
    parsed = F.array_compact(
        F.transform(
            F.filter("_rows", lambda r: r.startswith("第")),
            lambda r: parse(F.filter(F.transform(F.split(r, r"\|"), lambda c: F.trim(c)), lambda c: c != "")),
        )
    )
    found = (
        pin(rows, _draw=F.get(parsed, F.lit(0)))
        .filter(F.col("_draw").isNotNull())
        .select("page_id", "lottery_type", F.col("url").alias("source_url"), "_draw.*")
    )
    errors = number_errors(*(F.col(c) for c in ("main_numbers", "bonus_numbers", "lottery_type", "draw_no", "draw_date")))
    return found.withColumn("errors", errors)


def keep_last(found: DataFrame) -> DataFrame:
    """One row per draw: the later month wins, then the later position in the page."""
    rest = [c for c in found.columns if c not in ("lottery_type", "draw_no")]
    return (
        found.groupBy("lottery_type", "draw_no")
        .agg(F.max_by(F.struct(*rest), F.struct("month", "pos")).alias("_row"))
        .select("lottery_type", "draw_no", "_row.*")
    )


def harvest(
    pages: DataFrame, start: str | None = None, end: str | None = None, *, strict_page: bool = False
) -> DataFrame:
    """Valid draws of the landed pages in a date range, one row per draw number."""
    if start and end and start > end:
        raise ValueError("the range ends before it starts")
    found = page_draws(pages, strict_page=strict_page).filter(F.size("errors") == 0).drop("errors")
    dated = found.withColumn("draw_date", F.to_date("draw_date"))
    if start:
        dated = dated.filter(F.col("draw_date") >= F.to_date(F.lit(start)))
    if end:
        dated = dated.filter(F.col("draw_date") <= F.to_date(F.lit(end)))
    return keep_last(dated).select(
        "lottery_type", "draw_no", "draw_date", "main_numbers", "bonus_numbers", "source_url"
    )
