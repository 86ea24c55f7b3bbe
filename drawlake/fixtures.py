"""Input views derived from the generated star-schema tables.

Each order becomes one draw, each event one queue message. The derivations
are plain projections, so the work of every query grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from drawlake.functions.arrays import wide_bonus, wide_main
from drawlake.spec import by_pool

URL_ROOT = "https://example.com/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draw per order; ten series (pool x order priority); draw_no is unique.

    Pool sizes are prime, so stepping through a pool never repeats a number.
    """
    orders = table(spark, sf_dir, "orders")
    base = orders.select(
        F.when(F.col("o_orderkey") % 2 == 0, "loto6").otherwise("loto7").alias("lottery_type"),
        (F.col("o_orderkey") + 1).alias("draw_no"),
        F.col("o_orderdate").cast("date").alias("draw_date"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("start"),
        F.floor("o_totalprice").cast("bigint").alias("price"),
    )
    pool = by_pool("lottery_type", "high")
    step = F.lit(1) + F.col("price") % (pool - 1)
    numbers = F.array(
        *[((F.col("start") + F.lit(i) * step) % pool + 1).cast("int") for i in range(9)]
    )
    pick = by_pool("lottery_type", "pick")
    return base.select(
        F.concat_ws(":", "lottery_type", "priority").alias("series"),
        "lottery_type",
        "draw_no",
        "draw_date",
        F.slice(numbers, F.lit(1), pick).alias("main_numbers"),
        F.slice(numbers, pick + 1, by_pool("lottery_type", "bonus")).alias("bonus_numbers"),
        F.concat(F.lit(URL_ROOT), "lottery_type", F.lit("/"), F.col("draw_no")).alias("source_url"),
        "status",
    )


def wide_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = draws(spark, sf_dir)
    return d.select(
        "series",
        "lottery_type",
        "draw_no",
        "draw_date",
        *wide_main(F.col("main_numbers")),
        *wide_bonus(F.col("bonus_numbers")),
        "source_url",
        "status",
    )


def faulty_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw, with one kind of fault planted in seven of fifty rows."""
    d = draws(spark, sf_dir)
    slot = F.floor(F.col("draw_no") / 2).cast("bigint") % 50
    main = F.col("main_numbers")
    bonus = F.col("bonus_numbers")
    return d.select(
        "series",
        F.when(slot == 5, "mini").otherwise(F.col("lottery_type")).alias("lottery_type"),
        F.when(slot == 3, -F.col("draw_no")).otherwise(F.col("draw_no")).alias("draw_no"),
        F.when(slot == 4, "2026-02-30")
        .otherwise(F.col("draw_date").cast("string"))
        .alias("draw_date"),
        F.when(slot == 0, _replace_last(main, main.getItem(0)))
        .when(slot == 1, _replace_last(main, F.lit(99)))
        .otherwise(main)
        .alias("main_numbers"),
        F.when(slot == 2, F.slice(bonus, F.lit(1), F.size(bonus) - 1))
        .when(slot == 6, F.concat(F.slice(bonus, F.lit(1), F.size(bonus) - 1), F.slice(main, 1, 1)))
        .otherwise(bonus)
        .alias("bonus_numbers"),
        "source_url",
    )


def _replace_last(numbers: Column, value: Column) -> Column:
    return F.concat(F.slice(numbers, F.lit(1), F.size(numbers) - 1), F.array(value.cast("int")))


def written_pools(rows: DataFrame) -> DataFrame:
    """Pool names as people write them: padded, upper case, unknown, missing."""
    kind = F.col("lottery_type")
    return rows.withColumn(
        "lottery_type",
        F.when(F.col("draw_no") % 31 == 0, "mini")
        .when(F.col("draw_no") % 37 == 0, F.lit(None))
        .when(F.col("draw_no") % 29 == 0, F.concat(F.lit(" "), F.upper(kind), F.lit(" ")))
        .otherwise(kind),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws already imported: those of closed and partly shipped orders."""
    return draws(spark, sf_dir).filter(F.col("status").isin("F", "P"))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import batch: every draw again, and one row without draw_no per open order."""
    d = draws(spark, sf_dir)
    unnumbered = d.filter(F.col("status") == "O").withColumn(
        "draw_no", F.lit(None).cast("bigint")
    )
    return d.unionByName(unnumbered)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue messages built from events: four envelope shapes plus broken JSON."""
    events = table(spark, sf_dir, "events")
    event_id = F.col("event_id")
    day = F.col("ts").cast("date").cast("string")
    kind = F.when(event_id % 2 == 0, "loto6").otherwise("loto7")
    shape = F.floor(event_id / 2).cast("bigint") % 4
    body = F.to_json(
        F.struct(
            F.md5(F.concat_ws("|", F.col("user_id").cast("string"), day)).alias("execution_id"),
            F.concat(F.lit(" "), F.upper(kind)).alias("lottery_type"),
            F.lit("raw").alias("gcs_bucket"),
            F.concat(kind, F.lit("/draw_no="), event_id + 1, F.lit("/part.csv")).alias("gcs_object"),
            (event_id + 1).alias("draw_no"),
        )
    )
    packed = F.base64(body.cast("binary"))
    value = (
        F.when(event_id % 97 == 0, F.lit('{"lottery_type": '))
        .when(shape == 0, body)
        .when(shape == 1, F.to_json(F.struct(F.struct(packed.alias("data")).alias("message"))))
        .when(shape == 2, F.to_json(F.struct(packed.alias("data"))))
        .otherwise(F.to_json(F.struct(F.struct(body.alias("note"), packed.alias("data")).alias("message"))))
    )
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        "event_type",
        value.cast("binary").alias("value"),
    )


def odd_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per event: every accepted way to name a file, a flag and an execution, every kind of dead letter."""
    i = F.col("event_id")
    turn = lambda step, of: F.floor(i / step).cast("bigint") % of
    text = lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    place, path = turn(5, 9), F.concat(F.lit("o/"), i)
    flags = ["true", "false", '"yes"', '""', "0", "1", '"false"', "null"]
    flag = turn(45, 9)
    notify = F.when(flag > 0, F.concat(F.lit('"notify":'), F.element_at(F.array(*map(F.lit, flags)), flag.cast("int"))))
    kind = F.when(i % 13 == 0, "mini").when(i % 2 == 0, " LOTO6 ").otherwise("loto7")
    # Keys in alphabetical order, as a parsed message is written again.
    parts = [
        F.concat(F.lit('"draw_no":'), i + 1),
        F.when(i % 5 > 0, text("execution_id", F.concat(F.lit("e"), i))),
        F.when(place.isin(1, 2, 3, 4, 6), text("gcs_bucket", F.lit("box"))),
        F.when(place.isin(1, 5), text("gcs_object", path)),
        F.when(place == 2, text("gcs_path", path)),
        F.when(place == 0, text("gcs_uri", F.concat(F.lit("gs://raw/"), path)))
        .when(place == 6, text("gcs_uri", F.lit(" ")))
        .when(place == 7, text("gcs_uri", F.concat(F.lit("http://raw/"), path))),
        text("lottery_type", kind),
        F.when(place.isin(4, 6), text("name", path)),
        notify,
        F.when(place == 3, text("object", path)),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    # Base64 breaks lines, which a JSON text may not hold.
    packed = F.regexp_replace(F.base64(body.cast("binary")), r"\s", "")
    broken = ['{"x": ', "[1]", '{"data":""}', '{"data":"###"}', '{"data":"WzFd"}', '{"message":{}}', '{"data":"eHl6"}']
    bad, wrap = i % 19, turn(7, 3)
    value = (
        F.when(bad < len(broken), F.element_at(F.array(*map(F.lit, broken)), (bad + 1).cast("int")))
        .when(wrap == 0, body)
        .when(wrap == 1, F.concat(F.lit('{"message":{"data":"'), packed, F.lit('"}}')))
        .otherwise(F.concat(F.lit('{"data":"'), packed, F.lit('"}')))
    )
    return table(spark, sf_dir, "events").select("event_id", value.cast("binary").alias("value"))


def grid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for a backtest per order; some with parameters out of range."""
    key = F.col("o_orderkey")
    limits = F.array(key % 5 * 10 + 10, key % 3 * 10 + 10, F.lit(20).cast("bigint"))
    return table(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        F.when(key % 23 == 0, "mini").when(key % 2 == 0, " LOTO6").otherwise("loto7").alias("lottery_type"),
        F.when(key % 29 == 1, F.array().cast("array<bigint>")).when(key % 29 == 2, F.array(F.lit(-1).cast("bigint"))).otherwise(limits).alias("limits"),
        (key % 4).alias("seed_from"),
        F.when(key % 31 == 3, key % 4 - 2).otherwise(key % 4 + key % 3).alias("seed_to"),
        F.when(key % 37 == 4, F.lit(0)).when(key % 37 == 5, F.lit(7_000_000)).otherwise(key % 2 + 5).cast("bigint").alias("ticket_count"),
    )


def redelivered(sent: DataFrame) -> DataFrame:
    """Messages with copies: some a few minutes later, some weeks later, on the other side of any border in between."""
    late = F.when(F.col("event_id") % 11 == 3, F.expr("INTERVAL 35 DAYS")).when(
        F.col("event_id") % 11 == 4, F.expr("INTERVAL 2 MINUTES")
    )
    copies = sent.withColumn("event_time", F.col("event_time") + late).filter(F.col("event_id") % 11 > 2)
    return sent.unionByName(copies.filter(F.col("event_id") % 11 < 5))


PAGE_BLOCK = 256


def _rendered_rows(d: DataFrame) -> DataFrame:
    """Text parts of each draw as a result page shows them."""
    wide_digits = lambda text: F.translate(text, "0123456789", "０１２３４５６７８９")
    plain = F.array_join(F.col("main_numbers").cast("array<string>"), " ")
    label = F.when(
        F.col("draw_no") % 3 == 0, F.lpad(F.col("draw_no").cast("string"), 9, "0")
    ).otherwise(F.col("draw_no").cast("string"))
    return d.select(
        "lottery_type",
        "draw_no",
        F.date_format("draw_date", "yyyyMM").alias("month"),
        F.floor(F.col("draw_no") / PAGE_BLOCK).cast("bigint").alias("block"),
        # Some labels are written as character references, with and without their semicolon.
        F.when(F.col("draw_no") % 7 == 1, F.concat(F.lit("&#31532;"), label, F.lit("&#x56DE;")))
        .when(F.col("draw_no") % 7 == 2, F.concat(F.lit("第"), label, F.lit("&#x56DE")))
        .otherwise(F.concat(F.lit("第"), label, F.lit("回")))
        .alias("label"),
        F.date_format("draw_date", "yyyy/MM/dd").alias("day"),
        F.when(F.col("draw_no") % 5 == 0, wide_digits(plain)).otherwise(plain).alias("main"),
        F.array_join(F.reverse("main_numbers").cast("array<string>"), " ").alias("provisional"),
        F.array_join(F.col("bonus_numbers").cast("array<string>"), " ").alias("bonus"),
    )


def _paged(rows: DataFrame, html: Column, order: list[Column]) -> DataFrame:
    """One page per pool, month and block of draw numbers, so a page stays small."""
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(*order, html.alias("html")))), lambda r: r["html"]),
        "\n",
    )
    return rows.groupBy("lottery_type", "month", "block").agg(body.alias("body"))


def _document(pages: DataFrame) -> DataFrame:
    key = F.concat_ws("/", "lottery_type", "month", "block")
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><style>td{margin:0}</style><script>var t='<td>第1回</td>';"
              "</script></head><body><!-- 第2回 --><table>"),
        F.col("body"),
        F.lit("</table></body></html>"),
    )
    return pages.select(
        F.xxhash64(key).alias("page_id"),
        F.concat(F.lit(URL_ROOT), "lottery_type", F.lit("/"), "month", F.lit("/?p="), "block").alias("url"),
        html.alias("html"),
        # The pool of every other page is written with capitals and a blank.
        F.when(F.col("block") % 2 == 1, F.concat(F.lit(" "), F.upper("lottery_type"))).otherwise(
            F.col("lottery_type")
        ).alias("lottery_type"),
        "month",
    )


def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages without draws, as they come along in a crawl; every seventeenth names no pool."""
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", "html",
        F.when(F.col("page_id") % 17 == 0, "unknown").when(F.col("page_id") % 2 == 0, "loto6").otherwise("loto7").alias("lottery_type"),
        F.lit(None).cast("string").alias("month"),
    )


def result_pages(spark: SparkSession, sf_dir: str, *, provisional: bool = False) -> DataFrame:
    """Result pages of all draws plus the crawled ``pages`` as noise.

    Every third month uses the labelled form. With ``provisional`` each draw
    is listed twice, first with its main numbers reversed.
    """
    rows = _rendered_rows(draws(spark, sf_dir))
    cells = lambda main: F.concat(
        F.lit("<tr><td>"), "label", F.when(F.col("draw_no") % 11 == 0, "&nbsp;").when(F.col("draw_no") % 11 == 5, "&nbsp").otherwise(" "), "day",
        F.lit("</td><td>"), main, F.lit("</td><td>"), "bonus",
        # Closing tags of cells and rows are optional.
        F.when(F.col("draw_no") % 4 == 2, "").otherwise("</td></tr>"),
    )
    spread = F.array_join(F.transform(F.split("main", " "), lambda n: F.concat(F.lit("<td>"), n, F.lit("</td>"))), "")
    bonus = F.array_join(F.transform(F.split("bonus", " "), lambda n: F.concat(F.lit("<td>（"), n, F.lit("）</td>"))), "")
    labelled = F.concat(
        F.lit("<tr><th>回号</th><th>"), "label", F.lit("</th></tr><tr><th>抽せん日</th><td>"), "day",
        F.lit("</td></tr><tr><th>本数字</th>"), spread, F.lit("</tr><tr><th>ボーナス数字</th>"), bonus, F.lit("</tr>"),
    )
    final = F.when(F.substring("month", 5, 2).cast("int") % 3 == 0, labelled).otherwise(cells(F.col("main")))
    if provisional:
        rows = rows.withColumn("version", F.explode(F.array(F.lit(0), F.lit(1))))
        html = F.when(F.col("version") == 0, cells(F.col("provisional"))).otherwise(cells(F.col("main")))
        listed = _paged(rows, html, [F.col("version"), F.col("draw_no")])
    else:
        listed = _paged(rows, final, [F.col("draw_no")])
    return _document(listed).unionByName(crawled_pages(spark, sf_dir))


def latest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the newest-first form with one value per cell, plus the crawled ``pages`` as noise.

    Draws with a number divisible by 16 show a first main number that no pool has.
    """
    rows = _rendered_rows(draws(spark, sf_dir))
    wrong = F.regexp_replace("main", r"^\S+", "77")
    numbers = F.concat_ws(" ", F.when(F.col("draw_no") % 16 == 0, wrong).otherwise(F.col("main")), "bonus")
    cells = F.array_join(F.transform(F.split(numbers, " "), lambda n: F.concat(F.lit("<td>"), n, F.lit("</td>"))), "")
    html = F.concat(
        F.lit("<tr><td>"), "label", F.lit("</td><td>"), "day", F.lit("</td>"), cells, F.lit("</tr>")
    )
    return _document(_paged(rows, html, [-F.col("draw_no")])).unionByName(crawled_pages(spark, sf_dir))
