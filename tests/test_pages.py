from pyspark.sql import functions as F

from drawlake.functions.text import drop_invisible, unescape, visible_text
from drawlake.sources import pages


def landed(spark, html, kind="loto6", month="202604", page_id=1):
    return spark.createDataFrame(
        [(page_id, "https://example.com/p", html, kind, month)],
        "page_id bigint, url string, html string, lottery_type string, month string",
    )


def table_row(no, day, mains, bonus):
    cell = lambda numbers: " ".join(map(str, numbers))
    return f"<tr><td>第{no}回 {day}</td><td>{cell(mains)}</td><td>{cell(bonus)}</td></tr>"


# Two invented draws: multiples of five, and multiples of seven.
FIVES, SEVENS = [5, 10, 15, 20, 25, 30], [7, 14, 21, 28, 35, 42]
ROWS = f"<table>{table_row(812, '2031/03/02', FIVES, [1])}\n{table_row(811, '2031/02/27', SEVENS, [2])}</table>"


def test_table_rows(spark):
    got = pages.page_draws(landed(spark, ROWS)).orderBy(F.desc("draw_no")).collect()
    assert [(r.draw_no, r.draw_date, r.main_numbers, r.bonus_numbers) for r in got] == [
        (812, "2031-03-02", FIVES, [1]),
        (811, "2031-02-27", SEVENS, [2]),
    ]


def test_leading_zeros_full_width_digits_and_blanks(spark):
    html = "<tr><td>第00055回　2031/03/02</td><td>４ 8&nbsp;12 １６ 20 24 28</td><td> 32 36 </td></tr>"
    row = pages.page_draws(landed(spark, html, "loto7")).first()
    assert (row.draw_no, row.main_numbers, row.bonus_numbers) == (55, [4, 8, 12, 16, 20, 24, 28], [32, 36])


def test_rows_without_closing_tags_and_coded_labels(spark):
    open_rows = ROWS.replace("</td></tr>", "").replace("第", "&#31532;").replace("回", "&#x56DE;")
    got = pages.page_draws(landed(spark, open_rows, " LOTO6")).collect()
    assert sorted((r.draw_no, r.lottery_type) for r in got) == [(811, "loto6"), (812, "loto6")]


def test_pages_of_unknown_pools_are_listed(spark):
    frame = landed(spark, ROWS, "mini").unionByName(landed(spark, ROWS, None)).unionByName(landed(spark, ROWS))
    assert pages.unknown_pool_pages(frame).count() == 2 and pages.page_draws(frame).count() == 2


def labelled(no, day, mains, bonus):
    parts = [("回号", f"第{no}回"), ("抽せん日", day), ("本数字", " ".join(map(str, mains))), ("ボーナス数字", f"（{bonus}）")]
    return "".join(f"<dt>{name}</dt><dd>{value}</dd>" for name, value in parts)


def test_labelled_text_wins_over_rows(spark):
    got = pages.page_draws(landed(spark, labelled(640, "2030/12/05", SEVENS, 3) + ROWS)).collect()
    assert [(r.draw_no, r.main_numbers, r.bonus_numbers) for r in got] == [(640, SEVENS, [3])]


def test_invalid_draws_carry_errors_or_drop_the_page(spark):
    html = ROWS.replace("35 42", "35 99")
    got = {r.draw_no: list(r.errors) for r in pages.page_draws(landed(spark, html)).collect()}
    assert got == {812: [], 811: ["out_of_range"]}
    assert pages.page_draws(landed(spark, html), strict_page=True).count() == 0
    assert [r.draw_no for r in pages.harvest(landed(spark, html)).collect()] == [812]


def test_later_month_and_later_row_win(spark):
    with_bonus = lambda n: ROWS.replace("<td>1</td>", f"<td>{n}</td>")
    old = landed(spark, ROWS, month="203102", page_id=1)
    new = landed(spark, with_bonus(3) + with_bonus(4), month="203103", page_id=2)
    got = {r.draw_no: r.bonus_numbers for r in pages.harvest(old.unionByName(new)).collect()}
    assert got[812] == [4]
    dated = pages.harvest(old, "2031-03-01", "2031-03-31").collect()
    assert [r.draw_no for r in dated] == [812]


def latest_row(label, day, values):
    cells = "".join(f"<td>{v}</td>" for v in [label, day, *values])
    return f"<tr>{cells}</tr>"


def test_latest_page_takes_the_first_row_of_the_right_width(spark):
    narrow = latest_row("第42回", "2031/05/03", FIVES)
    right = latest_row("第0041回", "2031/05/01", [*FIVES, 2])
    older = latest_row("第40回", "2031/04/28", [*SEVENS, 2])
    row = pages.latest_page_draws(landed(spark, f"<table><tr><th>x</th></tr>{narrow}{right}{older}</table>")).first()
    assert (row.draw_no, row.draw_date, row.main_numbers, row.bonus_numbers, row.errors) == (41, "2031-05-01", FIVES, [2], [])
    wide = latest_row("第9回", "2031/05/02", [*range(3, 24, 3), 30, 33, "x"])
    row = pages.latest_page_draws(landed(spark, wide, "loto7")).first()
    assert (row.main_numbers, row.bonus_numbers) == (list(range(3, 24, 3)), [30, 33])


def test_latest_page_names_what_is_wrong_with_its_draw(spark):
    row = pages.latest_page_draws(landed(spark, latest_row("第3回", "2031/02/30", [99, 99, 3, 4, 5, 6, 7]))).first()
    assert list(row.errors) == ["out_of_range", "duplicate_main", "duplicate_number", "bad_date"]


def test_month_spine_and_missing_months(spark):
    ranges = spark.sql("select 'loto6' lottery_type, date'2025-11-20' start_date, date'2026-02-01' end_date")
    spine = pages.month_spine(spark, ranges)
    assert [r.month for r in spine.orderBy("month").collect()] == ["202511", "202512", "202601", "202602"]
    have = landed(spark, ROWS, month="202512")
    assert sorted(r.month for r in pages.missing_months(spine, have).collect()) == ["202511", "202601", "202602"]


def text_of(spark, html, separator=" | "):
    return spark.createDataFrame([(html,)], "h string").select(visible_text(drop_invisible(F.col("h")), separator)).first()[0]


def test_visible_text(spark):
    html = "<p>a<b> b </b><!-- no --><script>var x='<td>';</script><style>p{}</style>\n<i>&amp;lt; &lt;c&gt; &#31532;&#x56de;</i></p>"
    assert text_of(spark, html) == "a | b | &lt; <c> 第回"


def test_unescape_leaves_other_ampersands(spark):
    df = spark.createDataFrame([("a & b &unknown; &#; &#xZZ; &quot;",)], "t string")
    assert df.select(unescape(F.col("t"))).first()[0] == 'a & b &unknown; &#; &#xZZ; "'


def test_character_references(spark):
    cases = {
        "&eacute;&copy;&AMP;": "é©&", "&#128512;&#x1F600;": "😀😀", "&#65536;": "𐀀", "&#0;&#xD800;&#1114112;": "\ufffd" * 3,
        "&#128;": "€", "&amp;lt;": "&lt;", "&#0000065;": "A", "&": "&", "&#99999999999999;": "\ufffd", "x &no; y": "x &no; y",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(unescape(F.col("t"))).collect()] == list(cases.values())


def test_references_without_semicolons_equal_the_standard_library(spark):
    import html
    import random

    pick = random.Random(2)
    parts = ["&nbsp", "&nbsp;", "&amp", "&ampx;", "&notit;", "&notin;", "&no", "&#31532", "&#31532;1", "&#x56DE ", "&#X41z", "&#65 ", "&eacute", "&lt&gt",
             "&AMPB", "&copy2", "& ", "&;", "&#;", "&unknown", "&unknown;", "&sup2x", "&frac12", "x", "1996/01/02", ";", "é", "&acE;", "&#128"]
    cases = parts + ["".join(pick.choice(parts) for _ in range(6)) for _ in range(300)]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(unescape(F.col("t"))).collect()]
    assert got == [html.unescape(c) for c in cases]
