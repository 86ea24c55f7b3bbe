"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Common table expressions are shared as text. Nothing here is used by the
operators; it states the same semantics a second time, set-based.
"""

from __future__ import annotations

# Fixed values, stated here a second time so that the SQL does not lean on the operators.
# Profiles: name, main pool, bonus pool, mains, bonuses, main blend, bonus blend, temperature.
PROFILES = [
    ("main_hot", 18, 37, 6, 1, (0.94, 0.06), (0.30, 0.70), 0.75),
    ("main_balanced", 24, 37, 6, 1, (0.88, 0.12), (0.35, 0.65), 0.95),
    ("main_wide_bonus_hot", 30, 37, 6, 1, (0.82, 0.18), (0.22, 0.78), 1.05),
    ("main5_bonus2_balanced", 24, 37, 5, 2, (0.90, 0.10), (0.25, 0.75), 0.95),
    ("main5_bonus2_explore", 30, 37, 5, 2, (0.84, 0.16), (0.18, 0.82), 1.15),
]
DISPLAY_BLEND = (0.75, 0.25)
# Prize tier and near-miss points by pool: main matches, bonus matches needed, value; the first that fits.
TIERS = """
  WHEN lottery_type = 'loto6' AND main_match = 6 THEN 1
  WHEN lottery_type = 'loto6' AND main_match = 5 AND bonus_match >= 1 THEN 2
  WHEN lottery_type = 'loto6' AND main_match = 5 THEN 3
  WHEN lottery_type = 'loto6' AND main_match = 4 THEN 4
  WHEN lottery_type = 'loto6' AND main_match = 3 THEN 5
  WHEN lottery_type = 'loto7' AND main_match = 7 THEN 1
  WHEN lottery_type = 'loto7' AND main_match = 6 AND bonus_match >= 1 THEN 2
  WHEN lottery_type = 'loto7' AND main_match = 6 THEN 3
  WHEN lottery_type = 'loto7' AND main_match = 5 THEN 4
  WHEN lottery_type = 'loto7' AND main_match = 4 THEN 5
  WHEN lottery_type = 'loto7' AND main_match = 3 AND bonus_match >= 1 THEN 6"""
NEAR_MISS = """
  WHEN lottery_type = 'loto6' AND main_match = 6 THEN 5000
  WHEN lottery_type = 'loto6' AND main_match = 5 AND bonus_match >= 1 THEN 3000
  WHEN lottery_type = 'loto6' AND main_match = 5 THEN 1500
  WHEN lottery_type = 'loto6' AND main_match = 4 THEN 500
  WHEN lottery_type = 'loto6' AND main_match = 3 THEN 100
  WHEN lottery_type = 'loto7' AND main_match = 7 THEN 5000
  WHEN lottery_type = 'loto7' AND main_match = 6 AND bonus_match >= 1 THEN 3000
  WHEN lottery_type = 'loto7' AND main_match = 6 THEN 1500
  WHEN lottery_type = 'loto7' AND main_match = 5 AND bonus_match >= 1 THEN 800
  WHEN lottery_type = 'loto7' AND main_match = 5 THEN 500
  WHEN lottery_type = 'loto7' AND main_match = 4 AND bonus_match >= 1 THEN 200
  WHEN lottery_type = 'loto7' AND main_match = 4 THEN 100
  WHEN lottery_type = 'loto7' AND main_match = 3 AND bonus_match >= 1 THEN 50"""
TIER_LABELS = [(1, "1等相当"), (2, "2等相当"), (3, "3等相当"), (4, "4等相当"), (5, "5等相当"), (6, "6等相当"), (0, "該当なし")]

ORACLE: dict[str, str] = {}

AS_OF = "2026-01-02 03:04:05"


def text(column: str) -> str:
    return f"array_to_string({column}, ',')"


def r6(value: str) -> str:
    return f"floor(({value}) * 1e6 + 0.5) / 1e6"


D = """
base AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'loto6' ELSE 'loto7' END AS lottery_type,
         o_orderkey + 1 AS draw_no, o_orderdate::DATE AS draw_date, o_orderpriority AS priority,
         o_orderstatus AS status, o_custkey AS start, floor(o_totalprice)::BIGINT AS price,
         CASE WHEN o_orderkey % 2 = 0 THEN 43 ELSE 37 END AS pool,
         CASE WHEN o_orderkey % 2 = 0 THEN 6 ELSE 7 END AS pick,
         CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS bonus
  FROM orders),
d AS MATERIALIZED (
  SELECT lottery_type || ':' || priority AS series, lottery_type, draw_no, draw_date, pool, pick,
         list_transform(range(0, pick), lambda i: ((start + i * (1 + price % (pool - 1))) % pool + 1)::INT) AS main_numbers,
         list_transform(range(pick, pick + bonus), lambda i: ((start + i * (1 + price % (pool - 1))) % pool + 1)::INT) AS bonus_numbers,
         'https://example.com/' || lottery_type || '/' || draw_no AS source_url, status
  FROM base)"""

RANKED = """
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY draw_no) AS rk,
         count(*) OVER (PARTITION BY series) AS n FROM d)"""

WIDE = ", ".join([f"main_numbers[{i}] AS n{i}" for i in range(1, 8)] + [f"bonus_numbers[{i}] AS b{i}" for i in (1, 2)])

FAULTY = """
slotted AS (SELECT *, floor(draw_no / 2)::BIGINT % 50 AS slot FROM d),
faulty AS (
  SELECT CASE WHEN slot = 5 THEN 'mini' ELSE lottery_type END AS lottery_type,
         CASE WHEN slot = 3 THEN -draw_no ELSE draw_no END AS draw_no,
         CASE WHEN slot = 4 THEN '2026-02-30' ELSE draw_date::VARCHAR END AS draw_date,
         CASE WHEN slot = 0 THEN list_append(main_numbers[1:len(main_numbers) - 1], main_numbers[1])
              WHEN slot = 1 THEN list_append(main_numbers[1:len(main_numbers) - 1], 99)
              ELSE main_numbers END AS main_numbers,
         CASE WHEN slot = 2 THEN bonus_numbers[1:len(bonus_numbers) - 1]
              WHEN slot = 6 THEN list_append(bonus_numbers[1:len(bonus_numbers) - 1], main_numbers[1])
              ELSE bonus_numbers END AS bonus_numbers, slot
  FROM slotted),
checked AS (
  SELECT *, concat_ws(',',
    CASE WHEN lottery_type NOT IN ('loto6', 'loto7') THEN 'unsupported_type' END,
    CASE WHEN draw_no <= 0 THEN 'draw_no_not_positive' END,
    CASE WHEN (lottery_type = 'loto6' AND len(main_numbers) <> 6) OR (lottery_type = 'loto7' AND len(main_numbers) <> 7) THEN 'main_count' END,
    CASE WHEN (lottery_type = 'loto6' AND len(bonus_numbers) <> 1) OR (lottery_type = 'loto7' AND len(bonus_numbers) <> 2) THEN 'bonus_count' END,
    CASE WHEN lottery_type IN ('loto6', 'loto7') AND len(list_filter(list_concat(main_numbers, bonus_numbers),
         lambda v: v < 1 OR v > CASE WHEN lottery_type = 'loto6' THEN 43 ELSE 37 END)) > 0 THEN 'out_of_range' END,
    CASE WHEN len(list_distinct(main_numbers)) < len(main_numbers) THEN 'duplicate_main' END,
    CASE WHEN len(list_distinct(list_concat(main_numbers, bonus_numbers))) < len(main_numbers) + len(bonus_numbers) THEN 'duplicate_number' END,
    CASE WHEN try_cast(draw_date AS DATE) IS NULL THEN 'bad_date' END) AS errors
  FROM faulty)"""

INCOMING = """
hist AS (SELECT * FROM d WHERE status IN ('F', 'P')),
incoming AS (
  SELECT lottery_type, draw_no, draw_date, main_numbers, bonus_numbers, source_url FROM d
  UNION ALL
  SELECT lottery_type, NULL, draw_date, main_numbers, bonus_numbers, source_url FROM d WHERE status = 'O')"""


def with_(*parts: str, select: str, recursive: bool = False) -> str:
    if not parts:
        return select.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(p.strip() for p in parts)} {select.strip()}"


def register(name: str, *parts: str, select: str, recursive: bool = False) -> None:
    ORACLE[name] = with_(*parts, select=select, recursive=recursive)


# --- scans, projections, import ----------------------------------------------

register("appearance_counts", D, select="""
SELECT lottery_type, number, count(*) AS appearance_count
FROM (SELECT lottery_type, unnest(main_numbers) AS number FROM d) GROUP BY ALL""")
_LISTS = f"{text('main_numbers')} AS main_numbers, {text('bonus_numbers')} AS bonus_numbers"
register("latest_n_history", D, select=f"SELECT draw_no, draw_date::VARCHAR AS draw_date, {_LISTS} FROM d ORDER BY draw_no DESC LIMIT 100")
register("latest_n_by_date", D, select=f"""
SELECT lottery_type, draw_no, draw_date::VARCHAR AS draw_date, {_LISTS} FROM d
QUALIFY row_number() OVER (PARTITION BY lottery_type ORDER BY draw_date DESC, draw_no DESC) <= 100""")
register("latest_n_per_series", D, RANKED, select=f"""
SELECT series, draw_no, n - rk AS draw_idx, least(n, 100) AS series_size, {text('main_numbers')} AS main_numbers
FROM ranked WHERE n - rk < 100""")
register("latest_n_beyond_group_limit", D, RANKED, select="""
SELECT series, draw_no, n - rk AS draw_idx, least(n, 1500) AS series_size, least(n, 1500) - (n - rk) AS rk FROM ranked WHERE n - rk < 1500""")
register("draw_positions", D, RANKED, select="SELECT series, draw_no, rk, n - rk AS draw_idx, n AS series_size FROM ranked")
register("draw_positions_sparse", D, select="""
SELECT series, h AS draw_no, row_number() OVER s AS rk, count(*) OVER (PARTITION BY series) - row_number() OVER s AS draw_idx,
  count(*) OVER (PARTITION BY series) AS series_size
FROM (SELECT series, draw_no * 2654435761 % 4294967296 * 1048576 AS h FROM d) WINDOW s AS (PARTITION BY series ORDER BY h)""")
register("draw_validation_errors", D, FAULTY, select="SELECT draw_no, lottery_type, errors FROM checked")
register("valid_draws", D, FAULTY, select=f"SELECT draw_no, lottery_type, draw_date, {_LISTS} FROM checked WHERE errors = ''")
register("unknown_types", D, FAULTY, select="SELECT draw_no, lottery_type FROM faulty WHERE lottery_type NOT IN ('loto6', 'loto7')")
register("wide_projection", D, select=f"SELECT lottery_type, draw_no, draw_date::VARCHAR AS draw_date, source_url, {WIDE} FROM d")
register("array_projection", D, select=f"SELECT draw_no, lottery_type, {_LISTS} FROM d")
register("bonus_columns", D, select="SELECT draw_no, bonus_numbers[1] AS bonus1, bonus_numbers[2] AS bonus2 FROM d")
register("target_sets", D, select=f"""
SELECT draw_no, {text('list_sort(main_numbers)')} AS target_main, {text('list_sort(bonus_numbers)')} AS target_bonus FROM d""")
_WRITTEN = """CASE WHEN draw_no % 31 = 0 THEN 'mini' WHEN draw_no % 37 = 0 THEN NULL
  WHEN draw_no % 29 = 0 THEN ' ' || upper(lottery_type) || ' ' ELSE lottery_type END"""
register("row_normalise", D, FAULTY, f"""
wide AS (SELECT trim(lower({_WRITTEN})) AS lottery_type, draw_no, {WIDE} FROM faulty),
gaps AS (SELECT * REPLACE (CASE WHEN draw_no % 41 = 0 THEN NULL ELSE n3 END AS n3) FROM wide)""", select="""
SELECT *, CASE WHEN lottery_type IS NULL OR lottery_type NOT IN ('loto6', 'loto7') THEN 'unknown_pool'
  WHEN draw_no <= 0 THEN 'no_draw_no' WHEN n3 IS NULL THEN 'missing_main_number' END AS reason FROM gaps""")
register("sample_rows", D, select=f"SELECT draw_no, draw_date::VARCHAR AS draw_date, {_LISTS} FROM d ORDER BY draw_no LIMIT 3")
register("range_scan", D, select=f"""
SELECT lottery_type, draw_no, draw_date::VARCHAR AS draw_date, {WIDE}, source_url FROM d
WHERE lottery_type = 'loto7' AND draw_no BETWEEN 350 AND 1000000000""")
register("date_range_scan", D, select="""
SELECT draw_no, draw_date::VARCHAR AS draw_date FROM d WHERE draw_date BETWEEN DATE '1997-03-15' AND DATE '1999-11-02'""")
register("existing_keys", D, INCOMING, select="""
SELECT lottery_type, draw_no FROM hist h WHERE EXISTS (SELECT 1 FROM incoming i WHERE i.lottery_type = h.lottery_type AND i.draw_no = h.draw_no)""")
_NEW = """
fresh AS (SELECT * FROM incoming i WHERE draw_no IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM hist h WHERE h.lottery_type = i.lottery_type AND h.draw_no = i.draw_no))"""
ORACLE["scanned_keys"] = ORACLE["existing_keys"]
register("import_new_rows", D, INCOMING, _NEW, select=f"""
SELECT lottery_type, draw_no, draw_date::VARCHAR AS draw_date, {text('main_numbers')} AS main_numbers FROM (
  SELECT lottery_type, draw_no, draw_date, main_numbers FROM fresh
  UNION ALL (SELECT lottery_type, draw_no + 1000000000000, draw_date, main_numbers FROM d WHERE status = 'O' ORDER BY draw_no DESC LIMIT 1))""")
_METRICS = """
metrics AS (SELECT lottery_type, count(*) AS total_rows,
  (SELECT count(*) FROM fresh f WHERE f.lottery_type = i.lottery_type) AS inserted_rows, max(draw_no) AS draw_no
  FROM incoming i GROUP BY lottery_type)"""
register("import_metrics", D, INCOMING, _NEW, _METRICS, select="""
SELECT lottery_type, total_rows, inserted_rows, total_rows - inserted_rows AS skipped_rows FROM metrics""")
register("batch_latest_row", D, INCOMING, select="""
SELECT lottery_type, draw_no, draw_date::VARCHAR AS draw_date, source_url FROM incoming WHERE draw_no IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY lottery_type ORDER BY draw_no DESC) = 1""")
register("import_append", D, select="SELECT lottery_type, draw_no, main_numbers[1] AS n1, bonus_numbers[1] AS b1 FROM d")

# --- files -----------------------------------------------------------------------

register("csv_roundtrip", D, select=f"""
SELECT lottery_type, draw_no, draw_date::VARCHAR AS draw_date, {WIDE},
       source_url || CASE WHEN draw_no % 13 = 0 THEN chr(10) || '"x", y' ELSE '' END AS source_url FROM d""")
register("csv_mixed_headers", D, select=f"SELECT lottery_type, draw_no, draw_date::VARCHAR AS draw_date, {WIDE}, source_url FROM d")
register("jsonl_roundtrip", D, select=f"""
SELECT lottery_type, draw_no, draw_date::VARCHAR AS draw_date, {WIDE}, source_url FROM d WHERE lottery_type = 'loto7'""")
register("legacy_dialect_import", D, select=f"SELECT lottery_type, draw_no, draw_date::VARCHAR AS draw_date, {WIDE}, source_url FROM d")
register("jsonl_append", D, select="SELECT lottery_type, draw_no, main_numbers[1] AS n1 FROM d")
register("missing_targets", D, select="""
SELECT a.series, a.draw_no + 1 AS draw_no FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.series = a.series AND b.draw_no = a.draw_no + 1)""")
register("overwrite_load", D, select="SELECT draw_no, lottery_type, main_numbers[1] AS n1 FROM d WHERE status = 'F'")
register("bulk_append", D, select="""
SELECT lottery_type, status, count(*) AS row_count, sum(draw_no)::BIGINT AS draw_no_sum
FROM (SELECT * FROM d UNION ALL SELECT * FROM d WHERE status = 'F') GROUP BY ALL""")
register("partitioned_landing", D, select="""
SELECT lottery_type, draw_no // 100000 AS draw_block, count(*) AS row_count, max(draw_no) AS last_draw_no FROM d GROUP BY ALL""")

register("landing_latest", D, select="""
SELECT lottery_type, draw_no, main_numbers[1] AS n1 FROM d WHERE lottery_type = 'loto6' OR draw_no <= 1000
QUALIFY row_number() OVER (PARTITION BY lottery_type ORDER BY draw_no DESC) = 1""")

# --- scores ------------------------------------------------------------------------

# Default weights of main and bonus scores.
MAIN_W = ("1.0::DOUBLE", "2.0::DOUBLE", "1.5::DOUBLE", "0.8::DOUBLE", "0.4::DOUBLE")
BONUS_W = ("(1.0::DOUBLE * 0.9::DOUBLE)", "(2.0::DOUBLE * 0.8::DOUBLE)", "(1.5::DOUBLE * 1.0::DOUBLE)",
           "(0.8::DOUBLE * 1.2::DOUBLE)", "(0.4::DOUBLE * 0.5::DOUBLE)")


def score_of(w: tuple[str, ...]) -> str:
    return f"""greatest(f::DOUBLE / mf::DOUBLE * {w[0]} + r::DOUBLE / mr::DOUBLE * {w[1]}
      + CASE WHEN idx IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - idx::DOUBLE / mi::DOUBLE END * {w[2]}
      + CASE WHEN idx IS NULL THEN 1.0::DOUBLE ELSE least(idx::DOUBLE / mi::DOUBLE, 1.0::DOUBLE) END * {w[3]}
      - CASE WHEN idx = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * {w[4]}, 0.0::DOUBLE)"""


def whole(name: str, pool: str, w: tuple[str, ...], limit: str = "n") -> str:
    """Scores over the newest draws of each series."""
    return f"""
{name}_seen AS (
  SELECT series, unnest({pool}_numbers) AS number, n - rk AS draw_idx, least(n, {limit}) AS size
  FROM ranked WHERE n - rk < {limit}),
{name}_counts AS (
  SELECT series, number, count(*) AS f, min(draw_idx) AS idx,
         count(*) FILTER (WHERE draw_idx < greatest(1, floor(size * 0.3::DOUBLE))) AS r
  FROM {name}_seen GROUP BY ALL),
{name}_extents AS (
  SELECT series, max(f) AS mf, greatest(max(r), 1) AS mr, greatest(max(idx), 1) AS mi,
         unnest(range(min(number), max(number) + 1))::INT AS number FROM {name}_counts GROUP BY series),
{name} AS (
  SELECT e.series, e.number, {score_of(w)} AS score FROM (
    SELECT e.*, coalesce(c.f, 0) AS f, coalesce(c.r, 0) AS r, c.idx
    FROM {name}_extents e LEFT JOIN {name}_counts c USING (series, number)) e)"""


_RANKED_SCORES = f"SELECT series, number, {r6('score')} AS score, row_number() OVER (PARTITION BY series ORDER BY score DESC, number) AS score_rank FROM "
register("number_scores", D, RANKED, whole("ms", "main", MAIN_W, "100"), select=_RANKED_SCORES + "ms")
register("main_scores", D, RANKED, whole("ms", "main", MAIN_W), select=_RANKED_SCORES + "ms")
register("bonus_scores", D, RANKED, whole("bs", "bonus", BONUS_W), select=_RANKED_SCORES + "bs")
register("combined_scores", D, RANKED, whole("ms", "main", MAIN_W), whole("bs", "bonus", BONUS_W), """
cs AS (SELECT series, number, coalesce(ms.score, 0.0) * 0.8::DOUBLE + coalesce(bs.score, 0.0) * 0.2::DOUBLE AS score
       FROM ms FULL JOIN bs USING (series, number))""", select=_RANKED_SCORES + "cs")


def dense(pool: str) -> str:
    """Counts of every window, from the positions in ``ranked`` and the limits in ``lim``."""
    frame = "PARTITION BY series, history_limit, number ORDER BY rk ROWS BETWEEN {} PRECEDING AND 1 PRECEDING"
    window, recent = frame.format("hn"), frame.format("hr")
    return f"""
{pool}_dense AS (
  SELECT series, rk, draw_no, history_limit, number, least(history_limit, rk - 1) AS hn,
         greatest(1, 3 * least(history_limit, rk - 1) // 10) AS hr,
         list_contains({pool}_numbers, number)::INT AS present
  FROM ranked, lim, (SELECT unnest(range(1, 44))::INT AS number)),
{pool}_counts AS (
  SELECT series, rk, history_limit, number, hn,
         coalesce(sum(present) OVER ({window}), 0)::BIGINT AS f,
         coalesce(sum(present) OVER ({recent}), 0)::BIGINT AS r,
         rk - 1 - max(CASE WHEN present = 1 THEN rk END) OVER ({window}) AS idx
  FROM {pool}_dense),
{pool}_extents AS MATERIALIZED (
  SELECT *, greatest(max(f) OVER t, 1) AS mf, greatest(max(r) OVER t, 1) AS mr, greatest(max(idx) OVER t, 1) AS mi,
         min(CASE WHEN f > 0 THEN number END) OVER t AS low, max(CASE WHEN f > 0 THEN number END) OVER t AS high
  FROM {pool}_counts WHERE hn > 0 WINDOW t AS (PARTITION BY series, rk, history_limit))"""


def listed(pool: str, w: tuple[str, ...]) -> str:
    return f"""
{pool}_lists AS MATERIALIZED (
  SELECT series, rk, history_limit, list(CASE WHEN number BETWEEN low AND high THEN {score_of(w)} END ORDER BY number) AS {pool}_scores
  FROM {pool}_extents GROUP BY ALL)"""


def scored(limits: str) -> tuple[str, ...]:
    return (
        D, RANKED, f"lim AS (SELECT unnest([{limits}])::BIGINT AS history_limit)",
        dense("main"), listed("main", MAIN_W), dense("bonus"), listed("bonus", BONUS_W), """
scored AS MATERIALIZED (
  SELECT r.series, r.lottery_type, r.draw_no, r.draw_date, r.pool, r.pick, m.history_limit,
         least(m.history_limit, r.rk - 1) AS history_count, r.main_numbers, r.bonus_numbers, m.main_scores, b.bonus_scores
  FROM ranked r JOIN main_lists m USING (series, rk) JOIN bonus_lists b USING (series, rk, history_limit))""",
    )


_NUMBERED = "list_transform({0}, lambda v, i: {{'k': -v, 'n': i::INT}})"
_WINDOWS = f"""
SELECT series, draw_no, history_limit, history_count,
  {text("list_transform(list_sort(list_filter(" + _NUMBERED.format('main_scores') + ", lambda e: e.k IS NOT NULL)), lambda e: e.n)")} AS ranking,
  {r6("list_sum(list_transform(main_scores, lambda v: coalesce(v, 0.0::DOUBLE)))")} AS main_total,
  {r6("list_sum(list_transform(bonus_scores, lambda v: coalesce(v, 0.0::DOUBLE)))")} AS bonus_total
FROM scored"""
register("sliding_scores", *scored("20, 100"), select=_WINDOWS)
register("sliding_scores_long", *scored("3000"), select=_WINDOWS)

# --- weights -----------------------------------------------------------------------------


def spine(name: str, source: str) -> str:
    """Scores over their series maximum, one row per number of the pool."""
    return f"""
{name}_spine AS (
  SELECT s.series, s.lottery_type, x.number, coalesce(sc.score, 0.0) AS score
  FROM (SELECT DISTINCT series, lottery_type FROM d) s
  JOIN (SELECT unnest(range(1, 44))::INT AS number) x ON x.number <= CASE WHEN s.lottery_type = 'loto6' THEN 43 ELSE 37 END
  LEFT JOIN {source} sc ON sc.series = s.series AND sc.number = x.number),
{name} AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY series) > 0 THEN score / max(score) OVER (PARTITION BY series) ELSE 0.0 END AS scaled FROM {name}_spine)"""


QUANT = "floor(({}) * 1e12 + 0.5)::BIGINT"
register("base_weights", D, RANKED, whole("ms", "main", MAIN_W), spine("sm", "ms"), select=f"""
SELECT series, lottery_type, number, {r6('w')} AS weight,
       row_number() OVER (PARTITION BY series ORDER BY {QUANT.format('w')} DESC, number) AS weight_rank
FROM (SELECT *, 1.0::DOUBLE + pow(scaled, 0.85::DOUBLE) AS w FROM sm)""")
_ROLES = ", ".join(
    f"({i}, '{name}', '{role}', {blend[0]}::DOUBLE, {blend[1]}::DOUBLE, {heat}::DOUBLE, {size})"
    for i, (name, wide, wide_bonus, _, _, main, bonus, heat) in enumerate(PROFILES, start=1)
    for role, blend, size in (("main", main, wide), ("bonus", bonus, wide_bonus))
)
register("blended_weights", D, RANKED, whole("ms", "main", MAIN_W), whole("bs", "bonus", BONUS_W), spine("sm", "ms"), spine("sb", "bs"),
         f"roles(profile_no, profile, role, a, b, t, size) AS (VALUES {_ROLES})", """
blended AS (
  SELECT m.series, profile_no, profile, role, m.number, size, 1.0::DOUBLE + pow(greatest(m.scaled * a + sb.scaled * b, 0.0::DOUBLE), t) AS w
  FROM sm m JOIN sb USING (series, number), roles WHERE m.lottery_type = 'loto7')""", f"""
blended_ranked AS (SELECT *, row_number() OVER (PARTITION BY series, profile_no, role ORDER BY {QUANT.format('w')} DESC, number) AS weight_rank FROM blended)""",
         select=f"""SELECT series, profile_no, profile, role, number, {r6('w')} AS weight, weight_rank, (weight_rank <= size)::INT AS in_pool FROM blended_ranked""")

# --- tickets ------------------------------------------------------------------------------

SCALED = """list_transform({0}[1:{1}], lambda v: CASE WHEN list_max(list_transform({0}[1:{1}], lambda z: coalesce(z, 0.0::DOUBLE))) > 0
  THEN coalesce(v, 0.0::DOUBLE) / list_max(list_transform({0}[1:{1}], lambda z: coalesce(z, 0.0::DOUBLE))) ELSE 0.0::DOUBLE END)"""


# Multipliers of seed, ticket, attempt, stage and number, and the mixing rounds, in 128-bit arithmetic.
_COUNTER = (11400714819323198485, 14029467366897019727, 1609587929392839161, 15485907386658061715, 11562461410679940143)
_MIX = ((30, 13787848793156543929), (27, 10723151780598845931))


def uniform(seed: str, ticket: str, attempt: str, stage: int, number: str) -> str:
    """Random number in (0, 1) from a mixed 64-bit counter."""
    low = lambda e: f"(({e}) & 18446744073709551615::UHUGEINT)::UBIGINT"
    parts = zip((seed, ticket, attempt, str(stage), number), _COUNTER)
    z = "[" + low(" + ".join(f"({v})::UHUGEINT * {k}::UHUGEINT" for v, k in parts)) + "]"
    for shift, factor in _MIX:
        z = f"list_transform({z}, lambda z: " + low(f"xor(z, z >> {shift})::UHUGEINT * {factor}::UHUGEINT") + ")"
    return f"((list_transform({z}, lambda z: xor(z, z >> 31) >> 12)[1]::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def keyed(weights: str) -> str:
    return f"list_transform(list_sort(list_transform({weights}, lambda w, i: {{'k': -({QUANT.format('w')}), 'n': i::INT}})), lambda e: e.n)"


def shown(numbers: str, weights: str) -> str:
    """Numbers by weight descending, then number."""
    return f"list_transform(list_sort(list_transform({numbers}, lambda m: {{'k': -({QUANT.format(weights + '[m]')}), 'n': m}})), lambda e: e.n)"


def default_ctes(source: str, name: str = "gen", done: str = "default_done") -> tuple[str, ...]:
    """Default generator over rows (run, lottery_type, pool, pick, seed, main_scores); 5 tickets.

    The recursion accepts or refuses one sampled ticket per step.
    """
    parts = (
        f"""
gen_w AS MATERIALIZED (
  SELECT run, pool, pick, seed, list_transform({SCALED.format('main_scores', 'pool')}, lambda v: 1.0::DOUBLE + pow(v, 0.85::DOUBLE)) AS w
  FROM {source})""",
        f"gen_r AS MATERIALIZED (SELECT *, {keyed('w')} AS ranked_numbers FROM gen_w)",
        """
gen_c AS MATERIALIZED (
  SELECT run, pool, pick, seed, w, unnest([1, 3, 4, 5]) AS no, unnest([
    ranked_numbers[1:pick],
    list_concat(
      list_concat(list_filter(ranked_numbers[1:3 * pick], lambda v: v % 2 = 0)[1:pick // 2],
                  list_filter(ranked_numbers[1:3 * pick], lambda v: v % 2 = 1)[1:pick - pick // 2]),
      list_filter(ranked_numbers[1:3 * pick], lambda v: NOT list_contains(list_concat(
        list_filter(ranked_numbers[1:3 * pick], lambda v2: v2 % 2 = 0)[1:pick // 2],
        list_filter(ranked_numbers[1:3 * pick], lambda v3: v3 % 2 = 1)[1:pick - pick // 2]), v)))[1:pick],
    list_filter(ranked_numbers, lambda v, i: i % 2 = 1)[1:pick],
    list_concat(ranked_numbers[1:2 * greatest(2, pick // 3)],
      ranked_numbers[greatest(2, pick // 3) + 2 * pick + 1:greatest(2, pick // 3) + 2 * pick + pick - 2 * greatest(2, pick // 3)])
  ]) AS numbers
  FROM gen_r)""",
        f"""
gen_s AS MATERIALIZED (
  SELECT run, pool, pick, seed, w, no, {shown('numbers', 'w')} AS ticket, list_sort(numbers) AS key FROM gen_c
  QUALIFY row_number() OVER (PARTITION BY run, list_sort(numbers) ORDER BY no) = 1)""",
        f"""
gen(run, pool, pick, seed, w, tickets, keys, attempt) AS (
  SELECT run, any_value(pool), any_value(pick), any_value(seed), any_value(w), list(ticket ORDER BY no), list(key ORDER BY no), 0
  FROM gen_s GROUP BY run
  UNION ALL
  SELECT run, pool, pick, seed, w,
         CASE WHEN list_contains(keys, key) THEN tickets ELSE list_append(tickets, {shown('key', 'tw')}) END,
         CASE WHEN list_contains(keys, key) THEN keys ELSE list_append(keys, key) END, attempt + 1
  FROM (
    SELECT *, list_sort(list_transform(list_sort(list_transform(tw, lambda x, i:
             {{'k': -ln({uniform("seed", "len(tickets)", "attempt", 0, "i")}) / greatest(x, 1e-6::DOUBLE), 'n': i::INT}}))[1:pick], lambda e: e.n)) AS key
    FROM (
      SELECT *, list_transform(w, lambda x, i: CASE WHEN len(tickets) <= 0 THEN x ELSE
               pow(x, greatest(0.55::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * len(tickets)))
               / (1.0::DOUBLE + len(list_filter(keys, lambda k: list_contains(k, i::INT))) * 0.35::DOUBLE) END) AS tw
      FROM gen WHERE len(tickets) < 5 AND attempt < 1500)))""",
        """
default_done AS MATERIALIZED (
  SELECT run, unnest(tickets) AS ticket, unnest(range(1, 6))::INT AS ticket_no FROM gen WHERE len(tickets) = 5)""",
    )
    if name == "gen":
        return parts
    renames = {"gen_": f"{name}_", "gen(": f"{name}(", "FROM gen ": f"FROM {name} ", "default_done": done}
    for old, new in renames.items():
        parts = tuple(p.replace(old, new) for p in parts)
    return parts


def profile_ctes(source: str, shift: int) -> tuple[str, ...]:
    """Profile generator over rows (run, seed, main_scores, bonus_scores) of the 7-pick pool.

    Set-based: every ticket takes its first attempt. A second attempt is only
    made when a run repeats a number set, which would show as a mismatch.
    """
    roles = ", ".join(
        f"({t}, {wide}, {mains}, {bonuses}, {main[0]}::DOUBLE, {main[1]}::DOUBLE, "
        f"{bonus[0]}::DOUBLE, {bonus[1]}::DOUBLE, {heat}::DOUBLE)"
        for t, (_, wide, _, mains, bonuses, main, bonus, heat) in enumerate(PROFILES)
    )
    flat = "CASE WHEN t <= 0 THEN x ELSE pow(x, greatest(0.55::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * t)) END"

    def pick(pool_numbers: str, weights: str, stage: int, count: str) -> str:
        key = f"-ln({uniform(f'seed + {shift}', 't', '0', stage, 'm')}) / greatest(list_transform([{weights}[m]], lambda x: {flat})[1], 1e-6::DOUBLE)"
        return f"list_transform(list_sort(list_transform({pool_numbers}, lambda m: {{'k': {key}, 'n': m}}))[1:{count}], lambda e: e.n)"

    def blend(a: str, b: str, power: str) -> str:
        return f"list_transform(range(1, 38), lambda i: 1.0::DOUBLE + pow(greatest(m[i] * {a} + b[i] * {b}, 0.0::DOUBLE), {power}))"

    return (
        f"roles(t, size, mains, bonuses, ma, mb, ba, bb, temp) AS (VALUES {roles})",
        f"pro_s AS MATERIALIZED (SELECT run, seed, {SCALED.format('main_scores', '37')} AS m, {SCALED.format('bonus_scores', '37')} AS b FROM {source})",
        f"""
pro_w AS MATERIALIZED (
  SELECT run, seed, t, size, mains, bonuses, {blend('ma', 'mb', 'temp')} AS mw, {blend('ba', 'bb', 'temp')} AS bw,
         {blend(f'{DISPLAY_BLEND[0]}::DOUBLE', f'{DISPLAY_BLEND[1]}::DOUBLE', '1.0::DOUBLE')} AS dw
  FROM pro_s, roles)""",
        f"pro_m AS MATERIALIZED (SELECT *, {pick(keyed('mw') + '[1:size]', 'mw', 0, 'mains')} AS chosen FROM pro_w)",
        f"""
pro_b AS MATERIALIZED (
  SELECT *, {pick("list_filter(range(1, 38), lambda v: NOT list_contains(chosen, v::INT))", 'bw', 1, 'bonuses')} AS extra FROM pro_m)""",
        f"""
profile_done AS MATERIALIZED (
  SELECT run, (t + 1)::INT AS ticket_no, {shown('list_concat(chosen, extra)', 'dw')} AS ticket FROM pro_b)""",
    )


def runs_of(seeds: str) -> str:
    return f"""
runs AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY draw_no, history_limit, seed) AS run, *
  FROM scored, (SELECT unnest([{seeds}])::BIGINT AS seed))"""


_BY_RUN = f"SELECT series, draw_no, lottery_type, ticket_no, {text('ticket')} AS ticket FROM runs JOIN "
_ONE = (*scored("100"), runs_of("1"))
register("strategy_tickets", *_ONE, *default_ctes("runs")[:4], recursive=True, select=f"""
SELECT series, draw_no, no AS strategy_no, ['anchor', 'balanced', 'even_odd', 'spread', 'mixed_depth'][no] AS strategy, {text('ticket')} AS ticket
FROM runs JOIN gen_s USING (run)""")
register("weighted_sample", *_ONE, *default_ctes("runs")[:1], recursive=True, select=f"""
SELECT r.series, r.draw_no, {text("list_sort(list_transform(list_sort(list_transform(w, lambda x, i: {'k': -ln(" + uniform("g.seed", "0", "0", 0, "i") + ") / greatest(x, 1e-6::DOUBLE), 'n': i::INT}))[1:g.pick], lambda e: e.n))")} AS sample
FROM runs r JOIN gen_w g USING (run)""")
register("default_tickets", *_ONE, *default_ctes("runs"), recursive=True, select=_BY_RUN + "default_done USING (run)")
_SEVEN = "seven AS (SELECT * FROM runs WHERE lottery_type = 'loto7')"
_SIX = "six AS (SELECT * FROM runs WHERE lottery_type = 'loto6')"
register("profile_tickets", *_ONE, _SEVEN, *profile_ctes("seven", 0), select=_BY_RUN + "profile_done USING (run)")


def mixed(limits: str, seeds: str) -> tuple[str, ...]:
    return (
        *scored(limits), runs_of(seeds), _SEVEN, _SIX, *default_ctes("six"), *profile_ctes("seven", 10000),
        "generated AS (SELECT run, ticket_no, ticket FROM default_done UNION ALL SELECT run, ticket_no, ticket FROM profile_done)",
    )


register("mixed_tickets", *mixed("100", "1"), f"written AS (SELECT *, {_WRITTEN} AS pool_text FROM runs)", recursive=True, select=f"""
SELECT series, draw_no, pool_text AS lottery_type, NULL AS error, ticket_no, {text('ticket')} AS ticket FROM written JOIN generated USING (run)
WHERE trim(lower(pool_text)) IN ('loto6', 'loto7')
UNION ALL
SELECT series, draw_no, pool_text, 'the run names no known pool', NULL, NULL FROM written
WHERE pool_text IS NULL OR pool_text = 'mini'""")
register("excluded_tickets", D, RANKED, select="""
SELECT lottery_type, count(*) AS runs, count(*) * 5 AS tickets, 0 AS repeated FROM ranked WHERE rk > 1 GROUP BY lottery_type""")

# --- backtest -------------------------------------------------------------------------------


def case(rules: str) -> str:
    return f"CASE {rules} ELSE 0 END"


LABEL = "CASE {0} " + " ".join(f"WHEN {t} THEN '{label}'" for t, label in TIER_LABELS) + " END"
_PROFILE = "CASE WHEN lottery_type <> 'loto7' THEN 'ticket_' || ticket_no " + " ".join(
    f"WHEN ticket_no = {i} THEN '{p[0]}'" for i, p in enumerate(PROFILES, start=1)) + " ELSE 'profile_' || ticket_no END"
JUDGED = f"""
matched AS (
  SELECT r.*, g.ticket_no, g.ticket, len(list_intersect(g.ticket, r.main_numbers)) AS main_match,
         len(list_intersect(g.ticket, r.bonus_numbers)) AS bonus_match
  FROM runs r JOIN generated g USING (run)),
judged AS MATERIALIZED (
  SELECT *, {case(TIERS)} AS tier, {case(NEAR_MISS)} AS points, {_PROFILE} AS profile_name FROM matched),
bests AS MATERIALIZED (
  SELECT run, any_value(series) AS series, any_value(lottery_type) AS lottery_type, any_value(draw_no) AS draw_no,
         any_value(draw_date) AS draw_date, any_value(history_limit) AS history_limit, any_value(history_count) AS history_count,
         any_value(seed) AS seed, any_value(main_numbers) AS main_numbers, any_value(bonus_numbers) AS bonus_numbers, count(*) AS tickets,
         max({{'s': points, 'm': main_match, 'b': bonus_match, 't': tier}}) AS best,
         bool_or(tier = 1) AS first_found, bool_or(tier = 2) AS second_found
  FROM judged GROUP BY run)"""
_GRID = (*mixed("20, 100", "1, 2"), JUDGED)
_PLAIN = (*mixed("100", "1"), JUDGED)
_BEST_LABEL = LABEL.format("best.t")
register("prize_tiers", *_PLAIN, recursive=True, select="""
SELECT lottery_type, main_match, bonus_match, tier AS prize_tier, count(*) AS tickets FROM judged GROUP BY ALL""")
register("near_miss", *_PLAIN, recursive=True, select="""
SELECT lottery_type, points AS near_miss_score, count(*) AS tickets FROM judged GROUP BY ALL""")
register("backtest_runs", *_GRID, recursive=True, select=f"""
SELECT series, draw_no AS target_draw_no, history_limit, history_count, seed, tickets AS ticket_count, best.m AS best_main_match,
       best.b AS best_bonus_match, best.s AS best_near_miss_score, {_BEST_LABEL} AS best_prize,
       first_found::INT AS first_prize_found, second_found::INT AS second_prize_found FROM bests""")
register("backtest_tickets", *_PLAIN, recursive=True, select=f"""
SELECT draw_no AS target_draw_no, ticket_no, profile_name, {text('ticket')} AS prediction, main_match, bonus_match,
       {LABEL.format('tier')} AS prize, points AS near_miss_score FROM judged""")
register("backtest_run_detail", *_PLAIN, """
lines AS (SELECT run, string_agg(ticket_no || ' ' || array_to_string(ticket, '-') || ' ' || main_match || ' ' || bonus_match || ' ' || points, ';' ORDER BY ticket_no) AS ticket_lines
          FROM judged GROUP BY run)""", recursive=True, select=f"""
SELECT draw_no AS target_draw_no, draw_date::VARCHAR AS target_draw_date, {text('list_sort(main_numbers)')} AS target_main,
       {text('list_sort(bonus_numbers)')} AS target_bonus, history_count, 5 AS prediction_count, 'mixed' AS strategy, ticket_lines,
       {_BEST_LABEL} AS best_prize, best.s AS best_near_miss_score FROM bests JOIN lines USING (run)""")
register("backtest_jsonl", *_PLAIN, recursive=True, select=f"""
SELECT draw_no AS target_draw_no, {text('list_sort(main_numbers)')} AS target_main, {_BEST_LABEL} AS best_prize, tickets AS ticket_count FROM bests""")
register("untrainable_targets", D, select="SELECT series, min(draw_no) AS draw_no FROM d GROUP BY series")
_TIER_ROWS = ", ".join(f"({i}, {tier}, '{label}')" for i, (tier, label) in enumerate(TIER_LABELS, start=1))
register("prize_counts", *_GRID, f"tiers(position, tier, prize) AS (VALUES {_TIER_ROWS})", recursive=True, select="""
SELECT k.lottery_type, position, prize, count(j.run) AS tickets
FROM (SELECT DISTINCT lottery_type FROM judged) k CROSS JOIN tiers t LEFT JOIN judged j ON j.lottery_type = k.lottery_type AND j.tier = t.tier
GROUP BY ALL""")
register("group_summary", *_GRID, recursive=True, select=f"""
SELECT lottery_type, CASE WHEN grouping(draw_no) = 0 THEN 'target' WHEN grouping(history_limit) = 0 THEN 'history_limit' ELSE 'seed' END AS "grouping",
       coalesce(draw_no, history_limit, seed) AS group_key, count(*) AS runs,
       count(*) FILTER (WHERE first_found) AS first_runs, count(*) FILTER (WHERE second_found) AS second_runs,
       max(best).m AS best_main_match, max(best).b AS best_bonus_match, {LABEL.format('max(best).t')} AS best_prize,
       {r6('avg(best.s)')} AS avg_best_score
FROM bests GROUP BY GROUPING SETS ((lottery_type, draw_no), (lottery_type, history_limit), (lottery_type, seed))""")
_TIER_COUNTS = ", ".join(f"count(*) FILTER (WHERE tier = {t}) AS tier_{t}" for t in range(1, 7))
register("ticket_summary", *_GRID, recursive=True, select=f"""
SELECT lottery_type, ticket_no, profile_name, count(*) AS tickets, {_TIER_COUNTS},
       max({{'s': points, 'm': main_match, 'b': bonus_match}}).m AS best_main_match,
       max({{'s': points, 'm': main_match, 'b': bonus_match}}).b AS best_bonus_match, {r6('avg(points)')} AS avg_score
FROM judged GROUP BY lottery_type, ticket_no, profile_name""")
register("batch_totals", *_GRID, recursive=True, select=f"""
SELECT lottery_type, count(*) AS total_runs, sum(tickets)::BIGINT AS total_tickets, count(*) FILTER (WHERE first_found) AS first_prize_runs,
       count(*) FILTER (WHERE second_found) AS second_prize_runs,
       {r6('count(*) FILTER (WHERE second_found) / count(*)')} AS second_prize_rate FROM bests GROUP BY lottery_type""")
register("top_runs", *_GRID, recursive=True, select=f"""
SELECT row_number() OVER o AS rank, draw_no AS target_draw_no, history_limit, seed, best.m AS best_main_match, best.b AS best_bonus_match,
       {_BEST_LABEL} AS best_prize, best.s AS best_near_miss_score, first_found::INT AS first_prize_found, second_found::INT AS second_prize_found
FROM bests WINDOW o AS (ORDER BY first_found DESC, second_found DESC, best.s DESC, best.m DESC, best.b DESC, draw_no, history_limit, seed)
ORDER BY rank LIMIT 30""")
register("hit_examples", *_GRID, recursive=True, select=f"""
SELECT row_number() OVER o AS rank, draw_no AS target_draw_no, history_limit, seed, ticket_no, profile_name, main_match, bonus_match,
       {LABEL.format('tier')} AS prize, {text('ticket')} AS prediction
FROM judged WHERE tier IN (1, 2, 3) WINDOW o AS (ORDER BY points DESC, main_match DESC, bonus_match DESC, draw_no, history_limit, seed, ticket_no)
ORDER BY rank LIMIT 30""")

# --- tuning and prediction -------------------------------------------------------------------

# The grid, recency changing fastest.
_GRID_POINTS = [(f, r, y) for f in (0.8, 0.9, 1.0, 1.2) for r in (0.5, 1.0, 1.5, 2.0, 2.8) for y in (1.0, 1.5, 2.0)]
_GRID_ROWS = ", ".join(f"({i}, {f}::DOUBLE, {r}::DOUBLE, {y}::DOUBLE)" for i, (f, r, y) in enumerate(_GRID_POINTS))
_GRID_W = ("g.frequency", "g.recent", "g.recency", "0.8::DOUBLE", "0.4::DOUBLE")
# The newest 100 draws of each series, positions counted inside them.
LATEST = """
newest AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY series ORDER BY draw_no DESC) <= 100),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY draw_no) AS rk, count(*) OVER (PARTITION BY series) AS n FROM newest)"""
TUNED = (
    D, LATEST, "lim AS (SELECT 100::BIGINT AS history_limit)", dense("main"),
    f"grid(grid_id, frequency, recent, recency) AS (VALUES {_GRID_ROWS})", f"""
rounds AS MATERIALIZED (
  SELECT e.series, r.lottery_type, r.pool, r.pick, r.n - e.rk AS seed, r.main_numbers, g.grid_id, g.frequency, g.recent, g.recency,
         list(CASE WHEN number BETWEEN low AND high THEN {score_of(_GRID_W)} END ORDER BY number) AS main_scores
  FROM (SELECT series, rk, number, f, r, idx, mf, mr, mi, low, high, hn FROM main_extents) e JOIN
       (SELECT series, rk AS at, lottery_type, pool, pick, n, main_numbers FROM ranked) r ON r.series = e.series AND r.at = e.rk, grid g
  WHERE r.n - e.rk < least(20, greatest(8, r.n // 10)) AND e.hn >= 50 AND r.n > 51
  GROUP BY e.series, r.lottery_type, r.pool, r.pick, r.n, e.rk, r.main_numbers, g.grid_id, g.frequency, g.recent, g.recency)""", """
tune_runs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY series, grid_id, seed) AS run, * FROM rounds)""",
    *default_ctes("tune_runs"), """
round_best AS (
  SELECT run, max(len(list_intersect(ticket, main_numbers))) AS best_match FROM default_done JOIN tune_runs USING (run) GROUP BY run)""", """
fitness AS (
  SELECT series, grid_id, frequency, recent, recency, avg(best_match) AS score, count(*) AS rounds
  FROM tune_runs JOIN round_best USING (run) GROUP BY ALL)""", """
tuned AS MATERIALIZED (
  SELECT s.series, coalesce(f.frequency, 1.0) AS frequency, coalesce(f.recent, 2.0) AS recent, coalesce(f.recency, 1.5) AS recency,
         coalesce(f.score, 0.0) AS optimizer_score, coalesce(f.rounds, 0) AS optimizer_rounds
  FROM (SELECT DISTINCT series FROM d) s LEFT JOIN
       (SELECT * FROM fitness QUALIFY row_number() OVER (PARTITION BY series ORDER BY score DESC, grid_id) = 1) f USING (series))""",
)
register("tune_weights", *TUNED, recursive=True, select=f"""
SELECT series, frequency, recent, recency, {r6('optimizer_score')} AS optimizer_score, optimizer_rounds FROM tuned""")



def coming(pool: str, w: tuple[str, ...]) -> str:
    """Scores for the next draw of each series with its tuned weights, as a list."""
    return whole(f"n{pool}", pool, w).replace(
        f"FROM n{pool}_extents e LEFT JOIN n{pool}_counts c USING (series, number)) e)",
        f"FROM n{pool}_extents e LEFT JOIN n{pool}_counts c USING (series, number)) e JOIN tuned g USING (series))",
    ) + f""",
n{pool}_list AS (
  SELECT s.series, list(x.score ORDER BY n.number) AS {pool}_scores
  FROM tuned s CROSS JOIN (SELECT unnest(range(1, 44))::INT AS number) n
  LEFT JOIN n{pool} x ON x.series = s.series AND x.number = n.number GROUP BY s.series)"""


_TUNED_BONUS = ("(g.frequency * 0.9::DOUBLE)", "(g.recent * 0.8::DOUBLE)", "(g.recency * 1.0::DOUBLE)",
                "(0.8::DOUBLE * 1.2::DOUBLE)", "(0.4::DOUBLE * 0.5::DOUBLE)")


def predicted(payload: str, *extra: str, base: str = D) -> tuple[str, ...]:
    """Tickets of prediction runs; ``payload`` has one row per run."""
    return (
        base, *TUNED[1:], coming("main", _GRID_W), coming("bonus", _TUNED_BONUS), """
series_info AS (
  SELECT series, lottery_type, pool, pick, count(*) AS history_count, max(draw_no) AS latest, arg_max(draw_date, draw_no)::VARCHAR AS draw_date
  FROM ranked GROUP BY ALL)""",
        *extra, f"payload AS MATERIALIZED ({payload})",
        "coming_six AS (SELECT * FROM payload WHERE lottery_type = 'loto6')",
        "coming_seven AS (SELECT * FROM payload WHERE lottery_type = 'loto7')",
        *default_ctes("coming_six", "nxt", "nxt_done"), *profile_ctes("coming_seven", 10000), """
predicted AS MATERIALIZED (
  SELECT p.*, t.ticket_no, t.ticket FROM payload p JOIN
    (SELECT run, ticket_no, ticket FROM nxt_done UNION ALL SELECT run, ticket_no, ticket FROM profile_done) t USING (run))""",
    )


PREDICTED = predicted(f"""
  SELECT row_number() OVER (ORDER BY t.series) AS run, t.*, md5(t.series || '|{AS_OF}') AS execution_id,
         ('0x' || substr(md5(md5(t.series || '|{AS_OF}')), 1, 7))::BIGINT AS seed, l.lottery_type, l.pool, l.pick, l.history_count,
         l.latest AS latest_draw_no, l.draw_date, m.main_scores, b.bonus_scores
  FROM tuned t JOIN nmain_list m USING (series) JOIN nbonus_list b USING (series) JOIN series_info l USING (series)""")
register("tuned_prediction_run", *PREDICTED, recursive=True, select=f"""
SELECT execution_id, series, 100 AS history_limit, history_count, count(*) AS prediction_count,
       string_agg(array_to_string(ticket, ' '), ';' ORDER BY ticket_no) AS predictions, '{AS_OF}' AS created_at, 'SUCCESS' AS status,
       latest_draw_no, draw_date, 'mixed' AS strategy, seed, frequency, recent, recency, {r6('optimizer_score')} AS optimizer_score, optimizer_rounds
FROM predicted GROUP BY ALL""")
register("prediction_rows", *PREDICTED, recursive=True, select=f"""
SELECT execution_id, lottery_type, latest_draw_no AS draw_no, draw_date, ticket_no AS prediction_index,
       {', '.join(f'ticket[{i}] AS n{i}' for i in range(1, 8))}, 1 AS message_sent, '{AS_OF}' AS created_at FROM predicted""")
register("run_digest", *PREDICTED, recursive=True, select="""
SELECT execution_id, lottery_type, 'SUCCESS' AS status,
       upper(lottery_type) || ' 予想' || chr(10) || '回号: 第' || latest_draw_no || '回' || chr(10) || '実行日時: 2026-01-02 12:04:05' || chr(10)
       || '対象履歴: 直近' || history_count || '件' || chr(10) || '予想口数: ' || count(*) || '口' || chr(10) || '戦略: mixed' || chr(10) || chr(10)
       || string_agg(ticket_no || '口目: ' || array_to_string(ticket, ' '), chr(10) ORDER BY ticket_no) AS message
FROM predicted GROUP BY execution_id, lottery_type, latest_draw_no, history_count""")
register("recent_runs", *PREDICTED, recursive=True, select=f"""
SELECT execution_id, ticket_no AS prediction_index, lottery_type, latest_draw_no AS draw_no, '{AS_OF}' AS created_at
FROM predicted ORDER BY execution_id DESC, ticket_no DESC LIMIT 20""")

# --- pages -------------------------------------------------------------------------------------

register("page_months", D, select="""
SELECT lottery_type, strftime(m, '%Y%m') AS month, lottery_type || '/' || strftime(m, '%Y%m') AS page_key
FROM (SELECT lottery_type, unnest(generate_series(date_trunc('month', min(draw_date)), date_trunc('month', max(draw_date)), INTERVAL 1 MONTH)) AS m
      FROM d GROUP BY lottery_type)""")
register("missing_months", D, """
spine AS (SELECT lottery_type, unnest(generate_series(date_trunc('month', min(draw_date) - INTERVAL 2 MONTH), date_trunc('month', max(draw_date)), INTERVAL 1 MONTH)) AS m
          FROM d GROUP BY lottery_type)""", select="""
SELECT lottery_type, strftime(m, '%Y%m') AS month FROM spine s
WHERE strftime(m, '%Y%m')::INT % 5 = 0
   OR NOT EXISTS (SELECT 1 FROM d WHERE d.lottery_type = s.lottery_type AND date_trunc('month', d.draw_date) = s.m)""")
register("page_draws", D, select=f"""
SELECT lottery_type, strftime(draw_date, '%Y%m') AS month, draw_no, draw_date::VARCHAR AS draw_date, {_LISTS}, '' AS errors FROM d""")
register("page_latest", D, select=f"""
SELECT lottery_type, draw_no, draw_date::VARCHAR AS draw_date, CASE WHEN draw_no % 16 = 0
    THEN array_to_string(list_prepend(77, main_numbers[2:]), ',') ELSE {text('main_numbers')} END AS main_numbers,
  {text('bonus_numbers')} AS bonus_numbers, CASE WHEN draw_no % 16 = 0 THEN 'out_of_range' ELSE '' END AS errors FROM d
QUALIFY row_number() OVER (PARTITION BY lottery_type, strftime(draw_date, '%Y%m'), draw_no // 256 ORDER BY draw_no DESC) = 1""")
register("page_strict", D, select="SELECT DISTINCT lottery_type, 0 AS errors, 1 AS some FROM d")
register("unknown_pool_pages", select="SELECT page_id, 'unknown' AS lottery_type, url FROM pages WHERE page_id % 17 = 0")
register("page_dedupe", D, select=f"""
SELECT lottery_type, draw_no, draw_date::VARCHAR AS draw_date, {_LISTS} FROM d WHERE draw_date BETWEEN DATE '1996-02-10' AND DATE '2000-09-30'""")
register("harvest_to_csv", D, select=f"SELECT lottery_type, draw_no, draw_date::VARCHAR AS draw_date, {WIDE} FROM d")

# --- messages and streams ------------------------------------------------------------------------

MESSAGES = """
sent AS (
  SELECT event_id, md5(user_id || '|' || ts::DATE) AS execution_id, CASE WHEN event_id % 2 = 0 THEN 'loto6' ELSE 'loto7' END AS lottery_type,
         event_id + 1 AS draw_no, ts, event_type, event_id % 97 = 0 AS broken FROM events),
located AS (SELECT *, lottery_type || '/draw_no=' || draw_no || '/part.csv' AS object FROM sent)"""
register("message_decode", MESSAGES, select="""
SELECT event_id, execution_id, lottery_type, 'gs://raw/' || object AS gcs_uri, 'raw' AS bucket, object, draw_no, 1 AS notify FROM located WHERE NOT broken""")
register("required_fields", MESSAGES, select="""
SELECT CASE WHEN broken THEN 'lottery_type,gcs_uri' ELSE '' END AS missing, count(*) AS row_count FROM sent GROUP BY ALL""")
register("message_encode", MESSAGES, select="""
SELECT '{"execution_id":"' || execution_id || '","lottery_type":"' || lottery_type || '","draw_no":' || draw_no || '}' AS value
FROM sent WHERE NOT broken""")
register("dead_letters", MESSAGES, select="SELECT event_id, 'invalid_json' AS reason FROM sent WHERE broken")
register("stream_import", D, INCOMING, _NEW, select=f"""
SELECT lottery_type, draw_no, draw_date::VARCHAR AS draw_date, {_LISTS} FROM fresh""")
register("stage_outbox", D, INCOMING, _NEW, _METRICS, select="""
SELECT lottery_type, total_rows, inserted_rows, total_rows - inserted_rows AS skipped_rows, draw_no FROM metrics""")
register("stream_dedupe", MESSAGES, select="SELECT DISTINCT execution_id FROM sent WHERE NOT broken")
ORACLE["stream_dedupe_stateful"] = ORACLE["stream_dedupe"]
ORACLE["stream_dedupe_regrouped"] = ORACLE["stream_dedupe"]
register("stream_replay", D, INCOMING, _NEW, select="SELECT lottery_type, draw_no FROM fresh")
# One landed file is one batch, number 0.
register("import_to_digest", D, INCOMING, select="""
SELECT md5('import-0|' || lottery_type) AS execution_id, lottery_type, 'SUCCESS' AS status,
  upper(lottery_type) || ' 予想|回号: 第' || max(draw_no) || '回|実行日時: 2026-01-02 12:04:05|対象履歴: 直近'
    || least(60, (SELECT count(*) FROM d WHERE d.lottery_type = i.lottery_type)) || '件|予想口数: 2口|戦略: mixed' AS header,
  2 AS tickets
FROM incoming i GROUP BY lottery_type""")
register("stream_predictions", MESSAGES, """
asked AS (SELECT execution_id, max(lottery_type) AS lottery_type FROM sent WHERE NOT broken GROUP BY execution_id)""", select="""
SELECT lottery_type, 'SUCCESS' AS status, count(*) AS row_count, count(*) * 2 AS tickets FROM asked GROUP BY lottery_type
UNION ALL SELECT '-', 'FAILED', count(*), 0 FROM sent WHERE broken""")
register("prediction_sink", *PREDICTED, recursive=True, select="""
SELECT execution_id, ticket_no AS prediction_index, ticket[1] AS n1, ticket[6] AS n6, ticket[7] AS n7, latest_draw_no AS draw_no, lottery_type FROM predicted""")
register("audit_trail", MESSAGES, select=f"""
SELECT execution_id, 'stage_' || event_type AS stage, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
       object AS gcs_object, draw_no, ts::DATE::VARCHAR AS executed_date, NULL AS error_type, NULL AS error_detail FROM located WHERE NOT broken
UNION ALL
SELECT 'event-' || event_id, 'decode', 'FAILED', NULL, NULL, '{AS_OF[:10]}', 'dead_letter', 'invalid_json' FROM sent WHERE broken""")
register("audit_trace", MESSAGES, f"""
noted AS (
  SELECT execution_id, 'stage_' || event_type AS stage, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS executed_at FROM sent WHERE NOT broken
  UNION ALL SELECT 'event-' || event_id, 'decode', 'FAILED', '{AS_OF}' FROM sent WHERE broken)""", select="""
SELECT * FROM noted WHERE execution_id = (SELECT min(execution_id) FROM noted)""")
register("unsent_messages", MESSAGES, select="""
SELECT DISTINCT execution_id FROM sent WHERE NOT broken
  AND execution_id NOT IN (SELECT execution_id FROM sent WHERE NOT broken AND event_type = 'purchase')""")
register("requested_runs", *predicted("""
  SELECT row_number() OVER (ORDER BY q.execution_id) AS run, q.execution_id, ('0x' || substr(md5(q.execution_id), 1, 7))::BIGINT AS seed,
         l.lottery_type, l.pool, l.pick, q.draw_no AS latest_draw_no, m.main_scores, b.bonus_scores
  FROM requests q JOIN series_info l ON l.series = q.lottery_type JOIN nmain_list m ON m.series = l.series JOIN nbonus_list b ON b.series = l.series""",
    MESSAGES, """
requests AS (
  SELECT execution_id, max(lottery_type) AS lottery_type, arg_max(draw_no, {'k': lottery_type, 'n': draw_no}) AS draw_no
  FROM located WHERE NOT broken GROUP BY execution_id)""",
    base=D.replace("lottery_type || ':' || priority AS series", "lottery_type AS series")), recursive=True, select="""
SELECT execution_id, lottery_type, latest_draw_no, seed, string_agg(array_to_string(ticket, ' '), ';' ORDER BY ticket_no) AS predictions,
  'SUCCESS' AS status, 0 AS has_error
FROM predicted GROUP BY ALL
UNION ALL
SELECT execution_id || '-x', 'mini', draw_no, ('0x' || substr(md5(execution_id || '-x'), 1, 7))::BIGINT, '', 'FAILED', 1
FROM requests WHERE draw_no % 50 = 0""")


_ODD = """
turns AS (SELECT event_id AS i, event_id // 5 % 9 AS place, event_id // 45 % 9 AS flag, event_id % 19 AS bad,
  'o/' || event_id AS path FROM events),
odd AS (
  SELECT *, CASE WHEN i % 13 = 0 THEN 'mini' WHEN i % 2 = 0 THEN 'loto6' ELSE 'loto7' END AS kind,
    ['true', 'false', '"yes"', '""', '0', '1', '"false"', 'null'][flag] AS flag_text
  FROM turns),
told AS (
  SELECT *, '{' || concat_ws(',', '"draw_no":' || (i + 1), CASE WHEN i % 5 > 0 THEN '"execution_id":"e' || i || '"' END,
      CASE WHEN place IN (1, 2, 3, 4, 6) THEN '"gcs_bucket":"box"' END,
      CASE WHEN place IN (1, 5) THEN '"gcs_object":"' || path || '"' END,
      CASE WHEN place = 2 THEN '"gcs_path":"' || path || '"' END,
      CASE place WHEN 0 THEN '"gcs_uri":"gs://raw/' || path || '"' WHEN 6 THEN '"gcs_uri":" "' WHEN 7 THEN '"gcs_uri":"http://raw/' || path || '"' END,
      '"lottery_type":"' || CASE kind WHEN 'loto6' THEN ' LOTO6 ' ELSE kind END || '"',
      CASE WHEN place IN (4, 6) THEN '"name":"' || path || '"' END,
      '"notify":' || flag_text,
      CASE WHEN place = 3 THEN '"object":"' || path || '"' END) || '}' AS body,
    CASE WHEN place = 0 THEN 'raw' WHEN place IN (1, 2, 3, 4, 6) THEN 'box' WHEN place = 5 THEN 'spare' END AS bucket,
    CASE WHEN bad IN (0) THEN 'invalid_json' WHEN bad IN (1, 4) THEN 'not_object' WHEN bad IN (2, 5) THEN 'empty_data'
      WHEN bad IN (3, 6) THEN 'invalid_data' WHEN kind = 'mini' THEN 'unsupported_type'
      WHEN place = 8 THEN 'missing_uri' WHEN place = 7 THEN 'invalid_uri' END AS reason
  FROM odd)"""
register("message_forms", _ODD, select="""
SELECT i AS event_id, CASE WHEN i % 5 > 0 THEN 'e' || i ELSE sha256(body) END AS execution_id, kind AS lottery_type,
  'gs://' || bucket || '/' || path AS gcs_uri, bucket, path AS object, i + 1 AS draw_no,
  CASE WHEN flag IN (0, 1, 3, 6, 7) THEN 1 ELSE 0 END AS notify
FROM told WHERE reason IS NULL""")
register("dead_letter_reasons", _ODD, select="SELECT i AS event_id, reason FROM told WHERE reason IS NOT NULL")
register("prediction_requests", _ODD, select="""
SELECT kind AS lottery_type, CASE WHEN flag IN (1, 3, 6, 7) THEN 1 ELSE 0 END AS notify, count(*) AS row_count
FROM told WHERE bad > 6 AND kind <> 'mini' GROUP BY ALL""")
_REQUESTS = """
asked AS (
  SELECT o_orderkey AS k, CASE WHEN k % 23 = 0 THEN 'mini' WHEN k % 2 = 0 THEN 'loto6' ELSE 'loto7' END AS lottery_type,
    CASE WHEN k % 29 = 1 THEN [] WHEN k % 29 = 2 THEN [-1] ELSE [k % 5 * 10 + 10, k % 3 * 10 + 10, 20] END AS limits,
    k % 4 AS seed_from, CASE WHEN k % 31 = 3 THEN k % 4 - 2 ELSE k % 4 + k % 3 END AS seed_to,
    CASE WHEN k % 37 = 4 THEN 0 WHEN k % 37 = 5 THEN 7000000 ELSE k % 2 + 5 END AS ticket_count
  FROM orders),
judged_requests AS (
  SELECT *, concat_ws(',', CASE WHEN lottery_type = 'mini' THEN 'pool' END, CASE WHEN k % 29 IN (1, 2) THEN 'limits' END,
    CASE WHEN seed_to < seed_from THEN 'seeds' END, CASE WHEN ticket_count <= 0 THEN 'count' END,
    CASE WHEN ticket_count > CASE lottery_type WHEN 'loto6' THEN 6096454 WHEN 'loto7' THEN 10295472 END THEN 'combinations' END) AS errors
  FROM asked)"""
register("request_errors", _REQUESTS, select="SELECT k AS request_id, errors FROM judged_requests WHERE errors <> ''")
register("requested_grid", _REQUESTS, select="""
SELECT lottery_type, history_limit, seed, ticket_count, count(*) AS requests
FROM (SELECT lottery_type, ticket_count, unnest(list_distinct(limits)) AS history_limit, seed_from, seed_to FROM judged_requests WHERE errors = ''),
  unnest(range(seed_from, seed_to + 1)) AS seeds(seed)
GROUP BY ALL""")
