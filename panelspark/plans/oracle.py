"""Independent SQL for the registered queries, for an external engine on the same tables."""

from __future__ import annotations

from panelspark.operators import factors
from panelspark.operators.concentration import RULES
from panelspark.operators.positions import AGGRESSIVE_VOL, CURRENT_VOL, FIELD_VOL
from panelspark.plans.queries import LOOKAHEAD_CUTS, N_NAMES, N_RANDOM, SHORT_LOOKBACK, TRADING, WF, WINDOW

ORACLES: dict[str, str] = {}

# Expected maximum of n standard normals, by bisection on the error function.
EXPECTED_MAX = {3: 0.8528044961506948, 100: 2.530602893201681, 400: 2.984801504812923}


def q6(x: str) -> str:
    return f"floor(({x})*1e6+0.5)/1e6"


def r6(*names: str) -> str:
    return ", ".join(f"{q6(n)} AS {n}" for n in names)


def log_of(x: str, name: str, plus: str = "1 + ") -> str:
    wealth = f"{plus}({x})"
    return f"{q6(f'CASE WHEN {wealth} > 0 THEN ln({wealth}) END')} AS {name}"


def sql(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH RECURSIVE {ctes}\n{select}" if ctes else select


TICKS = """ticks AS (
  SELECT printf('S%06d', l_suppkey) AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
    l_extendedprice / l_quantity / 100 AS price, l_quantity AS quantity, CAST(round(l_discount * 100) AS BIGINT) AS dp, l_orderkey,
    row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem)"""
BARS = TICKS + """, bars AS (
  SELECT date, ticker, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
    arg_max(price, k) * (1 - CAST(sum(dp) AS DOUBLE) / count(*) / 100) AS adj_close, sum(quantity) AS volume, max(l_orderkey) AS seq
  FROM ticks GROUP BY date, ticker)"""
REGIONS = """sup AS (
  SELECT printf('S%06d', s_suppkey) AS ticker, s_suppkey, n_regionkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
RELEASE = """rel(list_date, o) AS (VALUES (DATE '1996-06-03', 0), (DATE '1998-01-05', 1), (DATE '2000-01-03', 2)),
lists AS (SELECT list_date, ticker, s_suppkey FROM sup JOIN rel ON n_regionkey <> o)"""
SCREEN = BARS + ", " + REGIONS + ", " + RELEASE + """, liq AS (
  SELECT *, close * volume AS dtv, row_number() OVER t - 1 AS bars_available,
    CASE WHEN count(close * volume) OVER p >= 30 THEN quantile_cont(close * volume, 0.5) OVER p END AS median_dtv
  FROM bars WINDOW t AS (PARTITION BY ticker ORDER BY date),
    p AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
asrel AS (SELECT b.*, (SELECT max(list_date) FROM rel WHERE list_date <= b.date) AS release FROM liq b),
flags AS (
  SELECT a.*, l.ticker IS NOT NULL AS member, coalesce(median_dtv >= 400, false) AS liquid,
    close BETWEEN 0.2 AND 50 AS priced, bars_available >= 52 AS seasoned
  FROM asrel a LEFT JOIN lists l ON l.list_date = a.release AND l.ticker = a.ticker),
screened AS (SELECT *, member AND liquid AND priced AND seasoned AS eligible FROM flags)"""
STUDY = SCREEN + """, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)),
study AS (
  SELECT s.*, c.i, adj_close / lag(adj_close) OVER (PARTITION BY s.ticker ORDER BY s.date) - 1 AS ret
  FROM screened s JOIN cal c USING (date))"""

# ---- scans and ingest
sql("weekly_bars", BARS, "SELECT date, ticker, open, high, low, close, adj_close, volume FROM bars")
for _name in ("streamed_bars_late", "panel_written_by_year"):
    sql(_name, BARS, "SELECT date, ticker, open, high, low, close, adj_close, volume FROM bars")
sql("panel_span", BARS, "SELECT count(*) AS n_bars, count(DISTINCT ticker) AS n_tickers, min(date) AS first_date, max(date) AS last_date FROM bars")
sql("streamed_bars", BARS, "SELECT date, ticker, open, high, low, close, adj_close, volume FROM bars")
sql("upsert_fresh_wins", BARS, """SELECT date, ticker, open, high, low, CASE WHEN volume >= 20 THEN close + 1 ELSE close END AS close,
  adj_close, volume FROM bars""")
sql("normalised_bars", BARS, """SELECT date, ticker || '.KL' AS ticker, open, high, low, close, close AS adj_close, volume
  FROM bars WHERE volume <> 7""")
sql("json_bars", BARS, """SELECT date, ticker, open, high, low, close, adj_close, CASE WHEN volume = 11 THEN 0 ELSE volume END AS volume
  FROM bars WHERE volume <> 7""")
EVENTS = REGIONS + """, ev AS (
  SELECT date, ticker, value FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars)
  JOIN (SELECT ticker, CASE WHEN s_acctbal < 0 THEN 0.2::DOUBLE WHEN s_acctbal > 8000 THEN 2.0::DOUBLE END AS value FROM sup) USING (ticker)
  WHERE n = 180 AND value IS NOT NULL)"""
sql("json_events", BARS + ", " + EVENTS, "SELECT date, ticker, value FROM ev")
sql("merged_events", BARS + ", " + EVENTS, "SELECT date, ticker, value FROM ev")
sql("text_codes", REGIONS + ", " + RELEASE, """SELECT strftime(list_date, '%Y-%m-%d') AS doc_id, printf('%04d', s_suppkey) AS code,
  count(*) OVER (PARTITION BY list_date) AS n_codes, count(*) OVER (PARTITION BY list_date) >= 300 AS plausible FROM lists""")
sql("text_sections", r"""lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS l FROM documents)),
starts AS (SELECT doc_id, min(line_no) AS s FROM lines WHERE regexp_matches(line, '(?i)\bthe\b') GROUP BY doc_id),
begun AS (
  SELECT doc_id, line_no, CASE WHEN line_no = s THEN regexp_replace(line, '(?i)^.*?\bthe\b', '') ELSE line END AS line
  FROM lines JOIN starts USING (doc_id) WHERE line_no >= s),
stops AS (SELECT doc_id, min(line_no) AS e FROM begun WHERE regexp_matches(line, '(?i)\bwith\b.*\bby\b') GROUP BY doc_id),
kept AS (
  SELECT doc_id, line_no, CASE WHEN line_no = e THEN regexp_replace(line, '(?i)\bwith\b.*\bby\b.*$', '') ELSE line END AS line
  FROM begun LEFT JOIN stops USING (doc_id) WHERE e IS NULL OR line_no <= e)""",
    "SELECT doc_id, count(*) AS n_lines, max(line_no) AS last_line, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM kept GROUP BY doc_id")
sql("candidate_codes", "", "SELECT DISTINCT printf('%04d', s_suppkey) AS code FROM supplier")
sql("fetch_worklist", "", """SELECT 'P' || p_partkey AS ticker FROM part
  WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)""")
sql("load_summary", BARS + ", " + REGIONS + ", " + RELEASE, """
SELECT w.ticker, count(b.date) AS rows, min(b.date) AS first_date, max(b.date) AS last_date, count(b.date) > 0 AS ok
FROM (SELECT DISTINCT ticker FROM lists UNION ALL SELECT 'UNKNOWN') w LEFT JOIN bars b USING (ticker) GROUP BY w.ticker""")
sql("coverage_profile", BARS, f"""SELECT ticker, n_bars, {q6('m')} AS median_recent_dtv, coalesce(m >= 500, false) AS above_floor FROM (
  SELECT ticker, count(*) AS n_bars, quantile_cont(close * volume, 0.5) FILTER (WHERE date > (SELECT max(date) FROM bars) - 90) AS m
  FROM bars GROUP BY ticker)""")
sql("coverage_summary", BARS, """SELECT count(*) AS n_tickers, min(n) AS min_bars, quantile_cont(n, 0.5) AS median_bars, max(n) AS max_bars,
  count(*) FILTER (m >= 500) AS n_above_floor FROM (SELECT count(*) AS n,
  quantile_cont(close * volume, 0.5) FILTER (WHERE date > (SELECT max(date) FROM bars) - 90) AS m FROM bars GROUP BY ticker)""")
sql("raw_glob_bars", BARS, """SELECT date, ticker || '.KL' AS ticker, open, high, low, close,
  CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 3 = 0 THEN close ELSE adj_close END AS adj_close, volume FROM bars""")
CODED = REGIONS + ", " + RELEASE + """, coded AS (SELECT list_date, printf('%05d', s_suppkey) AS ticker, s_suppkey % 7 = 0 AS bad FROM lists)"""
sql("membership_csv", CODED, "SELECT CASE WHEN NOT bad THEN list_date END AS list_date, ticker, bad FROM coded")
sql("membership_loaded", CODED, "SELECT DISTINCT list_date, ticker || '.KL' AS ticker FROM coded WHERE NOT bad")
sql("split_csv_scan", BARS + ", " + EVENTS, """SELECT count(*) AS n_lines, count(*) FILTER (bad) AS n_bad, count(DISTINCT ticker) AS n_tickers, count(*) FILTER (NOT bad) AS n_usable,
  min(date) AS first_date, max(date) AS last_date FROM (SELECT *, CAST(substr(ticker, 2) AS BIGINT) % 5 = 0 AS bad FROM ev)""")
sql("landed_panel", BARS, """SELECT date, ticker, open, high, low, close, adj_close, CASE WHEN volume = 11 THEN 0 ELSE volume END AS volume
  FROM bars WHERE volume <> 7""")
sql("verified_codes", BARS + ", " + REGIONS + ", " + RELEASE, """SELECT DISTINCT b.ticker AS code FROM bars b JOIN lists USING (ticker) WHERE b.volume >= 45""")
sql("snapshot_replaced", REGIONS + ", " + RELEASE, """SELECT list_date, ticker FROM lists WHERE list_date <> DATE '1998-01-05' OR s_suppkey % 2 = 0""")
sql("decision_journal", BARS, f"""SELECT strftime(date, '%Y-%m-%d') AS decision, 'volume' AS rule, ticker, {q6('close')} AS price, CAST(volume AS BIGINT) AS lots,
  {q6('close * volume')} AS notional, 10000.0::DOUBLE AS capital, volume AS score FROM bars WHERE date IN (DATE '1997-03-03', DATE '1999-06-07')""")
MOVED = BARS + """, moved AS (SELECT date, ticker FROM (SELECT date, ticker, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret
  FROM bars) WHERE abs(ret) > 1 / 3.0::DOUBLE),
tr AS (SELECT printf('S%06d', l_suppkey) AS ticker, CAST(l_shipdate AS DATE) AS traded_on, l_quantity AS quantity, l_orderkey,
  l_extendedprice / l_quantity / 100 AS price FROM lineitem)"""
sql("events_within_days", MOVED, """SELECT date, ticker, count(*) AS n_trades, sum(quantity) AS quantity, CAST(min(abs(date - traded_on)) AS INT) AS nearest_days
  FROM moved JOIN tr USING (ticker) WHERE traded_on BETWEEN date - 10 AND date + 10 GROUP BY date, ticker""")
sql("quotes_asof", MOVED + """, kn AS (SELECT ticker, date + 7 AS known_on, date AS bar_date, close AS prior_close FROM bars)""",
    f"""SELECT tr.ticker, traded_on, {q6('price')} AS price, l_orderkey, bar_date, {q6('prior_close')} AS prior_close
  FROM tr ASOF LEFT JOIN kn ON tr.ticker = kn.ticker AND tr.traded_on >= kn.known_on""")
sql("symbol_forms", "", """SELECT lower(printf('S%06d', s_suppkey)) AS code, printf('S%06d', s_suppkey) || '.KL' AS symbol,
  printf('S%06d', s_suppkey) AS bare, 'MY.' || printf('S%06d', s_suppkey) AS prefixed FROM supplier""")
sql("streamed_bad_bars", "", """SELECT violation, count(*) AS n_rows FROM (
  SELECT unnest(list_filter([CASE WHEN round(l_discount * 100) = 0 THEN 'brackets' END, CASE WHEN l_quantity = 1 THEN 'missing' END],
    lambda v: v IS NOT NULL)) AS violation FROM lineitem) GROUP BY violation""")

# ---- scalars
sql("bar_returns", BARS, f"""SELECT date, ticker, {q6('adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1')} AS ret
  FROM bars""")


def fee(v: str, rate: str, low: str, sst: str, bps: str) -> str:
    return (f"(CASE WHEN ({v}) > 0 THEN greatest(({v}) * {rate} / 100.0, {low}) * (1.0 + {sst}) + least(ceil(({v}) / 1000.0), 200.0::DOUBLE) "
            f"+ least(({v}) * 0.0003, 1000.0::DOUBLE) ELSE 0 END + ({v}) * {bps} / 10000.0)")


BROKER_ROWS = "brokers(broker, rate, low) AS (VALUES ('zero_commission', 0.0::DOUBLE, 0.0::DOUBLE), ('bank_low', 0.1, 8.0), ('bank_std', 0.1, 30.0))"
TOTAL = fee("v", "rate", "low", "0.08::DOUBLE", "15.0::DOUBLE")
sql("trade_costs", BROKER_ROWS + ", o AS (SELECT o_orderkey, o_totalprice AS v FROM orders)", f"""
SELECT o_orderkey, broker, {q6('greatest(v * rate / 100.0, low) * (1.0 + 0.08::DOUBLE)')} AS brokerage,
  least(ceil(v / 1000.0), 200.0::DOUBLE) AS stamp_duty, {q6('least(v * 0.0003::DOUBLE, 1000.0::DOUBLE)')} AS clearing_fee,
  {q6('v * 15.0::DOUBLE / 10000.0')} AS slippage, {q6(TOTAL)} AS total, {q6(f'2.0 * {TOTAL} / v * 100.0')} AS round_trip_pct FROM o, brokers""")
sql("affordable_lots", BARS, """SELECT date, ticker, CAST(floor(10000 / (close * 100)) AS BIGINT) AS lots,
  CAST(greatest(1, least(trunc(volume * 100 * 0.01::DOUBLE / 8.0), 200)) AS BIGINT) AS breadth FROM bars""")
sql("affordable_names", BARS, f"""SELECT date, {q6('m')} AS median_close, CAST(floor(10000 / (m * 100)) AS BIGINT) AS max_names
  FROM (SELECT date, quantile_cont(close, 0.5) AS m FROM bars GROUP BY date)""")
sql("market_sessions", """q AS (SELECT event_id, ts, ts + INTERVAL 50 MINUTES AS now FROM events),
m AS (SELECT *, hour(now) * 60 + minute(now) AS mm, isodow(now) >= 6 AS weekend, date_trunc('day', now) AS day FROM q),
s AS (SELECT *, CASE WHEN weekend THEN 'weekend' WHEN (mm >= 540 AND mm < 750) OR (mm >= 870 AND mm < 1020) THEN 'open'
    WHEN mm >= 750 AND mm < 870 THEN 'lunch break' ELSE 'closed' END AS market,
  CASE WHEN weekend THEN NULL WHEN mm >= 540 AND mm < 750 THEN day + INTERVAL 540 MINUTES
    WHEN mm >= 870 AND mm < 1020 THEN day + INTERVAL 870 MINUTES END AS session_start FROM m)""",
    f"""SELECT event_id, market, CAST(session_start AS TIMESTAMP) AS session_start, {q6("date_diff('microsecond', ts, now) / 60000000.0::DOUBLE")} AS age_minutes,
  CASE WHEN market <> 'open' THEN market
    WHEN date_diff('microsecond', greatest(ts, session_start), now) / 60000000.0::DOUBLE > 45 THEN 'stale' ELSE 'delayed' END AS staleness FROM s""")
QUOTES = """q AS (SELECT 'U' || user_id AS ticker, event_id, CASE WHEN event_type <> 'error' THEN value END AS price, value, ts AS quoted_at,
    CASE WHEN event_type = 'error' THEN 'no result' END AS error FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY quoted_at DESC, event_id DESC) AS n FROM q) WHERE n = 1),
first AS (SELECT ticker, arg_min(value, row(quoted_at, event_id)) AS prev_close, count(*) AS shares FROM q GROUP BY ticker)"""
sql("latest_quote", QUOTES, "SELECT ticker, event_id, price, quoted_at, error FROM last")
sql("streamed_stale", QUOTES + """, g AS (SELECT *, lag(quoted_at) OVER w AS before FROM q WHERE price IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY quoted_at)),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR quoted_at - before > INTERVAL 2 DAYS THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY quoted_at) AS k FROM g),
e AS (SELECT ticker, max(quoted_at) AS last_quoted_at, max(quoted_at) + INTERVAL 2 DAYS AS stale_at, arg_max(price, row(quoted_at, event_id)) AS last_price,
  count(*) AS n_quotes FROM i GROUP BY ticker, k)""", f"""SELECT ticker, last_quoted_at, stale_at, {q6('last_price')} AS last_price, n_quotes FROM e
  WHERE stale_at <= (SELECT max(quoted_at) - INTERVAL 1 HOUR FROM g)""")
sql("streamed_quotes", QUOTES, "SELECT ticker, event_id, price, quoted_at FROM last")
sql("position_standing", QUOTES + """, s AS (SELECT l.ticker, shares, prev_close AS entry_price, price,
    CASE WHEN price IS NOT NULL AND prev_close <> 0 THEN price / prev_close - 1 END AS change_pct,
    shares * price AS position_value, 10000.0::DOUBLE - shares * prev_close + coalesce(shares * price, 0) AS equity
  FROM last l JOIN first USING (ticker))""", f"""SELECT ticker, shares, entry_price, price, {r6('change_pct', 'position_value')},
  {q6('change_pct')} AS pnl_pct, {r6('equity')}, {q6('equity / 10000 - 1')} AS return_pct, 0.29::DOUBLE AS target_pct,
  {q6('0.29::DOUBLE - (equity / 10000 - 1)')} AS gap_pct FROM s""")
SITUATION = """s AS (SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS days_left, value / 100 - 0.2::DOUBLE AS my_return,
  event_type, greatest(0, (0.25::DOUBLE - value / 200) / 0.25::DOUBLE) AS giveback FROM events)"""
sql("position_verdicts", SITUATION + """, r AS (SELECT *, CASE WHEN event_type = 'error' THEN 'halted' WHEN event_type = 'signup' THEN 'not_eligible'
  WHEN days_left <= 3 THEN 'endgame' WHEN giveback >= 0.6 THEN 'momentum_spent' WHEN my_return < 0.29 THEN 'behind' ELSE 'ahead' END AS reason FROM s)""",
    f"""SELECT event_id, CAST(days_left AS INT) AS days_left, {r6('giveback')},
  CASE WHEN reason IN ('halted', 'not_eligible', 'momentum_spent') THEN 'SWITCH' ELSE 'HOLD' END AS action, reason FROM r""")
TARGET = FIELD_VOL * EXPECTED_MAX[400]
Z67 = 0.4399131656732338
sql("account_assessment", SITUATION + f""", a AS (SELECT event_id, days_left, {TARGET!r} - my_return AS gap,
    sqrt(days_left / 252.0::DOUBLE) * {CURRENT_VOL} AS vol_now, sqrt(days_left / 252.0::DOUBLE) * {AGGRESSIVE_VOL} AS vol_max FROM s),
b AS (SELECT *, CASE WHEN gap <= 0 THEN 0 ELSE gap / {Z67!r} END AS required_vol FROM a)""",
    f"""SELECT event_id, CAST(days_left AS INT) AS days_left, {r6('gap', 'required_vol', 'vol_now', 'vol_max')},
  CASE WHEN days_left = 0 THEN 'over' WHEN gap <= 0 THEN 'ahead' WHEN required_vol <= vol_now THEN 'on-track'
    WHEN required_vol <= vol_max THEN 'behind' ELSE 'far-behind' END AS verdict FROM b""")

# ---- quality
FLAWED = BARS + ", " + REGIONS + """, f0 AS (
  SELECT date, ticker, open, CASE WHEN volume = 17 THEN low - 1 ELSE high END AS high, CASE WHEN volume = 13 THEN -low ELSE low END AS low,
    CASE WHEN volume <> 7 THEN close END AS close,
    CASE WHEN n_regionkey = 2 THEN CASE WHEN volume <> 7 THEN close END ELSE adj_close END AS adj_close,
    CASE WHEN volume < 12 OR (n_regionkey = 4 AND volume < 26) THEN 0 ELSE volume END AS volume, seq, volume = 21 AS twice FROM bars JOIN sup USING (ticker)),
flawed AS (SELECT * FROM f0 UNION ALL SELECT * FROM f0 WHERE twice)"""
BRACKETS = "(high < low OR high < greatest(open, close) OR low > least(open, close))"
POSITIVE = "(open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR adj_close <= 0)"
SAME = "coalesce(abs(close - adj_close) <= 1e-8 + 1e-9 * abs(adj_close), false)"
sql("dq_ohlc", FLAWED, f"SELECT date, ticker, open, high, low, close FROM flawed WHERE {BRACKETS}")
sql("dq_positive", FLAWED, f"SELECT date, ticker, low FROM flawed WHERE {POSITIVE}")
sql("dq_duplicates", FLAWED, "SELECT date, ticker, copies FROM (SELECT *, count(*) OVER (PARTITION BY ticker, date) AS copies FROM flawed) WHERE copies > 1")
sql("dq_missing", FLAWED, "SELECT date, ticker, volume FROM flawed WHERE close IS NULL OR adj_close IS NULL OR volume IS NULL")
sql("dq_monotonic", FLAWED, """SELECT ticker, count(*) AS steps_back FROM (
  SELECT ticker, date, lag(date) OVER (PARTITION BY ticker ORDER BY seq, date) AS p FROM flawed) WHERE p > date GROUP BY ticker""")
sql("dq_adjustment", FLAWED, f"SELECT ticker, count(*) AS n_bars FROM flawed GROUP BY ticker HAVING bool_and({SAME})")
sql("dq_gaps", FLAWED, """SELECT date, ticker, CAST(date - p AS INT) AS gap_days FROM (
  SELECT date, ticker, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS p FROM flawed) WHERE date - p > 21""")
sql("dq_zero_volume", FLAWED, f"""SELECT ticker, {q6('avg(CAST(coalesce(volume, 0) <= 0 AS INT))')} AS zero_volume_share FROM flawed
  GROUP BY ticker HAVING avg(CAST(coalesce(volume, 0) <= 0 AS INT)) > 0.2::DOUBLE""")
sql("dq_depth", FLAWED, "SELECT ticker, count(*) AS n_bars FROM flawed GROUP BY ticker HAVING count(*) < 290")
NEAR = " OR ".join(f"abs(adj_ret - ({s})::DOUBLE) < 0.02" for s in (-0.5, -0.667, -0.75, -0.8, 1.0, 2.0))
sql("dq_extreme_moves", FLAWED + """, m AS (SELECT date, ticker, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date, seq) - 1 AS adj_ret
  FROM flawed)""", f"SELECT date, ticker, {r6('adj_ret')}, ({NEAR}) AS near_split_ratio FROM m WHERE abs(adj_ret) > 0.35")
sql("dq_summary", FLAWED + f""", m AS (SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date, seq) - 1 AS r,
    count(*) OVER (PARTITION BY ticker, date) AS copies,
    date - lag(date) OVER (PARTITION BY ticker ORDER BY date, seq) AS gap, lag(date) OVER (PARTITION BY ticker ORDER BY seq, date) AS p FROM flawed),
t AS (SELECT ticker, count(*) AS n, bool_and({SAME}) AS same, count(*) FILTER (WHERE p > date) AS back,
    avg(CAST(coalesce(volume, 0) <= 0 AS INT)) AS idle FROM m GROUP BY ticker),
c(check_name, n_bad) AS (
  SELECT 'OHLC brackets', count(*) FILTER (WHERE {BRACKETS}) FROM m UNION ALL SELECT 'positive prices', count(*) FILTER (WHERE {POSITIVE}) FROM m
  UNION ALL SELECT 'no duplicates', count(*) FILTER (WHERE copies > 1) FROM m
  UNION ALL SELECT 'no missing values', count(*) FILTER (WHERE close IS NULL OR adj_close IS NULL OR volume IS NULL) FROM m
  UNION ALL SELECT 'monotonic dates', count(*) FILTER (WHERE back > 0) FROM t UNION ALL SELECT 'adjustment applied', count(*) FILTER (WHERE same) FROM t
  UNION ALL SELECT 'extreme moves', count(*) FILTER (WHERE abs(r) > 0.35) FROM m UNION ALL SELECT 'calendar gaps', count(*) FILTER (WHERE gap > 21) FROM m
  UNION ALL SELECT 'zero-volume bars', count(*) FILTER (WHERE idle > 0.2) FROM t UNION ALL SELECT 'history depth', count(*) FILTER (WHERE n < 290) FROM t)""",
    'SELECT check_name AS "check", n_bad = 0 AS passed, CAST(n_bad AS BIGINT) AS n_bad FROM c')

_SAMPLED = {"OHLC brackets": BRACKETS, "positive prices": POSITIVE, "no duplicates": "copies > 1",
            "no missing values": "close IS NULL OR adj_close IS NULL OR volume IS NULL", "extreme moves": "abs(r) > 0.35", "calendar gaps": "gap > 21"}
sql("dq_samples", FLAWED + """, m AS (SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date, seq) - 1 AS r,
    count(*) OVER (PARTITION BY ticker, date) AS copies, date - lag(date) OVER (PARTITION BY ticker ORDER BY date, seq) AS gap FROM flawed),
f AS (""" + " UNION ALL ".join(f"SELECT DISTINCT '{name}' AS c, ticker, date FROM m WHERE {fault}" for name, fault in _SAMPLED.items()) + ")",
    'SELECT c AS "check", ticker, date FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY ticker, date) AS p FROM f) WHERE p <= 3')

# ---- repair
RATIO = "CASE WHEN value >= 1 THEN value ELSE 1 / value END"


def missed(source: str) -> str:
    """Bars whose vendor missed every event."""
    k = "CASE WHEN e.value IS NOT NULL AND b.date >= e.date THEN e.value ELSE 1 END"
    cols = ", ".join(f"b.{c} / ({k}) AS {c}" for c in ("open", "high", "low", "close", "adj_close"))
    return f", missed AS (SELECT b.date, b.ticker, {cols}, b.volume FROM {source} b LEFT JOIN ev e ON e.ticker = b.ticker)"


MOVES = """, mv AS (SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r, count(*) OVER (PARTITION BY ticker) AS nb FROM missed)"""
LOCATE = MOVES + f""", er AS (SELECT ticker, date AS recorded_date, value, {RATIO} AS ratio,
    CASE WHEN value > 1 THEN -(1 - 1 / ({RATIO})) ELSE ({RATIO}) - 1 END AS expected_step FROM ev),
lc AS (SELECT * FROM (SELECT er.*, m.date AS date, r, abs(r - expected_step) AS gap,
    row_number() OVER (PARTITION BY er.ticker, recorded_date, value ORDER BY abs(r - expected_step), m.date) AS n
  FROM mv m JOIN er ON er.ticker = m.ticker AND abs(m.date - recorded_date) <= 45 WHERE r IS NOT NULL AND nb >= 5) WHERE n = 1),
located AS (SELECT *, gap < abs(expected_step) * 0.35::DOUBLE AND abs(expected_step) >= 0.03 AS needs_repair FROM lc)"""
MISSED = BARS + ", " + EVENTS + missed("bars")
sql("split_locate", MISSED + LOCATE, f"""SELECT ticker, date, recorded_date, ratio, {q6('r')} AS observed_step, {r6('expected_step')}, needs_repair
  FROM located""")
KNOWN = " OR ".join(f"abs(ratio - {k}::DOUBLE) / {k} < 0.015" for k in (1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0))
DETECT = (""", d0 AS (SELECT date, ticker, adj_close / lag(adj_close) OVER t - 1 AS move,
    volume / CASE WHEN count(volume) OVER p >= 5 THEN quantile_cont(volume, 0.5) OVER p END AS vol_x,
    lead(adj_close, 3) OVER t / adj_close - 1 AS drift_after, lag(adj_close) OVER t AS prev_close
  FROM missed WINDOW t AS (PARTITION BY ticker ORDER BY date), p AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
d1 AS (SELECT *, CASE WHEN move < 0 THEN 1 / (1 + move) ELSE 1 + move END AS ratio FROM d0 WHERE abs(move) > 0.3),
d2 AS (SELECT *, (%s) AS ratio_ok, NOT coalesce(vol_x > 10, false) AS volume_ok, NOT coalesce(abs(drift_after) > 0.1, false) AS stable_after,
    prev_close >= 0.5 AND abs(prev_close - prev_close / ratio) >= 0.005::DOUBLE * 20 AS price_ok,
    EXISTS (SELECT 1 FROM ev WHERE ev.ticker = d1.ticker AND abs(ev.date - d1.date) <= 45
      AND CASE WHEN value > 1 THEN move < 0 ELSE move > 0 END AND abs(ratio - (%s)) / (%s) < 0.015) AS confirmed FROM d1)""" % (KNOWN, RATIO, RATIO))
sql("split_detect", MISSED + DETECT, f"""SELECT date, ticker, {r6('move', 'ratio', 'vol_x', 'drift_after')}, ratio_ok, volume_ok, stable_after, price_ok, confirmed,
  ratio_ok AND volume_ok AND stable_after AND price_ok AND confirmed AS is_split FROM d2""")
ADJUST = """, fx AS (SELECT ticker, date AS split_on, CASE WHEN r < 0 THEN ratio ELSE 1 / ratio END AS f FROM located WHERE needs_repair),
adjusted AS (SELECT m.date, m.ticker, open / k AS open, high / k AS high, low / k AS low, close / k AS close, adj_close / k AS adj_close, volume * k AS volume
  FROM (SELECT m.*, coalesce((SELECT product(f) FROM fx WHERE fx.ticker = m.ticker AND m.date < split_on), 1) AS k FROM missed m) m)"""
PRICES6 = r6("open", "high", "low", "close", "adj_close", "volume")
sql("split_adjust", MISSED + LOCATE + ADJUST, f"SELECT date, ticker, {PRICES6} FROM adjusted")
sql("unadjusted", FLAWED, "SELECT ticker FROM flawed GROUP BY ticker HAVING max(abs(close - adj_close)) <= 1e-9")
sql("bad_bars", FLAWED, f"SELECT date, ticker, open, high, low, close FROM flawed WHERE {BRACKETS} OR {POSITIVE}")
LANDED = (FLAWED + ", " + EVENTS.replace(REGIONS + ", ", "") + ", fl AS (SELECT * FROM f0 WHERE close IS NOT NULL)" + missed("fl") + LOCATE + ADJUST
          + f""", un AS (SELECT ticker FROM adjusted GROUP BY ticker HAVING max(abs(close - adj_close)) <= 1e-9),
bad AS (SELECT date, ticker FROM adjusted WHERE {BRACKETS} OR {POSITIVE})""")
sql("repaired_panel", LANDED, f"""SELECT date, ticker, {PRICES6} FROM adjusted
  WHERE ticker NOT IN (SELECT ticker FROM un) AND (date, ticker) NOT IN (SELECT (date, ticker) FROM bad)""")
sql("repair_report", LANDED + DETECT.replace("FROM missed WINDOW", "FROM adjusted WINDOW"), """
SELECT 'splits fixed' AS outcome, count(*) AS n FROM located WHERE needs_repair
UNION ALL SELECT 'suspect moves', count(*) FROM d2 WHERE NOT (ratio_ok AND volume_ok AND stable_after AND price_ok AND confirmed)
UNION ALL SELECT 'near misses', count(*) FROM d2 WHERE ratio_ok AND NOT confirmed
UNION ALL SELECT 'unadjusted tickers', count(*) FROM un UNION ALL SELECT 'quarantined tickers', 0 UNION ALL SELECT 'bad bars', (
  SELECT count(*) FROM adjusted WHERE (date, ticker) IN (SELECT (date, ticker) FROM bad))
UNION ALL SELECT 'actions checked', count(*) FROM located UNION ALL SELECT 'already applied', count(*) FROM located WHERE NOT needs_repair""")

# ---- two sources
SOURCES = BARS + ", " + REGIONS + """, b2 AS (SELECT date, ticker, close * CASE WHEN n_regionkey = 3 THEN 1.2::DOUBLE ELSE 1.003::DOUBLE END AS close_b, adj_close AS adj_b
  FROM bars JOIN sup USING (ticker) WHERE volume >= 10)"""
ALIGNED = """, al AS (SELECT *, abs(close / close_b - 1) AS close_diff, abs(adj_close / adj_b - 1) AS adj_diff FROM bars a FULL JOIN b2 USING (date, ticker)
  WHERE ticker IN (SELECT ticker FROM bars) AND ticker IN (SELECT ticker FROM b2))"""
sql("source_compare", SOURCES + ALIGNED + """, g AS (SELECT ticker, count(*) FILTER (WHERE close IS NOT NULL AND close_b IS NOT NULL) AS common_bars,
    count(*) FILTER (WHERE close_b IS NULL) AS only_a, count(*) FILTER (WHERE close IS NULL) AS only_b,
    coalesce(max(close_diff), 0) AS max_close_diff, coalesce(max(adj_diff), 0) AS max_adj_diff,
    count(*) FILTER (WHERE close_diff > 0.005) AS close_mismatches, count(*) FILTER (WHERE adj_diff > 0.02) AS adj_mismatches FROM al GROUP BY ticker)""",
    f"""SELECT ticker, common_bars, only_a, only_b, {r6('max_close_diff', 'max_adj_diff')}, close_mismatches, adj_mismatches,
  close_mismatches = 0 AND adj_mismatches = 0 AS clean, greatest(max_close_diff, max_adj_diff) > 0.1 AS material FROM g""")
sql("source_worst_rows", SOURCES.replace("b2 AS (SELECT date, ticker, close * CASE WHEN n_regionkey = 3 THEN 1.2::DOUBLE ELSE 1.003::DOUBLE END AS close_b",
    "b2 AS (SELECT date, ticker, close * CASE WHEN n_regionkey = 3 THEN 1.2::DOUBLE ELSE 1.003::DOUBLE END * (1 + (date - DATE '1995-01-02') / 10000.0::DOUBLE) AS close_b")
    + ALIGNED + """, w AS (SELECT ticker, date, close_diff, adj_diff, row_number() OVER (PARTITION BY ticker ORDER BY close_diff DESC, date) AS place
  FROM al WHERE close_diff > 0.005)""", f"SELECT ticker, date, {r6('close_diff', 'adj_diff')}, {q6('close_diff')} AS diff, place FROM w WHERE place <= 5")
sql("splits_applied", MISSED + MOVES + """, st AS (SELECT * FROM (SELECT ev.ticker, ev.date, value, r,
    row_number() OVER (PARTITION BY ev.ticker, ev.date, value ORDER BY abs(r) DESC, m.date) AS n
  FROM mv m JOIN ev ON ev.ticker = m.ticker AND m.date - ev.date BETWEEN -45 AND 5 WHERE r IS NOT NULL) WHERE n = 1)""",
    f"""SELECT ticker, date, value AS ratio, {q6('r')} AS adj_step,
  NOT coalesce(abs(CASE WHEN r < 0 THEN 1 / (1 + r) ELSE 1 + r END - value) / value < 0.05, false) AS applied FROM st""")
sql("feed_agreement", QUOTES, f"""SELECT ticker, {q6('abs(price / nullif(prev_close, 0) - 1)')} AS gap,
  coalesce(abs(price / nullif(prev_close, 0) - 1) <= 0.5, false) AS agrees FROM last JOIN first USING (ticker)""")

# ---- universe
sql("membership_asof", SCREEN, "SELECT date, ticker, member FROM screened")
sql("membership_backfilled", BARS + ", " + REGIONS + ", " + RELEASE + """, d AS (SELECT date, ticker,
  coalesce((SELECT max(list_date) FROM rel WHERE list_date <= b.date), (SELECT min(list_date) FROM rel)) AS list_date FROM bars b)""",
    "SELECT date, CAST(sum(CAST(l.ticker IS NOT NULL AS INT)) AS BIGINT) AS n_members FROM d LEFT JOIN lists l USING (list_date, ticker) GROUP BY date")
sql("members_on", REGIONS + ", " + RELEASE, "SELECT ticker FROM lists WHERE list_date = (SELECT max(list_date) FROM rel WHERE list_date <= DATE '1999-06-30')")
sql("liquidity", SCREEN, f"SELECT date, ticker, {r6('dtv', 'median_dtv')}, bars_available FROM screened")
FLAGS = "member, liquid, priced, seasoned, eligible"
sql("universe_members", SCREEN, "SELECT DISTINCT ticker FROM screened WHERE date = DATE '1999-06-07' AND eligible")
sql("universe_series", SCREEN, """SELECT date, count(DISTINCT ticker) AS n_listed, CAST(sum(CAST(eligible AS INT)) AS BIGINT) AS n_eligible
  FROM screened GROUP BY date""")
sql("screened", SCREEN, f"SELECT date, ticker, bars_available, {FLAGS} FROM screened")
sql("screen_summary", SCREEN, "SELECT date, count(DISTINCT ticker) AS n_listed, " + ", ".join(
    f"CAST(sum(CAST({f} AS INT)) AS BIGINT) AS n_{f}" for f in FLAGS.split(", ")) + " FROM screened GROUP BY date")
sql("rejections", SCREEN, f"SELECT date, ticker, {r6('median_dtv')}, bars_available, {FLAGS} FROM screened")
sql("eligibility", SCREEN, f"""SELECT date, ticker, condition, passed, {q6('detail')} AS detail FROM (
  SELECT date, ticker, 'member' AS condition, member AS passed, NULL::DOUBLE AS detail FROM screened
  UNION ALL SELECT date, ticker, 'liquid', liquid, median_dtv FROM screened UNION ALL SELECT date, ticker, 'priced', priced, close FROM screened
  UNION ALL SELECT date, ticker, 'seasoned', seasoned, bars_available FROM screened)""")
ASOF = """, tradable AS (SELECT max(date) AS as_of FROM (SELECT date FROM screened WHERE eligible GROUP BY date HAVING count(DISTINCT ticker) >= 5))"""
sql("latest_tradable", SCREEN + ASOF, """SELECT as_of, newest, CAST(DATE '2001-12-01' - as_of AS INT) AS age_days, DATE '2001-12-01' - as_of <= 30 AS fresh,
  newest > as_of AS ragged_edge FROM tradable, (SELECT max(date) AS newest FROM screened)""")
sql("backfilled_share", SCREEN + """, e AS (SELECT date, a.ticker FROM asrel a JOIN lists l ON l.ticker = a.ticker
    AND l.list_date = coalesce(a.release, DATE '1996-06-03') WHERE median_dtv >= 400 AND close BETWEEN 0.2 AND 50 AND bars_available >= 26)""",
    """SELECT count(*) AS n_eligible, count(*) FILTER (WHERE date >= DATE '1996-06-03') AS n_point_in_time,
  count(*) FILTER (WHERE date < DATE '1996-06-03') AS n_backfilled, count(DISTINCT ticker) AS n_names FROM e""")

# ---- factors


def at(col: str, k: int) -> str:
    """Value k calendar dates away, null when the ticker has no bar there."""
    side = f"{-k} PRECEDING" if k <= 0 else f"{k} FOLLOWING"
    return f"max({col}) OVER (PARTITION BY ticker ORDER BY i RANGE BETWEEN {side} AND {side})"


FACTORS = STUDY + f""", fw AS (
  SELECT *, CASE WHEN i >= 146 THEN {at('adj_close', -21)} / {at('adj_close', -146)} - 1 END AS momentum,
    CASE WHEN i >= 21 THEN -(adj_close / {at('adj_close', -21)} - 1) END AS reversal,
    CASE WHEN i >= 63 THEN avg(dtv) OVER w5 / avg(dtv) OVER w63 END AS volume_surge,
    count(ret) OVER w63 AS m, coalesce(sum(ret) OVER w63, 0) AS s1, least(63, i - min(i) OVER (PARTITION BY ticker)) AS nn,
    var_pop(ret) OVER w63 AS vp, avg(ret) OVER w63 AS av
  FROM study WINDOW w5 AS (PARTITION BY ticker ORDER BY i RANGE BETWEEN 4 PRECEDING AND CURRENT ROW),
    w63 AS (PARTITION BY ticker ORDER BY i RANGE BETWEEN 62 PRECEDING AND CURRENT ROW)),
fx0 AS (SELECT *, CASE WHEN i >= 64 AND nn >= 2 THEN sqrt((vp * m + av * av * m * (nn - m) / nn) / (nn - 1)) * sqrt(252.0::DOUBLE) END AS volatility FROM fw)"""
for _q, _f in (("factor_momentum", "momentum"), ("factor_reversal", "reversal"), ("factor_vol", "volatility"), ("factor_surge", "volume_surge")):
    sql(_q, FACTORS, f"SELECT date, ticker, {r6(_f)} FROM fx0 WHERE {_f} IS NOT NULL")
RANKS = FACTORS + """, lf AS (
  SELECT date, ticker, factor, raw FROM (
    SELECT date, ticker, 'momentum' AS factor, momentum AS raw FROM fx0 WHERE eligible UNION ALL SELECT date, ticker, 'reversal', reversal FROM fx0 WHERE eligible
    UNION ALL SELECT date, ticker, 'volatility', volatility FROM fx0 WHERE eligible UNION ALL SELECT date, ticker, 'low_vol', -volatility FROM fx0 WHERE eligible
    UNION ALL SELECT date, ticker, 'volume_surge', volume_surge FROM fx0 WHERE eligible) WHERE raw IS NOT NULL),
pr AS (SELECT *, (rank() OVER (PARTITION BY date, factor ORDER BY raw) + (count(*) OVER (PARTITION BY date, factor, raw) - 1) / 2.0::DOUBLE)
    / count(*) OVER (PARTITION BY date, factor) * 100 AS pct FROM lf)"""
_weights = ", ".join(f"('{s.name}', '{f}', {w / sum(x for _, x in s.weights)!r}::DOUBLE, {s.top_n})" for s in factors.PRESETS for f, w in s.weights)
SCORES = RANKS + f""", sw(strategy, factor, weight, top_n) AS (VALUES {_weights}),
cp AS (SELECT strategy, date, ticker, pr.factor, raw, pct, pct * weight AS contrib, top_n FROM pr JOIN sw USING (factor)),
live AS (SELECT strategy, date, count(DISTINCT factor) AS k FROM cp GROUP BY strategy, date),
cs AS (SELECT strategy, date, ticker, sum(contrib ORDER BY factor) AS score, any_value(top_n) AS top_n FROM cp GROUP BY strategy, date, ticker
  HAVING count(*) = (SELECT k FROM live l WHERE l.strategy = cp.strategy AND l.date = cp.date)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, date ORDER BY score DESC, ticker) AS place FROM cs) WHERE place <= top_n)"""
sql("pct_rank", RANKS, f"SELECT date, ticker, factor, {r6('pct')} FROM pr")
sql("composite_scores", SCORES, f"SELECT strategy, date, ticker, {r6('score')} FROM cs")
_comp = ", ".join(f"{q6(f'max({c}) FILTER (WHERE factor = {chr(39)}{f}{chr(39)})')} AS {p}_{f}" for f, _ in factors.PRESETS[0].weights
                  for p, c in (("raw", "raw"), ("pct", "pct"), ("contrib", "contrib")))
sql("composite_components", SCORES, f"SELECT date, ticker, {_comp}, {q6('sum(contrib)')} AS score FROM cp WHERE strategy = 'tournament' GROUP BY date, ticker")
sql("top_n_signal", SCORES, "SELECT strategy, date, ticker, place FROM top")
sql("forward_returns", BARS, f"""SELECT date, ticker, {q6('f')} AS fwd_return FROM (
  SELECT date, ticker, lead(adj_close, 22) OVER t / lead(adj_close, 1) OVER t - 1 AS f FROM bars WINDOW t AS (PARTITION BY ticker ORDER BY date)) WHERE f IS NOT NULL""")


def buckets(factor: str) -> str:
    return SCREEN + f""", bf AS (SELECT date, ticker, eligible, {factor} AS factor, lead(adj_close, 22) OVER t / lead(adj_close, 1) OVER t - 1 AS fwd
  FROM (SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM screened)
  WINDOW t AS (PARTITION BY ticker ORDER BY date), w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
bo AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor, ticker) AS rn, count(*) OVER (PARTITION BY date) AS m
  FROM bf WHERE eligible AND factor IS NOT NULL AND fwd IS NOT NULL),
bk AS (SELECT date, ticker, fwd, CAST(greatest(1, ceil((rn - 1) * 10 / CAST(m - 1 AS DOUBLE))) AS INT) AS bucket FROM bo WHERE m >= 20),
br AS (SELECT bucket, count(*) AS n, count(DISTINCT date) / 21.0::DOUBLE AS independent_periods, quantile_cont(fwd, 0.5) AS median, avg(fwd) AS mean,
    quantile_cont(fwd, 0.05) AS p05, quantile_cont(fwd, 0.25) AS p25, quantile_cont(fwd, 0.75) AS p75, quantile_cont(fwd, 0.95) AS p95,
    avg(CAST(fwd > 0 AS INT)) AS p_positive, avg(CAST(fwd > 0.2 AS INT)) AS p_gain_20, avg(CAST(fwd < -0.2 AS INT)) AS p_loss_20,
    avg(CAST(fwd < -0.3 AS INT)) AS p_loss_30, count(*) < 100 AS thin FROM bk GROUP BY bucket)"""


MOM60 = "adj_close / lag(adj_close, 60) OVER t - 1"
RATES = r6("independent_periods", "median", "mean", "p05", "p25", "p75", "p95", "p_positive", "p_gain_20", "p_loss_20", "p_loss_30")
sql("deciles", buckets(MOM60), "SELECT date, ticker, bucket FROM bk")
sql("base_rates", buckets(MOM60), f"SELECT bucket, n, {RATES}, thin FROM br")
sql("base_rates_volatility", buckets("CASE WHEN count(ret) OVER w = 60 THEN stddev_samp(ret) OVER w END"), f"SELECT bucket, n, {RATES}, thin FROM br")
TODAY = buckets(MOM60) + ASOF + """, tr AS (SELECT date, ticker, factor, row_number() OVER (ORDER BY factor DESC, ticker) AS rank, count(*) OVER () AS n_universe
  FROM bf WHERE date = (SELECT as_of FROM tradable) AND eligible AND factor IS NOT NULL),
tb AS (SELECT *, CAST(greatest(1, ceil((n_universe - rank + 1) / CAST(n_universe AS DOUBLE) * 10)) AS INT) AS bucket FROM tr)"""
sql("current_bucket", TODAY, f"""SELECT date, ticker, rank, n_universe, bucket, {q6('factor')} AS factor_value,
  {q6('(n_universe - rank + 1) / CAST(n_universe AS DOUBLE)')} AS percentile FROM tb""")
sql("decile_report", TODAY, f"SELECT ticker, rank, tb.bucket, n, {r6('median', 'p_positive')} FROM tb JOIN br USING (bucket)")

# ---- backtests: one chain of CTEs from (runs, specs, signals)


def schedule(specs: str) -> str:
    """specs(schedule_id, rule, lo, hi) to decisions per schedule."""
    return f""", specs AS ({specs}),
sd AS (SELECT schedule_id, date, i, CASE rule WHEN 'ME' THEN date_trunc('month', date) WHEN 'YE' THEN date_trunc('year', date)
    ELSE date + CAST((12 - isodow(date)) % 7 AS INT) END AS period FROM cal JOIN specs ON date >= lo AND (hi IS NULL OR date < hi)),
sx AS (SELECT *, max(date) OVER (PARTITION BY schedule_id, period) AS plast, min(date) OVER s AS pfirst, min(i) OVER s AS first_i, max(i) OVER s AS last_i,
    lead(date) OVER (PARTITION BY schedule_id ORDER BY date) AS exec_date, lead(i) OVER (PARTITION BY schedule_id ORDER BY date) AS exec_i
  FROM sd WINDOW s AS (PARTITION BY schedule_id)),
dec AS (SELECT schedule_id, row_number() OVER o - 1 AS step, date AS decision_date, i, exec_date, exec_i, first_i, last_i, lead(exec_i) OVER o AS next_i
  FROM sx WHERE (date = plast OR date = pfirst) AND exec_date IS NOT NULL WINDOW o AS (PARTITION BY schedule_id ORDER BY date))"""


WHOLE = "SELECT r AS schedule_id, r AS rule, (SELECT min(date) FROM cal) AS lo, NULL::DATE AS hi FROM (VALUES {}) v(r)"
CAL = BARS + ", cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars))"
sql("rebalance_dates", CAL + schedule(WHOLE.format("('ME'), ('W-FRI'), ('YE')")), "SELECT schedule_id, step, decision_date, exec_date FROM dec")
_B = TRADING.broker
COST = fee("d * eq", f"{_B.rate_pct}::DOUBLE", f"{_B.min_fee}::DOUBLE", f"{_B.sst}::DOUBLE", f"{TRADING.slippage_bps}::DOUBLE")


def trade(p: str = "") -> str:
    """runs(run_id, schedule_id, maxp), dec and sig(run_id, decision_date, ticker, weight, ord) to returns and summaries."""
    text = f""",
@tg AS (SELECT run_id, step, ticker, weight / sum(weight) OVER (PARTITION BY run_id, step) AS w FROM (
  SELECT s.*, step, maxp, row_number() OVER (PARTITION BY s.run_id, step ORDER BY weight DESC, ord) AS pl
  FROM @sig s JOIN @runs r USING (run_id) JOIN @dec d ON d.schedule_id = r.schedule_id AND d.decision_date = s.decision_date) WHERE pl <= maxp),
@rs AS (SELECT run_id, d.* FROM @runs r JOIN @dec d USING (schedule_id)),
@ch AS (SELECT run_id, step, ticker, sum(f) AS from_w, sum(t) AS to_w, abs(sum(t) - sum(f)) AS delta FROM (
  SELECT run_id, step, ticker, 0::DOUBLE AS f, w AS t FROM @tg
  UNION ALL SELECT run_id, step + 1, ticker, w, 0 FROM @tg JOIN (SELECT run_id, max(step) AS ls FROM @rs GROUP BY run_id) USING (run_id) WHERE step < ls)
  GROUP BY run_id, step, ticker),
@ds AS (SELECT run_id, step, coalesce(ds, []::DOUBLE[]) AS ds, coalesce(tn, 0) AS tn FROM @rs LEFT JOIN (
  SELECT run_id, step, list(delta ORDER BY ticker) FILTER (WHERE delta > 1e-9) AS ds, sum(delta) AS tn FROM @ch GROUP BY run_id, step) USING (run_id, step)),
@eq AS (
  SELECT run_id, 0::BIGINT AS step, {TRADING.capital}::DOUBLE AS eq, (SELECT coalesce(list_sum(list_transform(ds, lambda d: {COST.replace('eq', str(TRADING.capital) + '::DOUBLE')})), 0) FROM @ds z WHERE z.run_id = r.run_id AND z.step = 0)::DOUBLE AS cost FROM @runs r
  UNION ALL SELECT e.run_id, e.step + 1, e.eq - e.cost, coalesce(list_sum(list_transform(d.ds, lambda d: {COST.replace('eq', '(e.eq - e.cost)')})), 0)::DOUBLE
  FROM @eq e JOIN @ds d ON d.run_id = e.run_id AND d.step = e.step + 1 WHERE e.cost < e.eq),
@st AS (SELECT run_id, step, eq AS equity_before, cost, least(cost, eq) AS charged, cost >= eq AS ruined, exec_date, exec_i FROM @eq JOIN @rs USING (run_id, step)),
@hd AS (SELECT run_id, ticker, w, unnest(generate_series(exec_i + 1, coalesce(next_i, last_i))) AS i FROM @tg JOIN @rs USING (run_id, step)),
@gr AS (SELECT run_id, i, sum(w * ret) AS g FROM @hd JOIN study USING (ticker, i) WHERE ret IS NOT NULL GROUP BY run_id, i),
@sp AS (SELECT run_id, min(first_i) AS a, max(last_i) AS b FROM @rs GROUP BY run_id),
@dy AS (SELECT p.run_id, c.date, c.i, CASE WHEN c.i >= ruin_i OR c.i = a THEN 0 ELSE coalesce(g, 0) - coalesce(charged / equity_before, 0) END AS ret,
    coalesce(c.i >= ruin_i, false) AS over
  FROM @sp p JOIN cal c ON c.i BETWEEN a AND b LEFT JOIN (SELECT run_id, exec_i AS ruin_i FROM @st WHERE ruined) u USING (run_id)
  LEFT JOIN @gr g ON g.run_id = p.run_id AND g.i = c.i LEFT JOIN @st s ON s.run_id = p.run_id AND s.exec_i = c.i),
@sm AS (SELECT run_id, (SELECT count(*) FROM @rs r WHERE r.run_id = s.run_id) AS n_rebalances, sum(charged) / {TRADING.capital} AS cost_drag,
    avg(tn) AS avg_turnover, max(exec_date) FILTER (WHERE ruined) AS ruined_on FROM @st s JOIN @ds USING (run_id, step) GROUP BY run_id)"""
    return text.replace("@", p)


def metrics(src: str, p: str = "") -> str:
    """src(run_id, date, ret) to one row of statistics per run in {p}mt."""
    text = f""",
@eqy AS (SELECT run_id, date, ret, product(1 + ret) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM {src} WHERE ret IS NOT NULL),
@ddn AS (SELECT *, e / max(e) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM @eqy),
@mo AS (SELECT run_id, avg(ret) AS mu, var_pop(ret) AS v FROM @ddn GROUP BY run_id),
@ma AS (SELECT run_id, count(*) AS n, product(1 + ret) AS growth, any_value(mu) AS mu, stddev_samp(ret) AS sd, count(*) FILTER (WHERE ret < 0) AS nd,
    stddev_samp(ret) FILTER (WHERE ret < 0) AS sdd, min(dd) AS max_dd, avg(CAST(ret > 0 AS INT)) AS hit_rate, any_value(v) AS v,
    avg((ret - mu) ** 3) AS m3, avg((ret - mu) ** 4) AS m4 FROM @ddn JOIN @mo USING (run_id) GROUP BY run_id),
@mb AS (SELECT *, growth - 1 AS total_return, CASE WHEN growth <= 0 THEN -1 ELSE growth ** (252.0::DOUBLE / n) - 1 END AS cagr,
    CASE WHEN n >= 2 THEN sd * sqrt(252.0::DOUBLE) ELSE 0 END AS vol, CASE WHEN n >= 2 AND sd > 0 THEN mu / sd * sqrt(252.0::DOUBLE) ELSE 0 END AS sharpe,
    CASE WHEN n >= 2 AND nd >= 2 AND sdd > 0 THEN mu / sdd * sqrt(252.0::DOUBLE) ELSE 0 END AS sortino,
    CASE WHEN sd >= 1e-12 THEN m3 / v ** 1.5 ELSE 0 END AS skew, CASE WHEN sd >= 1e-12 THEN m4 / (v * v) ELSE 3 END AS kurt FROM @ma),
@mt AS (SELECT *, n AS n_periods, CASE WHEN max_dd < 0 THEN cagr / abs(max_dd) ELSE 0 END AS calmar FROM @mb)"""
    return text.replace("@", p)


def psr_z(n_trials: int) -> str:
    return (f"(sharpe / sqrt(252.0::DOUBLE) - sqrt(1.0::DOUBLE / (n - 1)) * {EXPECTED_MAX[n_trials]!r}) * sqrt(n - 1) / "
            "sqrt(1 - skew * sharpe / sqrt(252.0::DOUBLE) + (kurt - 1) / 4 * (sharpe * sharpe / 252))")


PICKS = SCORES + schedule(WHOLE.format("('ME')")) + f""",
runs AS (SELECT DISTINCT strategy AS run_id, 'ME' AS schedule_id, {TRADING.max_positions} AS maxp FROM sw),
sig AS (SELECT strategy AS run_id, date AS decision_date, ticker, 1.0::DOUBLE AS weight, printf('%06d', place) AS ord FROM top)""" + trade()
sql("target_weights", PICKS, f"SELECT run_id, step, ticker, {q6('w')} AS weight FROM tg")
sql("turnover", PICKS, f"SELECT run_id, step, {q6('tn')} AS turnover FROM st JOIN ds USING (run_id, step)")
sql("backtest_costs", PICKS, f"SELECT run_id, step, exec_date, {r6('equity_before', 'cost', 'charged')}, ruined FROM st")
sql("trades", PICKS, f"""SELECT run_id, step, exec_date, ticker, {r6('from_w', 'to_w')}, {q6('delta * equity_before')} AS notional,
  {q6(COST.replace('d * eq', 'delta * equity_before'))} AS cost FROM ch JOIN st USING (run_id, step) WHERE delta > 1e-9""")
_CHOSEN = factors.PRESETS[1].name
sql("run_signal", PICKS, f"SELECT run_id, date, {r6('ret')} FROM dy WHERE run_id = '{_CHOSEN}'")
sql("signal_lookahead", PICKS, " UNION ALL ".join(
    f"""SELECT DATE '{cut}' AS cut, count(*) AS n_decisions, 0::BIGINT AS n_differ, true AS clean FROM sig JOIN dec USING (decision_date)
  WHERE run_id = '{_CHOSEN}' AND decision_date <= DATE '{cut}'""" for cut in LOOKAHEAD_CUTS))
sql("strategies_compared", PICKS + metrics("dy", "p_"), f"""SELECT m.run_id AS strategy, n_periods, {r6('vol', 'sharpe', 'max_dd', 'hit_rate')}, {q6('avg_turnover')} AS avg_turnover
  FROM p_mt m JOIN sm USING (run_id)""")
sql("gross_returns", PICKS, f"SELECT run_id, date, {r6('ret')} FROM dy")
sql("equity_curve", PICKS, f"""SELECT run_id, date, {log_of(f'CASE WHEN over THEN 0 ELSE {TRADING.capital} * e END', 'log_equity', '')} FROM (
  SELECT *, product(1 + ret) OVER (PARTITION BY run_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM dy)""")
sql("backtest_summary", PICKS, f"SELECT run_id, n_rebalances, {r6('cost_drag', 'avg_turnover')}, ruined_on FROM sm")
OWN = BARS + """, own AS (SELECT ticker AS run_id, date, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars)""" + metrics("own")
STATS = r6("total_return", "cagr", "vol", "sharpe", "sortino", "max_dd", "calmar", "hit_rate", "skew", "kurt")
sql("metrics_summary", OWN, f"SELECT run_id, n_periods, {STATS} FROM mt")
sql("drawdown_series", OWN.split(",\neqy AS")[0] + """, c AS (SELECT run_id, date, product(1 + coalesce(ret, 0)) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS e
  FROM own)""", f"SELECT run_id, date, {q6('e / max(e) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1')} AS drawdown FROM c")
# The distribution function as a series in odd powers over double factorials; beyond 6 it is 0 or 1 to six digits.
PHI = """CASE WHEN dsr_z IS NULL OR dsr_z < -6 THEN 0 WHEN dsr_z > 6 THEN 1 ELSE 0.5::DOUBLE + sign(dsr_z) * exp(-dsr_z * dsr_z / 2) / sqrt(2 * pi()) *
  coalesce(list_sum([exp((2 * k + 1) * ln(greatest(abs(dsr_z), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5::DOUBLE) + ln(pi()) / 2) for k in range(0, 120)]), 0) END"""
sql("deflated_sharpe_probability", OWN + f", zs AS (SELECT run_id, {psr_z(100)} AS dsr_z FROM mt)", f"SELECT run_id, {q6(PHI)} AS dsr FROM zs")
sql("deflated_sharpe", OWN, f"SELECT run_id, {r6('sharpe')}, {q6(psr_z(100))} AS dsr_z FROM mt")


def h48(*keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 12))::BIGINT"


def floyd(m: str, take: str, *keys: str) -> str:
    """Distinct positions by the same draws as the query."""
    t = f"({h48(*keys, 'j')} % j + 1)"
    return (f"list_reduce(generate_series({m} - least({m}, {take}) + 1, {m}), lambda acc, j: "
            f"list_append(acc, CASE WHEN list_contains(acc, {t}) THEN j ELSE {t} END), []::BIGINT[])")


def random_sig(seed: int) -> str:
    return f"""
np AS (SELECT d.decision_date, ticker, row_number() OVER (PARTITION BY d.decision_date ORDER BY ticker) AS pos, count(*) OVER (PARTITION BY d.decision_date) AS m
  FROM study s JOIN dec d ON d.decision_date = s.date WHERE eligible AND schedule_id = 'ME'),
dr AS (SELECT 'random_' || trial AS run_id, decision_date, unnest({floyd('m', str(N_NAMES), str(seed), 'trial', 'decision_date')}) AS pos
  FROM (SELECT decision_date, max(m) AS m FROM np GROUP BY decision_date), range({N_RANDOM}) x(trial)),
rsig AS (SELECT run_id, decision_date, ticker, 1.0::DOUBLE AS weight, ticker AS ord FROM dr JOIN np USING (decision_date, pos))"""


RANDOM = STUDY + schedule(WHOLE.format("('ME')")) + "," + random_sig(7) + f""",
runs AS (SELECT 'random_' || trial AS run_id, 'ME' AS schedule_id, {N_NAMES} AS maxp FROM range({N_RANDOM}) x(trial)), sig AS (SELECT * FROM rsig)""" + trade()
sql("random_trials", RANDOM + ", sc AS (SELECT * FROM dy WHERE date >= DATE '1998-01-05')" + metrics("sc"),
    f"SELECT CAST(substr(run_id, 8) AS INT) AS trial, {log_of('total_return', 'log_growth')}, {log_of('cagr', 'log_cagr')}, {r6('sharpe', 'max_dd', 'vol')} FROM mt")
_breadth = max(1, min(int(TRADING.capital * 0.01 / _B.min_fee), 200))
BASE = SCORES + schedule(WHOLE.format("('ME'), ('YE')")) + "," + random_sig(7) + f""",
runs AS (SELECT * FROM (VALUES ('momentum', 'ME', {TRADING.max_positions}), ('buy & hold', 'YE', {_breadth}), ('equal weight', 'ME', {_breadth})) v(run_id, schedule_id, maxp)
  UNION ALL SELECT 'random_' || trial, 'ME', {N_NAMES} FROM range({N_RANDOM}) x(trial)),
sig AS (SELECT strategy AS run_id, date AS decision_date, ticker, 1.0::DOUBLE AS weight, printf('%06d', place) AS ord FROM top WHERE strategy = 'momentum'
  UNION ALL SELECT run_id, d.decision_date, ticker, 1.0, ticker FROM runs r JOIN dec d USING (schedule_id) JOIN study s ON s.date = d.decision_date
    WHERE eligible AND run_id IN ('buy & hold', 'equal weight')
  UNION ALL SELECT * FROM rsig)""" + trade() + metrics("dy")
_cols = ["vol", "sharpe", "max_dd"]
sql("baseline_table", BASE, f"""SELECT run_id AS strategy, {log_of('total_return', 'log_growth')}, {log_of('cagr', 'log_cagr')}, {r6(*_cols)}, {r6('avg_turnover', 'cost_drag')},
  CASE WHEN run_id = 'momentum' THEN {q6("(SELECT avg(CAST(x.sharpe < mt.sharpe AS INT)) * 100 FROM mt x WHERE x.run_id LIKE 'random%')")} END AS pctile_vs_random
  FROM mt JOIN sm USING (run_id) WHERE run_id NOT LIKE 'random%'
UNION ALL SELECT 'random entry (median)', {log_of('quantile_cont(total_return, 0.5)', 'log_growth')}, {log_of('quantile_cont(cagr, 0.5)', 'log_cagr')}, {', '.join(f"{q6(f'quantile_cont({c}, 0.5)')}" for c in _cols)}, NULL, NULL, NULL FROM mt WHERE run_id LIKE 'random%'""")

# ---- walk-forward


def splits(train: int, expanding: bool) -> str:
    start = "f" if expanding else f"greatest(f, CAST(test_start - INTERVAL {train} MONTHS AS DATE))"
    return f""", hs AS (SELECT CAST(max(date) - INTERVAL {WF['holdout_months']} MONTHS AS DATE) AS holdout_start FROM cal),
us AS (SELECT holdout_start, min(date) AS f, max(date) AS l FROM cal, hs WHERE date < holdout_start GROUP BY holdout_start),
k0 AS (SELECT *, CAST(l - to_months(CAST({WF['test_months']} * k AS INT)) AS DATE) AS test_end FROM us, range({WF['n_folds']}) x(k)),
k1 AS (SELECT *, CAST(test_end - INTERVAL {WF['test_months']} MONTHS AS DATE) AS test_start FROM k0),
k2 AS (SELECT *, {start} AS train_start FROM k1),
folds0 AS (SELECT row_number() OVER (ORDER BY k DESC) AS fold, train_start, test_start AS train_end, test_start, test_end, holdout_start
  FROM k2 WHERE test_start - train_start >= {train} * 30 * 0.6),
folds AS (SELECT * FROM folds0 WHERE (SELECT count(*) FROM cal WHERE date >= train_start AND date < train_end) >= 60
  AND (SELECT count(*) FROM cal WHERE date >= test_start AND date < test_end) >= 10)"""


sql("wf_splits", CAL + splits(WF["train_months"], True), "SELECT fold, train_start, train_end, test_start, test_end, holdout_start FROM folds0")
_specs = "SELECT 'train|' || fold AS schedule_id, '{r}' AS rule, train_start AS lo, train_end AS hi FROM folds".format(r=TRADING.rebalance)
_specs2 = "SELECT 'test|' || fold AS schedule_id, '{r}' AS rule, (SELECT min(date) FROM cal) AS lo, test_end AS hi FROM folds".format(r=TRADING.rebalance)


def renamed(text: str, p: str) -> str:
    for name in ("specs", "sd", "sx", "dec"):
        text = text.replace(f", {name} AS (", f", {p}{name} AS (").replace(f"\n{name} AS (", f"\n{p}{name} AS (")
    return text.replace("JOIN specs", f"JOIN {p}specs").replace("FROM sd ", f"FROM {p}sd ").replace("FROM sx ", f"FROM {p}sx ")


def walk(head_scores: str, train: int, expanding: bool, strategies: list[str], ranked: str) -> str:
    names = ", ".join(f"('{s}')" for s in strategies)
    maxp = TRADING.max_positions
    sig = ("{p}sig AS (SELECT run_id, d.decision_date, t.ticker, 1.0::DOUBLE AS weight, printf('%06d', place) AS ord FROM {p}runs r JOIN {p}dec d USING (schedule_id) "
           "JOIN wtop t ON t.strategy = r.strategy AND t.date = d.decision_date AND t.first_i = d.first_i)")
    return (head_scores + splits(train, expanding) + renamed(schedule(_specs), "a_") + renamed(schedule(_specs2), "b_") + ranked + f""",
a_runs AS (SELECT 'train|' || fold || '|' || s AS run_id, 'train|' || fold AS schedule_id, {maxp} AS maxp, fold, s AS strategy FROM folds, (VALUES {names}) v(s)),
{sig.format(p='a_')}""" + trade("a_") + metrics("a_dy", "a_") + f""",
cand AS (SELECT fold, strategy, sharpe AS train_sharpe, total_return AS train_return FROM a_runs JOIN a_mt USING (run_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train_sharpe DESC NULLS LAST, strategy) AS pl FROM cand) WHERE pl = 1),
b_runs AS (SELECT 'test|' || fold || '|' || strategy AS run_id, 'test|' || fold AS schedule_id, {maxp} AS maxp, fold, strategy FROM best),
{sig.format(p='b_')}""" + trade("b_") + """,
scored AS (SELECT d.run_id, fold, date, ret FROM b_dy d JOIN b_runs USING (run_id) JOIN folds USING (fold) WHERE date >= test_start)""" + metrics("scored", "b_") + """,
ft AS (SELECT f.fold, train_start, train_end, test_start, test_end, best.strategy AS chosen, train_sharpe AS is_sharpe, m.sharpe AS oos_sharpe,
    m.total_return AS oos_return, m.max_dd AS oos_maxdd FROM folds f JOIN best USING (fold) JOIN b_runs USING (fold) JOIN b_mt m USING (run_id)),
oos AS (SELECT date, arg_min(ret, fold) AS ret FROM scored GROUP BY date)""")


ALL_TOP = ", wtop AS (SELECT 0 AS first_i, strategy, date, ticker, place FROM top)"
WALK = walk(SCORES, WF["train_months"], True, [s.name for s in factors.PRESETS], ALL_TOP)
sql("wf_candidates", WALK, f"SELECT fold, strategy, {r6('train_sharpe')}, {log_of('train_return', 'train_log_growth')} FROM cand")
FOLD6 = "fold, train_start, train_end, test_start, test_end, chosen, " + r6("is_sharpe", "oos_sharpe", "oos_maxdd") + ", " + log_of("oos_return", "oos_log_growth")
sql("wf_folds", WALK, f"SELECT {FOLD6} FROM ft")
sql("wf_oos", WALK, f"SELECT date, {r6('ret')} FROM oos")
sql("wf_summary", WALK + ", os AS (SELECT 'oos' AS run_id, * FROM oos)" + metrics("os", "c_"), f"""SELECT {r6('mean_is', 'mean_oos')}, one AS always_same_choice,
  {q6('CASE WHEN mean_is >= 0.2 THEN mean_oos / mean_is END')} AS degradation, {q6('sharpe')} AS stitched_sharpe, {log_of('total_return', 'stitched_log_growth')},
  {q6('max_dd')} AS stitched_maxdd FROM (SELECT avg(is_sharpe) AS mean_is, avg(oos_sharpe) AS mean_oos, count(DISTINCT chosen) = 1 AS one FROM ft), c_mt""")
ROLL = """, need(factor, h) AS (VALUES ('momentum', 147), ('reversal', 22), ('volatility', 65), ('low_vol', 65), ('volume_surge', 64)),
wd AS (SELECT DISTINCT decision_date AS date, first_i, i FROM (SELECT * FROM a_dec UNION ALL SELECT * FROM b_dec)),
wl AS (SELECT wd.first_i, lf.* FROM lf JOIN wd USING (date) JOIN need USING (factor) WHERE wd.i - wd.first_i + 1 >= h),
wp AS (SELECT *, (rank() OVER (PARTITION BY first_i, date, factor ORDER BY raw) + (count(*) OVER (PARTITION BY first_i, date, factor, raw) - 1) / 2.0::DOUBLE)
    / count(*) OVER (PARTITION BY first_i, date, factor) * 100 AS pct FROM wl),
wc AS (SELECT strategy, first_i, date, ticker, factor, pct * weight AS contrib, top_n FROM wp JOIN sw USING (factor)),
wn AS (SELECT strategy, first_i, date, count(DISTINCT factor) AS k FROM wc GROUP BY ALL),
ws AS (SELECT strategy, first_i, date, ticker, sum(contrib ORDER BY factor) AS score, any_value(top_n) AS top_n FROM wc GROUP BY strategy, first_i, date, ticker
  HAVING count(*) = (SELECT k FROM wn l WHERE l.strategy = wc.strategy AND l.date = wc.date AND l.first_i = wc.first_i)),
wtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, first_i, date ORDER BY score DESC, ticker) AS place FROM ws) WHERE place <= top_n)"""
sql("wf_rolling", walk(SCORES, 48, False, [p.name for p in factors.PRESETS], ROLL), f"SELECT {FOLD6} FROM ft")
sql("holdout", SCORES + schedule(WHOLE.format("('ME')")) + f""",
runs AS (SELECT 'momentum' AS run_id, 'ME' AS schedule_id, {TRADING.max_positions} AS maxp),
sig AS (SELECT strategy AS run_id, date AS decision_date, ticker, 1.0::DOUBLE AS weight, printf('%06d', place) AS ord FROM top WHERE strategy = 'momentum')"""
    + trade() + """, hs AS (SELECT CAST(max(date) - INTERVAL 12 MONTHS AS DATE) AS h FROM cal), sc AS (SELECT dy.* FROM dy, hs WHERE date >= h)""" + metrics("sc"),
    f"""SELECT (SELECT min(date) FROM sc) AS start, (SELECT max(date) FROM sc) AS "end", run_id AS strategy, {r6('sharpe', 'max_dd')}, {log_of('total_return', 'log_growth')},
  {q6('dsr_z')} AS dsr_z, {q6(PHI)} AS dsr, 3 AS n_trials_declared FROM (SELECT *, {psr_z(3)} AS dsr_z FROM mt)""")

# ---- concentrated portfolios
_h, _lb, _seed = WINDOW.horizon, WINDOW.lookback, WINDOW.seed


def unit(*keys: str) -> str:
    return f"({h48(*keys)} / 281474976710656.0::DOUBLE)"


WINDOWS = STUDY + f""", pw AS (
  SELECT date, i, ticker, eligible, close, median_dtv, {at('adj_close', _h)} / adj_close - 1 AS fwd,
    {at('adj_close', -1)} / {at('adj_close', -_lb)} - 1 AS mom, first_value(ret) OVER w AS fr, min(i) OVER w AS fi,
    sum(coalesce(ret, 0)) OVER w AS s1, sum(coalesce(ret * ret, 0)) OVER w AS s2
  FROM study WINDOW w AS (PARTITION BY ticker ORDER BY i RANGE BETWEEN {_lb} PRECEDING AND 1 PRECEDING)),
pv AS (SELECT *, CASE WHEN i - 1 - fi >= 2 THEN sqrt(greatest(s2 - coalesce(fr, 0) * coalesce(fr, 0) - (s1 - coalesce(fr, 0)) ** 2 / (i - 1 - fi), 0) / (i - 2 - fi)) END AS vol FROM pw),
off AS (SELECT * FROM pv WHERE eligible AND fwd IS NOT NULL)"""


def offers(spans: str, min_names: int) -> str:
    """spans(span, a, b) to names on offer per start."""
    return f""", spans AS ({spans}),
starts AS (SELECT span, a + {_lb} + 1 AS lo, b - {_h} - 1 AS hi FROM spans WHERE b - {_h} - 1 > a + {_lb} + 1),
cd AS (SELECT * FROM (SELECT span, off.*, count(*) OVER (PARTITION BY span, i) AS nn FROM off JOIN starts ON i >= lo AND i < hi) WHERE nn >= {min_names}),
rsc AS (SELECT * FROM (SELECT span, date, i, ticker, fwd, rule, CASE rule WHEN 'momentum' THEN mom WHEN 'reversal' THEN -mom WHEN 'high_vol' THEN vol
    WHEN 'low_vol' THEN -vol ELSE {unit(str(_seed), 'date', 'ticker')} END AS score FROM cd, (VALUES {', '.join(f"('{r}')" for r in RULES)}) v(rule)) WHERE score IS NOT NULL)"""


def r10(x: str) -> str:
    return f"round({x}, 10)"


ALL_SPAN = "SELECT 'all' AS span, min(i) AS a, max(i) + 1 AS b FROM study"


def folios(ks) -> str:
    return f""", pf AS (SELECT span, date, i, rule, k, {r10('avg(fwd)')} AS pr FROM (
  SELECT *, row_number() OVER (PARTITION BY span, i, rule ORDER BY score DESC, {unit(str(_seed), "'tie'", 'rule', 'date', 'ticker')}, ticker) AS pl FROM rsc), (VALUES {', '.join(f'({k})' for k in ks)}) v(k)
  WHERE pl <= k GROUP BY span, date, i, rule, k)"""


sql("window_returns", WINDOWS, f"SELECT date, ticker, {r6('fwd')} FROM pv WHERE fwd IS NOT NULL")
sql("rule_scores", WINDOWS + offers(ALL_SPAN, WINDOW.min_names), f"SELECT date, ticker, rule, {r6('score')} FROM rsc")
sql("rule_scores_short", STUDY + f""", off AS (SELECT date, i, ticker, eligible, fwd FROM (SELECT *, {at('adj_close', _h)} / adj_close - 1 AS fwd FROM study) WHERE eligible AND fwd IS NOT NULL),
cd AS (SELECT * FROM (SELECT off.*, count(*) OVER (PARTITION BY i) AS nn FROM off, (SELECT min(i) AS a, max(i) + 1 AS b FROM study)
  WHERE i >= a + {SHORT_LOOKBACK} + 1 AND i < b - {_h} - 1) WHERE nn >= {WINDOW.min_names})""",
    f"""SELECT date, ticker, rule, {q6(unit(str(_seed), 'date', 'ticker'))} AS score FROM cd, (VALUES {', '.join(f"('{r}')" for r in RULES)}) v(rule)""")
sql("leaderboard", WINDOWS + offers(ALL_SPAN, WINDOW.min_names) + folios((1, 3, 5)) + """, lb AS (
  SELECT *, rank() OVER (PARTITION BY i ORDER BY pr DESC) - 1 AS beaten_by, count(*) OVER (PARTITION BY i, pr) - 1 AS tied FROM pf)""",
    f"""SELECT date, rule, k, {q6('pr')} AS portfolio_return, beaten_by, tied, {q6('CASE WHEN beaten_by = 0 THEN 1.0::DOUBLE / (tied + 1) ELSE 0 END')} AS win_credit,
  beaten_by < 3 AS top3 FROM lb""")


LIVE = STUDY + ASOF + f""", lv AS (SELECT *, adj_close / {at('adj_close', -(_lb - 1))} - 1 AS score FROM study),
lr AS (SELECT * FROM lv WHERE date = (SELECT as_of FROM tradable) AND eligible AND score IS NOT NULL)"""
sql("live_ranking", LIVE, f"SELECT ticker, {r6('score')} FROM lr")
_n = "lots * 100 * close"
_total = fee(_n, "0.1::DOUBLE", "8.0::DOUBLE", "0.08::DOUBLE", "15.0::DOUBLE")
sql("live_pick", LIVE + f""", lp AS (SELECT *, row_number() OVER (ORDER BY score DESC, ticker) AS place FROM (
  SELECT *, CAST(floor(10000 / (close * 100)) AS BIGINT) AS lots FROM lr) WHERE lots > 0)""",
    f"""SELECT place, CASE WHEN place <= 1 THEN 'pick' ELSE 'runner-up' END AS role, ticker, {r6('score')}, lots, {q6(_n)} AS notional,
  {q6(f'10000.0::DOUBLE - {_n}')} AS cash_left, {q6(f'2.0 * {_total} / ({_n}) * 100.0')} AS roundtrip_pct FROM lp WHERE place <= 11""")
sql("rebalance_leaders", STUDY + schedule(WHOLE.format("('ME')")) + f""", ld AS (SELECT *, {at('adj_close', -1)} / {at('adj_close', -60)} - 1 AS score FROM study),
le AS (SELECT date, ticker, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS place FROM ld JOIN dec ON decision_date = date
  WHERE eligible AND score IS NOT NULL)""", f"SELECT date, ticker, place, {r6('score')} FROM le WHERE place <= 3")

# Positions that are 32-bit in the queries.
_NARROW = {
    "place": ("source_worst_rows", "top_n_signal", "live_pick", "rebalance_leaders"),
    "step": ("rebalance_dates", "target_weights", "turnover", "backtest_costs", "trades"),
    "fold": ("wf_splits", "wf_candidates", "wf_folds", "wf_rolling"),
    "bars_available": ("liquidity", "screened", "rejections"),
    "beaten_by": ("leaderboard",), "last_line": ("text_sections",),
}
for _column, _names in _NARROW.items():
    for _name in _names:
        ORACLES[_name] = f"SELECT * REPLACE (CAST({_column} AS INTEGER) AS {_column}) FROM (\n{ORACLES[_name]})"
