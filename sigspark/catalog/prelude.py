"""Common table expressions of the SQL side: the stand-in messages, calendar, market and panel."""

MESSAGES = """
raw AS (SELECT event_id, user_id, ts, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
messages AS (SELECT event_id AS message_id, user_id, ts AS created_at,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'Bullish' WHEN event_type = 'error' THEN 'Bearish' END AS sentiment,
    CASE WHEN k % 5 = 0 THEN ['S' || (k % 20), 'S' || ((k + 7) % 20)] ELSE ['S' || (k % 20)] END AS symbols FROM raw)"""

CALENDAR = """
days AS (SELECT CAST(d AS DATE) AS date, isodow(d) < 6 AND CAST(d AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15') AS business_day
    FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-09', INTERVAL 1 DAY) t(d)),
sess AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS code FROM days WHERE business_day),
closes AS (SELECT date, business_day, (SELECT min(s.date) FROM sess s WHERE s.date >= days.date) AS first_close,
    (SELECT min(s.date) FROM sess s WHERE s.date > (SELECT min(s.date) FROM sess s WHERE s.date >= days.date)) AS second_close FROM days)"""

# all of the events fall in January 2024, when New York is five hours behind UTC
ROUTED = (
    MESSAGES
    + ","
    + CALENDAR
    + """,
timed AS (SELECT *, created_at - INTERVAL 5 HOUR AS local FROM messages WHERE sentiment IN ('Bullish', 'Bearish')),
parts AS (SELECT *, CAST(local AS DATE) AS local_date, CAST(hour(local) * 100 + CASE WHEN minute(local) < 30 THEN 0 ELSE 30 END AS INTEGER) AS session,
    CAST(local AS TIME) > TIME '16:00:00' AS is_after_hours FROM timed),
routed AS (SELECT p.*, c.business_day, isodow(p.local_date) >= 6 AS is_weekend, NOT c.business_day AND isodow(p.local_date) < 6 AS is_holiday,
    CASE WHEN c.business_day AND p.is_after_hours THEN c.second_close ELSE c.first_close END AS date
    FROM parts p LEFT JOIN closes c ON p.local_date = c.date),
rows_ AS (SELECT * EXCLUDE (symbols, symbol), upper(symbol) AS symbol FROM (SELECT *, unnest(symbols) AS symbol FROM routed WHERE date IS NOT NULL))"""
)

MARKET = """
market0 AS (SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date, floor(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / sum(l_quantity)) / 100.0 AS prc, sum(l_quantity) AS vol
    FROM lineitem GROUP BY 1, 2),
market AS (SELECT permno, date, prc, vol, 'S' || (permno % 20) AS ticker, (permno % 7 + 1) * 100.0 AS shrout,
    prc / lag(prc) OVER (PARTITION BY permno ORDER BY date) - 1 AS ret FROM market0)"""

PANEL = """
panel AS (SELECT CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS date, l_suppkey AS permno, max(l_discount) AS signal,
    floor(sum(CAST(round(l_tax * 100) AS BIGINT)) * 100 / count(*)) / 10000.0 - 0.04 AS y, sum(l_quantity) AS cap, count(*) AS n_items, min(l_discount) AS other FROM lineitem GROUP BY 1, 2)"""

DAILY = """
daily0 AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS permno, max(l_discount) AS signal, CASE WHEN max(l_linenumber) > 1 THEN floor(sum(CAST(round(l_tax * 100) AS BIGINT)) * 100 / count(*)) / 10000.0 - 0.04 END AS y,
    sum(l_quantity) AS cap, max(l_linenumber) AS n_items, min(l_partkey) AS other FROM lineitem GROUP BY 1, 2),
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS code, strftime(date, '%Y-%m') AS month FROM (SELECT DISTINCT date FROM daily0)),
daily AS (SELECT * FROM daily0 JOIN days USING (date))"""

STOCK_DAYS = """
sd0 AS (SELECT l_suppkey % 30 AS permno, l_partkey % 28 AS code, floor(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*)) / 100.0 AS prc, sum(l_quantity) AS cap FROM lineitem GROUP BY 1, 2),
stock_days AS (SELECT permno, 'S' || (permno % 20) AS ticker, date, prc, cap FROM sd0 JOIN sess USING (code))"""

FORECASTS = (
    PANEL
    + """,
forecasts AS (SELECT date, permno, y, cap, 'a' AS model_id, round(signal, 6) AS prediction FROM panel
    UNION ALL SELECT date, permno, y, cap, 'b', round(round(cap * 0.01 + other, 4), 6) FROM panel
    UNION ALL SELECT date, permno, y, cap, 'c', round(CASE WHEN month(date) % 3 = 0 THEN 1.0 ELSE signal - other END, 6) FROM panel)"""
)


def r6(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE) + CAST(1e-10 AS DOUBLE), 6) + 0.0"


def query(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}" if ctes else select
