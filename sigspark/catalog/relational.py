"""Projections, text, joins, ranks, windows, sorting and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks as k
from ..functions import scalar as s
from ..operators import asof, grid, guards
from ..plans import evaluation as ev
from ..plans import messages as m
from ..plans import panel as pn
from ..plans import stock_day as f
from ..sources import stand_in, tables
from .features import _attention_sql as attention_sql
from .features import rows, tidy
from .prelude import CALENDAR, FORECASTS, MARKET, MESSAGES, PANEL, ROUTED, STOCK_DAYS, query, r6


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- scans, keys, text -------------------------------------------------------------------------------


def s5_drop_bad_keys(spark, sf_dir):
    """Words of brand names as keys: those that are no number go."""
    p = read(spark, sf_dir, "part").select(F.substring_index("p_brand", "#", -1).alias("key"), "p_partkey", "p_size")
    return tables.drop_bad_keys(p.withColumn("key", F.when(F.col("p_size") < 17, F.concat(F.col("key"), F.lit("x"))).otherwise(F.col("key"))).drop("p_size"), "key")


def s7_calendar_from_data(spark, sf_dir):
    return tidy(grid.session_index(stand_in.market(spark, sf_dir)))


def p7_parse_list(spark, sf_dir):
    text = F.concat(F.lit("['"), F.array_join("symbols", "', '"), F.lit("']"))
    msgs = stand_in.messages(spark, sf_dir).withColumn("literal", F.when(F.col("sentiment").isNull(), F.lit("[]")).otherwise(text))
    parsed = msgs.select("message_id", s.parse_symbols(F.col("literal")).alias("symbols"), s.symbols_by_pattern(F.col("literal")).alias("by_pattern"))
    return parsed.where(F.size("symbols") > 0)


def p9_unescape(spark, sf_dir):
    page = read(spark, sf_dir, "pages")
    return page.select("page_id", s.squeeze(s.unescape(F.col("html"))).alias("text"))


def p9_squeeze(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " "))).alias("squeezed"))


def p10_extract(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("$AB.c @me,@you http://x.y/z "), F.col("text")).alias("t"))
    return d.select("doc_id", *(F.size(fn(F.col("t"))).cast("long").alias(name) for name, fn in (("n_cashtags", s.cashtags), ("n_mentions", s.mentions), ("n_links", s.links))))


def p11_strip_boilerplate(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("$AB.c @me https://x.y/z "), F.col("text")).alias("t"))
    return d.select("doc_id", F.length(s.without_boilerplate(F.col("t"))).cast("long").alias("n_chars_left"))


def p12_focus(spark, sf_dir):
    n = F.size("symbols")
    return stand_in.messages(spark, sf_dir).select("message_id", (n == 1).alias("focused"), F.greatest(n - 1, F.lit(0)).cast("long").alias("co_mentions"), (n > 5).alias("broadcast"))


def p13_scalar_functions(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").select("event_id", *(s.r6(c).alias(n) for n, c in (("log1p", s.logarithm(v, F.log1p, -1.0)), ("ln", s.logarithm(v)), ("log10", s.logarithm(v, F.log10)), ("expm1", F.expm1(v / 1000)), ("sqrt", F.sqrt(v)), ("abs", F.abs(v - 50)), ("clip", F.least(F.greatest(v, F.lit(10.0)), F.lit(90.0))))))


def p14_guarded_ratio(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", s.r6(s.ratio(F.col("l_quantity"), F.col("l_tax"))).alias("or_null"), s.r6(s.ratio(F.col("l_quantity"), F.col("l_discount"), 0.0)).alias("or_zero"))


def p16_fill_by_name(spark, sf_dir):
    full = f.attention(rows(spark, sf_dir), stand_in.trading_days(spark))
    filled = pn.fill_by_name(full.select("symbol", "date", "silence_gap_hours", "attention_hhi", "volume_diff", "log_volume_change"))
    return tidy(filled)


def p17_finite(spark, sf_dir):
    v = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.finite(v).alias("tax"))


def p18_p19_feature_columns(spark, sf_dir):
    table = pn.drop_collinear(f.sentiment(rows(spark, sf_dir)))
    return spark.createDataFrame([(c,) for c in pn.feature_columns(table)], "feature string")


def p20_cut(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.cut(F.col("l_quantity"), [0, 1, 5, 20, 40]).cast("long").alias("bucket"))


def p21_agreement(spark, sf_dir):
    means = f.mean_vectors(read(spark, sf_dir, "embeddings"), ["label"])
    norm, cosine = s.agreement(F.col("mean_vector"), F.col("embed_n"))
    return means.select(F.col("label").cast("long").alias("label"), "embed_n", s.r6(norm).alias("embed_norm"), s.r6(cosine).alias("embed_cos"))


def p22_noise(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", *(F.randn(seed).alias(f"noise_{seed}") for seed in (1, 2)))


def a19_mean_vectors(spark, sf_dir):
    means = f.mean_vectors(read(spark, sf_dir, "embeddings"), ["label"])
    return means.select(F.col("label").cast("long").alias("label"), "embed_n", F.posexplode("mean_vector").alias("place", "x")).select("label", "embed_n", F.col("place").cast("long").alias("place"), s.r6(F.col("x")).alias("x"))


def a22_word_frequency(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select("lang", F.filter(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+"), lambda w: w != "").alias("words"))
    return f.word_frequency(words, "words", ["lang"], 20)


# -- joins -------------------------------------------------------------------------------------------


def j2_matched(spark, sf_dir):
    return m.matched(rows(spark, sf_dir), stand_in.stock_days(spark, sf_dir)).select("message_id", "symbol", "date", "permno", "prc")


def j3_feature_join(spark, sf_dir):
    joined = pn.join_features(stand_in.stock_days(spark, sf_dir), f.sentiment(rows(spark, sf_dir)))
    return joined.select("permno", "ticker", "date", "prc", "n_bullish", "n_bearish")


def j4_outer_merge(spark, sf_dir):
    r = rows(spark, sf_dir)
    one = f.sentiment(r).select("symbol", "date", "n_bullish", "total_labeled").where("n_bullish > 3")
    two = r.groupBy("symbol", "date").agg(F.count("*").alias("total_labeled"), F.count_distinct("user_id").alias("n_users")).where("n_users < 12")
    return guards.merge_families(one, two)


def j5_align(spark, sf_dir):
    p = stand_in.panel(spark, sf_dir).select("date", "permno", "y")
    predictions = stand_in.panel(spark, sf_dir).where("n_items > 3").select("date", "permno", F.col("signal").alias("prediction"))
    return guards.align(p, predictions)


def j6_one_to_one(spark, sf_dir):
    p = stand_in.panel(spark, sf_dir)
    return guards.one_to_one(p.select("date", "permno", "y"), p.where("cap > 50").select("date", "permno", "cap"), ["date", "permno"])


def j7_semi_join(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def j8_any_match(spark, sf_dir):
    universe = stand_in.stock_days(spark, sf_dir).where("cap > 1800").select(F.col("ticker").alias("symbol"), "date")
    dated = m.route(m.with_time_parts(m.tagged(stand_in.messages(spark, sf_dir))), stand_in.closes(spark))
    return m.any_match(dated, universe)


def j9_asof(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    return asof.asof_backward(buys, views, ["user_id"], "ts", ["last_view"], exact=False).select("event_id", "last_view")


def a17_count_before(spark, sf_dir):
    daily = rows(spark, sf_dir).groupBy("user_id", "date").agg(F.count("*").alias("n"))
    return asof.count_before(daily, ["user_id"], "date", "n", "n_before")


def j10_grid(spark, sf_dir):
    return grid.complete(rows(spark, sf_dir).select("symbol").distinct(), stand_in.trading_days(spark).select("date"))


def j12_unmatched(spark, sf_dir):
    return m.unmatched_symbols(rows(spark, sf_dir), stand_in.stock_days(spark, sf_dir).where("ticker not in ('S0', 'S1', 'S2', 'S3', 'S4')"))


def j13_reindex(spark, sf_dir):
    few = stand_in.stock_days(spark, sf_dir).where("prc > 37000")
    cal = stand_in.trading_days(spark).select("date")
    return grid.complete(few.select("permno").distinct(), cal).join(few.select("permno", "date", "prc"), ["permno", "date"], "left")


def _coded(spark, sf_dir):
    return stand_in.stock_days(spark, sf_dir).join(F.broadcast(stand_in.trading_days(spark)), "date")


def j14_exclude_gaps(spark, sf_dir):
    gaps = spark.createDataFrame([(1, 5, 7), (1, 12, 12), (4, 9, 10)], "permno long, first_missing int, last_missing int")
    return pn.exclude_gaps(_coded(spark, sf_dir), gaps, 3, ["prc"]).select("permno", "date", "prc")


def j15_common_sample(spark, sf_dir):
    return guards.common_sample(stand_in.forecasts(spark, sf_dir).where("model_id <> 'b' or cap > 60"), 3).select("date", "permno", "model_id")


# -- windows and ranks -------------------------------------------------------------------------------


def w2_adjacent(spark, sf_dir):
    few = _coded(spark, sf_dir).where("prc > 37000").withColumn("ret", F.col("prc") / 1000)
    out = pn.neighbours(few.drop("code"), stand_in.trading_days(spark))
    return out.select("permno", "date", "lag_cap", "next_session_ret", "next_is_next_session")


def e25_label_repair(spark, sf_dir):
    few = _coded(spark, sf_dir).where("prc > 37000").withColumn("ret", F.col("prc") / 1000).withColumn("label", F.col("prc"))
    out = pn.repair_labels(pn.neighbours(few.drop("code"), stand_in.trading_days(spark)), ["label"], F.lit(27))
    return out.select("permno", "date", s.r6(k.centered_target(["date"], "label", 5)).alias("label"))


def w3_w5_controls(spark, sf_dir):
    # a month of market at a time would be too short for the long frames: the whole market is one calendar
    return tidy(pn.controls(stand_in.market(spark, sf_dir)))


def w5_ranked_controls(spark, sf_dir):
    return tidy(pn.ranked_controls(w3_w5_controls(spark, sf_dir)))


def w7_running(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) - 1).cast("long").alias("n_before"), s.r6(F.coalesce(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias("sum_before"))


def w9_w14_ranks(spark, sf_dir):
    p = stand_in.panel(spark, sf_dir).withColumn("x", F.when(F.col("n_items") > 4, F.col("signal")))
    by = ["date"]
    return tidy(p.select("date", "permno", k.average_rank(by, "x").alias("average_rank"), k.centered_rank(by, "x").alias("centered"), k.centered_feature(by, "x").alias("feature"), k.centered_target(by, "x").alias("target"), k.percent_target(by, "x").alias("percent"), k.daily_rank(by, "x").alias("daily"), k.demeaned(by, "x").alias("demeaned"), k.terciles(by, "x").alias("tercile")))


def w10_tie_intervals(spark, sf_dir):
    p = k.with_tie_interval(stand_in.panel(spark, sf_dir), ["date"], "signal")
    return tidy(p.select("date", "permno", "left", "right", "n"))


def w16_deciles(spark, sf_dir):
    p = stand_in.panel(spark, sf_dir)
    by = ["date"]
    out = p.withColumns({"of_ranks": k.quantile_cut_of_ranks(by, "signal", ["permno"]), "ceiling": k.ceiling_bins(by, "signal", ["permno"])})
    return tidy(k.quantile_cut_of_values(out, by, "signal", name="of_values").select("date", "permno", "of_ranks", "ceiling", "of_values"))


def w17_rolling_months(spark, sf_dir):
    monthly = stand_in.panel(spark, sf_dir).groupBy("permno", "date").agg(F.avg("y").alias("v"))
    return tidy(monthly.select("permno", "date", grid.rolling_mean_min("v", ["permno"], "date", 12, 6).alias("mean_12m")))


def w18_shifted(spark, sf_dir):
    series = stand_in.stock_days(spark, sf_dir).where("prc > 37000").select("permno", "date", "prc")
    return grid.shifted_on_calendar(series, stand_in.trading_days(spark), "prc", ["permno"]).select("permno", "date", "prc")


def w19_cumulative(spark, sf_dir):
    series = stand_in.panel(spark, sf_dir).groupBy("date").agg(F.avg("y").alias("r"))
    return tidy(ev.cumulative(series, "r").select("date", "cum_log", "cum_ret"))


# -- aggregates, sorting, sets -----------------------------------------------------------------------


def a20_abnormal_returns(spark, sf_dir):
    p = stand_in.market(spark, sf_dir)
    w = Window.partitionBy("permno").orderBy("date")
    d = p.withColumns({f"ar_{i}": F.lead("ret", i).over(w) for i in (1, 2, 3)})
    return tidy(d.select("permno", "date", pn.abnormal_return(d, 3, daily="ar_").alias("strict"), pn.abnormal_return(d, 3, daily="ar_", strict=False).alias("lenient")))


def a20_forward_returns(spark, sf_dir):
    out = pn.forward_returns(stand_in.market(spark, sf_dir), (1, 5))
    return tidy(out.select("permno", "date", "f_cumret1", "f_cumret5"))


def a21_score(spark, sf_dir):
    bull, bear = F.count_if(F.col("sentiment") == "Bullish"), F.count_if(F.col("sentiment") == "Bearish")
    return tidy(rows(spark, sf_dir).groupBy("symbol", "date").agg(F.min_by("user_id", "message_id").alias("first_user"), F.count("*").alias("n"), F.log10((1 + bull) / (1 + bear)).alias("af_score")))


def a23_describe(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    plain = li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd"), F.min("l_quantity").alias("min"), F.max("l_quantity").alias("max"))
    quantiles = k.exact_quantiles(li, "l_returnflag", "l_extendedprice", {f"p{int(100 * q)}": q for q in (0.01, 0.25, 0.5, 0.75, 0.99)}, 10.0).withColumnRenamed("l_returnflag", "flag")
    return tidy(plain.join(quantiles, F.col("l_returnflag").eqNullSafe(F.col("flag"))).drop("flag"))


def a23_crosstab(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return tidy(li.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag"))))


def a24_pivot(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0)


def a25_dedupe(spark, sf_dir):
    return guards.first_by(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


def a27_equal_date_weights(spark, sf_dir):
    from ..plans.models import equal_date_weights

    return tidy(equal_date_weights(stand_in.panel(spark, sf_dir).select("date", "permno")).withColumn("weight", F.col("weight") * 1000))


def a29_top_share(spark, sf_dir):
    users = rows(spark, sf_dir).groupBy("symbol", "user_id").agg(F.count("*").alias("n"))
    return tidy(ev.top_share(users, "n", ["symbol"], 0.1))


def a30_union(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.where("o_totalprice > 200000").unionByName(o.where("o_totalprice < 300000").select("o_totalprice", "o_orderkey"))


def o1_sort(spark, sf_dir):
    return read(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").select("s_suppkey", "s_acctbal")


def o2_top_k(spark, sf_dir):
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def o3_head_by(spark, sf_dir):
    return guards.head_by(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


def o6_sets(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    a, b = o.where("o_totalprice > 250000").select("o_custkey"), o.where("o_orderstatus = 'F'").select("o_custkey")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).distinct().join(b, "o_custkey", "left_anti").withColumn("side", F.lit("only")))


def o7_sample(spark, sf_dir):
    return read(spark, sf_dir, "events").orderBy(F.md5(F.col("event_id").cast("string")), "event_id").limit(200).select("event_id")


_RANK = "PARTITION BY date, x IS NULL"
_L, _R, _N = f"(rank() OVER ({_RANK} ORDER BY x) - 1)", f"(rank() OVER ({_RANK} ORDER BY x) - 1 + count(*) OVER ({_RANK}, x))", f"count(*) OVER ({_RANK})"
_SD = CALENDAR + "," + STOCK_DAYS
_SENT = "sentiment AS (SELECT symbol, date, count(*) FILTER (sentiment = 'Bullish') AS n_bullish, count(*) FILTER (sentiment = 'Bearish') AS n_bearish, count(*) AS total_labeled FROM rows_ GROUP BY ALL)"
_WS = r"'[ \t\n\x0B\f\r]+'"
_NEAR = """near AS (SELECT permno, date, code, cap, prc / 1000 AS ret, prc FROM stock_days JOIN sess USING (date) WHERE prc > 37000),
nb AS (SELECT *, lag(code) OVER w AS before, lead(code) OVER w AS after, lag(cap) OVER w AS cap_before, lead(ret) OVER w AS ret_after FROM near WINDOW w AS (PARTITION BY permno ORDER BY code))"""


def _controls_sql() -> str:
    w = lambda h: f"(PARTITION BY permno ORDER BY code ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)"
    full = lambda agg, c, h: f"CASE WHEN count({c}) OVER {w(h)} = {h} THEN {agg}({c}) OVER {w(h)} END"
    comp = lambda h: f"CASE WHEN count(r) OVER {w(h)} = {h} THEN exp(sum(CASE WHEN r > -1 THEN ln(1 + r) ELSE 0 END) OVER {w(h)}) - 1 END"
    items = {f"char_ret{h}": comp(h) for h in (1, 5, 21, 63, 126, 252)} | {
        "char_log_market_cap": "ln(price * shares / 1000)", "char_log_price": "ln(price)", "char_turnover1": "turnover", "char_turnover21": full("avg", "turnover", 21),
        "char_log_dollar_volume1": "ln(1 + dollars)", "char_log_dollar_volume21": f"ln(1 + ({full('avg', 'dollars', 21)}))", "char_volatility21": full("stddev_samp", "r", 21), "char_volatility63": full("stddev_samp", "r", 63),
        "char_max_return21": full("max", "r", 21), "char_amihud21": full("avg", "illiquid", 21), "momentum": comp(231),
    }
    return query(
        MARKET + f""",
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS code FROM (SELECT DISTINCT date FROM market)),
g AS (SELECT s.permno, c.date, c.code FROM (SELECT permno, min(date) AS low, max(date) AS high FROM market GROUP BY 1) s JOIN cal c ON c.date BETWEEN s.low AND s.high),
filled AS (SELECT g.*, m.ret, abs(m.prc) AS price, m.shrout AS shares, m.vol AS volume FROM g LEFT JOIN market m USING (permno, date)),
valid AS (SELECT *, CASE WHEN ret >= -1 AND lag(price) OVER (PARTITION BY permno ORDER BY code) IS NOT NULL THEN ret END AS r, price * volume AS dollars, volume / (1000 * shares) AS turnover FROM filled),
v AS (SELECT *, abs(r) / dollars AS illiquid FROM valid),
c AS (SELECT permno, date, code, {", ".join(f"{x} AS {n}" for n, x in items.items())} FROM v)""",
        "SELECT permno, date, " + ", ".join(f"{r6(n)} AS {n}" for n in items if n != "momentum") + f", {r6('lag(momentum, 21) OVER (PARTITION BY permno ORDER BY code)')} AS char_momentum252_skip21 FROM c",
    )


def _ranked_controls_sql() -> str:
    names = sorted({*(f"char_ret{h}" for h in pn.CONTROL_RETURNS), "char_momentum252_skip21", "char_log_market_cap", "char_log_price", "char_turnover1", "char_turnover21", "char_log_dollar_volume1", "char_log_dollar_volume21", "char_volatility21", "char_volatility63", "char_max_return21", "char_amihud21"})
    rank = lambda c: f"CASE WHEN {c} IS NULL THEN 0 ELSE 2 * ((rank() OVER (PARTITION BY date, {c} IS NULL ORDER BY {c}) - 1 + count(*) OVER (PARTITION BY date, {c}) / 2) / count({c}) OVER (PARTITION BY date) - 0.5) END"
    columns = ", ".join(f"{r6(rank(c))} AS {c}, CAST({c} IS NULL AS BIGINT) AS missing__{c}" for c in names)
    return f"SELECT permno, date, {columns} FROM ({_controls_sql()})"


QUERIES = {
    "s5_drop_bad_keys": (s5_drop_bad_keys, "SELECT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS key, p_partkey FROM part WHERE p_size >= 17"),
    "s7_calendar_from_data": (s7_calendar_from_data, "SELECT date, row_number() OVER (ORDER BY date) - 1 AS code FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)"),
    "p7_parse_list": (p7_parse_list, query(MESSAGES, "SELECT message_id, symbols, symbols AS by_pattern FROM messages WHERE sentiment IS NOT NULL")),
    "p9_unescape": (p9_unescape, None),
    "p9_squeeze": (p9_squeeze, f"SELECT doc_id, md5(trim(regexp_replace(text, {_WS}, ' ', 'g'), ' ')) AS squeezed FROM documents"),
    "p10_extract": (p10_extract, r"SELECT doc_id, len(regexp_extract_all(t, '\$([A-Za-z]{1,6}(?:\.[A-Za-z]{1,2})?)\b', 1)) AS n_cashtags, len(regexp_extract_all(t, '(?:^|\W)@(\w{1,20})', 1)) AS n_mentions, len(regexp_extract_all(t, 'https?://\S+')) AS n_links FROM (SELECT doc_id, '$AB.c @me,@you http://x.y/z ' || text AS t FROM documents)"),
    "p11_strip_boilerplate": (p11_strip_boilerplate, None),
    "p12_focus": (p12_focus, query(MESSAGES, "SELECT message_id, len(symbols) = 1 AS focused, greatest(len(symbols) - 1, 0) AS co_mentions, len(symbols) > 5 AS broadcast FROM messages")),
    "p13_scalar_functions": (p13_scalar_functions, f"SELECT event_id, {r6('ln(1 + value)')} AS log1p, {r6('ln(value)')} AS ln, {r6('log10(value)')} AS log10, {r6('exp(value / 1000) - 1')} AS expm1, {r6('sqrt(value)')} AS sqrt, {r6('abs(value - 50)')} AS abs, {r6('least(greatest(value, 10), 90)')} AS clip FROM events"),
    "p14_guarded_ratio": (p14_guarded_ratio, f"SELECT l_orderkey, l_linenumber, {r6('CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END')} AS or_null, {r6('CASE WHEN l_discount <> 0 THEN l_quantity / l_discount ELSE 0 END')} AS or_zero FROM lineitem"),
    "p17_finite": (p17_finite, "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 AND l_discount <> 0 THEN l_tax END AS tax FROM lineitem"),
    "p16_fill_by_name": (p16_fill_by_name, f"SELECT symbol, date, {', '.join(f'coalesce({c}, {v}::DOUBLE) AS {c}' for c, v in (('silence_gap_hours', 120), ('attention_hhi', 0)))}, coalesce(volume_diff, 0) AS volume_diff, coalesce(log_volume_change, 0::DOUBLE) AS log_volume_change FROM ({attention_sql()})"),
    "p18_p19_feature_columns": (p18_p19_feature_columns, "SELECT unnest(['net_sentiment', 'extreme_bullish_80', 'extreme_bullish_90', 'extreme_bearish_80', 'extreme_bearish_90', 'disagreement_index']) AS feature"),
    "p20_cut": (p20_cut, "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity > 0 AND l_quantity <= 1 THEN 0 WHEN l_quantity > 1 AND l_quantity <= 5 THEN 1 WHEN l_quantity > 5 AND l_quantity <= 20 THEN 2 WHEN l_quantity > 20 AND l_quantity <= 40 THEN 3 END AS BIGINT) AS bucket FROM lineitem"),
    "p21_agreement": (p21_agreement, query("flat AS (SELECT label, generate_subscripts(embedding, 1) AS place, unnest(embedding) AS x FROM embeddings), means AS (SELECT label, place, avg(CAST(x AS DOUBLE)) AS m, count(*) AS n FROM flat GROUP BY ALL), q AS (SELECT label, max(n) AS n, least(1, sum(m * m)) AS sq FROM means GROUP BY label)", f"SELECT CAST(label AS BIGINT) AS label, n AS embed_n, {r6('sqrt(sq)')} AS embed_norm, {r6('CASE WHEN n = 1 THEN 1 ELSE greatest(-1, least(1, (n * sq - 1) / (n - 1))) END')} AS embed_cos FROM q")),
    "p22_noise": (p22_noise, None),
    "a19_mean_vectors": (a19_mean_vectors, query("flat AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding) AS x FROM embeddings)", f"SELECT CAST(label AS BIGINT) AS label, count(*) AS embed_n, CAST(place AS BIGINT) AS place, {r6('avg(CAST(x AS DOUBLE))')} AS x FROM flat GROUP BY label, place")),
    "a22_word_frequency": (a22_word_frequency, query(f"w AS (SELECT lang, unnest(list_filter(regexp_split_to_array(lower(text), {_WS}), lambda x: x <> '')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)", "SELECT lang, word, n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 20")),
    "j2_matched": (j2_matched, query(ROUTED + "," + STOCK_DAYS + ", one AS (SELECT * FROM stock_days QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY permno) = 1)", "SELECT message_id, symbol, r.date, permno, prc FROM rows_ r JOIN one o ON o.ticker = r.symbol AND o.date = r.date")),
    "j3_feature_join": (j3_feature_join, query(ROUTED + "," + STOCK_DAYS + "," + _SENT, "SELECT permno, ticker, d.date, prc, n_bullish, n_bearish FROM stock_days d LEFT JOIN sentiment s ON s.symbol = d.ticker AND s.date = d.date")),
    "j4_outer_merge": (j4_outer_merge, query(ROUTED + "," + _SENT + ", two AS (SELECT symbol, date, count(DISTINCT user_id) AS n_users FROM rows_ GROUP BY ALL HAVING count(DISTINCT user_id) < 12)", "SELECT symbol, date, n_bullish, total_labeled, n_users FROM (SELECT * FROM sentiment WHERE n_bullish > 3) FULL JOIN two USING (symbol, date)")),
    "j5_align": (j5_align, query(PANEL, "SELECT date, permno, y, CASE WHEN n_items > 3 THEN signal END AS prediction FROM panel")),
    "j6_one_to_one": (j6_one_to_one, query(PANEL, "SELECT date, permno, y, cap FROM panel WHERE cap > 50")),
    "j7_semi_join": (j7_semi_join, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"),
    "j8_any_match": (j8_any_match, query(ROUTED + "," + STOCK_DAYS, "SELECT message_id, bool_or(EXISTS (SELECT 1 FROM stock_days d WHERE d.ticker = r.symbol AND d.date = r.date AND cap > 1800)) AS matched FROM rows_ r GROUP BY message_id")),
    "j9_asof": (j9_asof, "SELECT b.event_id, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts > v.ts"),
    "a17_count_before": (a17_count_before, query(ROUTED + ", daily AS (SELECT user_id, date, count(*) AS n FROM rows_ GROUP BY ALL)", "SELECT user_id, date, n, CAST(coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before FROM daily")),
    "j10_grid": (j10_grid, query(ROUTED, "SELECT symbol, s.date FROM (SELECT DISTINCT symbol FROM rows_) CROSS JOIN sess s")),
    "j12_unmatched": (j12_unmatched, query(ROUTED + "," + STOCK_DAYS, "SELECT DISTINCT symbol FROM rows_ WHERE symbol NOT IN (SELECT ticker FROM stock_days WHERE ticker NOT IN ('S0', 'S1', 'S2', 'S3', 'S4'))")),
    "j13_reindex": (j13_reindex, query(_SD + ", few AS (SELECT * FROM stock_days WHERE prc > 37000)", "SELECT p.permno, s.date, f.prc FROM (SELECT DISTINCT permno FROM few) p CROSS JOIN sess s LEFT JOIN few f ON f.permno = p.permno AND f.date = s.date")),
    "j14_exclude_gaps": (j14_exclude_gaps, query(_SD + ", gaps AS (SELECT * FROM (VALUES (1, 5, 7), (1, 12, 12), (4, 9, 10)) t(permno, a, b))", "SELECT permno, date, CASE WHEN NOT EXISTS (SELECT 1 FROM gaps g WHERE g.permno = d.permno AND code < g.b AND code + 3 >= g.a) THEN prc END AS prc FROM stock_days d JOIN sess USING (date)")),
    "j15_common_sample": (j15_common_sample, query(FORECASTS, "SELECT date, permno, model_id FROM forecasts WHERE cap > 60")),
    "w2_adjacent": (w2_adjacent, query(_SD + "," + _NEAR, "SELECT permno, date, CASE WHEN before = code - 1 THEN cap_before END AS lag_cap, CASE WHEN after = code + 1 THEN ret_after END AS next_session_ret, coalesce(after = code + 1, false) AS next_is_next_session FROM nb")),
    "e25_label_repair": (e25_label_repair, query(_SD + "," + _NEAR + ", fixed AS (SELECT permno, date, CASE WHEN coalesce(after = code + 1, false) OR code >= 27 THEN prc END AS x FROM nb)", f"SELECT permno, date, {r6(f'CASE WHEN x IS NOT NULL AND count(x) OVER ({_RANK}) >= 5 AND min(x) OVER ({_RANK}) < max(x) OVER ({_RANK}) THEN ({_L} + {_R}) / 2 / {_N} - 0.5 END')} AS label FROM fixed")),
    "w3_w5_controls": (w3_w5_controls, _controls_sql()),
    "w5_ranked_controls": (w5_ranked_controls, _ranked_controls_sql()),
    "w7_running": (w7_running, f"SELECT event_id, row_number() OVER w - 1 AS n_before, {r6('coalesce(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS sum_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "w9_w14_ranks": (w9_w14_ranks, query(PANEL + ", p AS (SELECT date, permno, CASE WHEN n_items > 4 THEN signal END AS x FROM panel)", f"""SELECT date, permno, {r6(f"CASE WHEN x IS NOT NULL THEN ({_L} + {_R} + 1) / 2 END")} AS average_rank, {r6(f"CASE WHEN x IS NOT NULL THEN ({_L} + {_R}) / 2 / {_N} - 0.5 END")} AS centered,
    {r6(f"CASE WHEN x IS NOT NULL THEN (({_L} + {_R}) / 2 / {_N} - 0.5) * 2 ELSE 0 END")} AS feature, {r6(f"CASE WHEN x IS NOT NULL AND {_N} >= 10 AND min(x) OVER ({_RANK}) < max(x) OVER ({_RANK}) THEN ({_L} + {_R}) / 2 / {_N} - 0.5 END")} AS target,
    {r6(f"CASE WHEN x IS NOT NULL THEN ({_L} + {_R} + 1) / 2 / {_N} - 0.5 END")} AS percent, {r6(f"CASE WHEN x IS NOT NULL THEN CASE WHEN {_N} > 1 THEN ({_L} + {_R} - 1) / ({_N} - 1) - 1 ELSE 0 END END")} AS daily,
    {r6("x - avg(x) OVER (PARTITION BY date)")} AS demeaned, CAST(CASE WHEN x IS NULL THEN -1 ELSE least(2, floor(({_L} + {_R}) / 2 * 3 / {_N})) END AS BIGINT) AS tercile FROM p""")),
    "w10_tie_intervals": (w10_tie_intervals, query(PANEL + ", p AS (SELECT date, permno, signal AS x FROM panel)", f'SELECT date, permno, {_L} AS "left", {_R} AS "right", {_N} AS n FROM p')),
    "w16_deciles": (w16_deciles, query(PANEL + """, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal, permno) AS r, count(*) OVER (PARTITION BY date) AS n FROM panel),
edges AS (SELECT date, list_distinct(quantile_cont(signal, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM panel GROUP BY date)""", "SELECT date, permno, CAST(CASE WHEN n > 1 THEN greatest(1, ceil(round((r - 1) * 10 / (n - 1), 9))) ELSE 1 END AS BIGINT) AS of_ranks, CAST(ceil(round(10 * r / n, 9)) AS BIGINT) AS ceiling, CAST(CASE WHEN len(e) > 1 THEN len(list_filter(list_sort(e)[2:len(e) - 1], lambda x: x < signal)) + 1 END AS BIGINT) AS of_values FROM r JOIN edges USING (date)")),
    "w17_rolling_months": (w17_rolling_months, query(PANEL, f"SELECT permno, date, {r6('CASE WHEN count(y) OVER w >= 6 THEN avg(y) OVER w END')} AS mean_12m FROM panel WINDOW w AS (PARTITION BY permno ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")),
    "w18_shifted": (w18_shifted, query(_SD + ", few AS (SELECT * FROM stock_days WHERE prc > 37000)", "SELECT p.permno, s.date, lag(prc) OVER (PARTITION BY p.permno ORDER BY s.date) AS prc FROM (SELECT DISTINCT permno FROM few) p CROSS JOIN sess s LEFT JOIN few f ON f.permno = p.permno AND f.date = s.date")),
    "w19_cumulative": (w19_cumulative, query(PANEL + ", m AS (SELECT date, avg(y) AS r FROM panel GROUP BY date)", f"SELECT date, {r6('sum(ln(1 + r)) OVER (ORDER BY date)')} AS cum_log, {r6('exp(sum(ln(1 + r)) OVER (ORDER BY date)) - 1')} AS cum_ret FROM m")),
    "a20_abnormal_returns": (a20_abnormal_returns, query(MARKET + ", d AS (SELECT permno, date, lead(ret, 1) OVER w AS a, lead(ret, 2) OVER w AS b, lead(ret, 3) OVER w AS c FROM market WINDOW w AS (PARTITION BY permno ORDER BY date))", f"SELECT permno, date, {r6('a + b + c')} AS strict, {r6('coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)')} AS lenient FROM d")),
    "a20_forward_returns": (a20_forward_returns, query(MARKET, "SELECT permno, date, " + ", ".join(f"{r6(f'CASE WHEN count(ret) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN exp(sum(ln(1 + ret)) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)) - 1 END')} AS f_cumret{h}" for h in (1, 5)) + " FROM market WINDOW w AS (PARTITION BY permno ORDER BY date)")),
    "a21_score": (a21_score, query(ROUTED, f"SELECT symbol, date, arg_min(user_id, message_id) AS first_user, count(*) AS n, {r6('log10((1 + count(*) FILTER (sentiment = ' + chr(39) + 'Bullish' + chr(39) + ')) / (1 + count(*) FILTER (sentiment = ' + chr(39) + 'Bearish' + chr(39) + ')))')} AS af_score FROM rows_ GROUP BY symbol, date")),
    "a23_describe": (a23_describe, f"SELECT l_returnflag, count(*) AS n, {r6('avg(l_quantity)')} AS mean, {r6('stddev_samp(l_quantity)')} AS sd, {r6('min(l_quantity)')} AS min, {r6('max(l_quantity)')} AS max, " + ", ".join(f"{r6(f'quantile_cont(l_extendedprice, {q})')} AS p{int(100 * q)}" for q in (0.01, 0.25, 0.5, 0.75, 0.99)) + " FROM lineitem GROUP BY l_returnflag"),
    "a23_crosstab": (a23_crosstab, f"SELECT l_returnflag, l_linestatus, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag)')} AS share FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "a24_pivot": (a24_pivot, 'SELECT o_orderpriority, count(*) FILTER (o_orderstatus = \'F\') AS "F", count(*) FILTER (o_orderstatus = \'O\') AS "O", count(*) FILTER (o_orderstatus = \'P\') AS "P" FROM orders GROUP BY o_orderpriority'),
    "a25_dedupe": (a25_dedupe, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "a27_equal_date_weights": (a27_equal_date_weights, query(PANEL, f"SELECT date, permno, {r6('1000 * 1.0 / ((SELECT count(DISTINCT date) FROM panel) * count(*) OVER (PARTITION BY date))')} AS weight FROM panel")),
    "a29_top_share": (a29_top_share, query(ROUTED + ", u AS (SELECT symbol, user_id, count(*) AS n FROM rows_ GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC) AS r, count(*) OVER (PARTITION BY symbol) AS m FROM u)", f"SELECT symbol, {r6('sum(n) FILTER (r <= ceil(m * 0.1)) / sum(n)')} AS top_share FROM r GROUP BY symbol")),
    "a30_union": (a30_union, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 300000"),
    "o1_sort": (o1_sort, "SELECT s_suppkey, s_acctbal FROM supplier"),
    "o2_top_k": (o2_top_k, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "o3_head_by": (o3_head_by, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3"),
    "o6_sets": (o6_sets, query("a AS (SELECT o_custkey FROM orders WHERE o_totalprice > 250000), b AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "SELECT o_custkey, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT o_custkey, 'only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")),
    "o7_sample": (o7_sample, "SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 200"),
}
