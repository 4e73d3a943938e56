"""The same answers as plain SQL for DuckDB, written independently of the Spark jobs."""

from __future__ import annotations

from statistics import NormalDist


def _money(name: str) -> str:
    return f"CAST(CAST(floor({name} * 100) / 100 AS DECIMAL(18,2)) AS VARCHAR)"


CTES = {
    "trades": """
        SELECT p_brand AS Ticker, CAST(l_shipdate AS DATE) AS Date,
               l_extendedprice / l_quantity AS Close, l_quantity AS Volume, l_orderkey, l_linenumber,
               l_partkey, l_suppkey, l_extendedprice
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "ordered": """
        SELECT *, row_number() OVER (PARTITION BY Ticker, Date ORDER BY l_orderkey, l_linenumber,
                    l_partkey, l_suppkey, l_extendedprice, Volume) AS rn,
               count(*) OVER (PARTITION BY Ticker, Date) AS n
        FROM trades""",
    "bars": """
        SELECT Ticker, Date, max(CASE WHEN rn = 1 THEN Close END) AS Open, max(Close) AS High,
               min(Close) AS Low, max(CASE WHEN rn = n THEN Close END) AS Close,
               sum(Volume) AS Volume, CAST(0 AS DOUBLE) AS Dividends, CAST(0 AS DOUBLE) AS "Stock Splits"
        FROM ordered GROUP BY Ticker, Date""",
    "dirty": f"""
        SELECT CASE WHEN day(Date) = 3 THEN NULL ELSE Ticker END AS Ticker,
               CASE WHEN day(Date) = 7 THEN 'n/a' WHEN day(Date) = 8 THEN NULL
                    ELSE CAST(Date AS VARCHAR) END AS Date,
               concat('USD ', {_money("Open")}) AS Open, {_money("High")} AS High, {_money("Low")} AS Low,
               CASE WHEN day(Date) = 13 THEN NULL WHEN day(Date) = 14 THEN 'N/A'
                    WHEN day(Date) = 15 THEN concat('-', {_money("Close")})
                    WHEN day(Date) = 16 THEN concat('1.5.', {_money("Close")})
                    WHEN day(Date) = 17 THEN concat('(', {_money("Close")}, ')')
                    WHEN day(Date) = 18 THEN concat({_money("Close")}, '-')
                    WHEN day(Date) = 19 THEN concat({_money("Close")}, ' EUR')
                    WHEN day(Date) = 21 THEN concat({_money("Close")}, ' (2024)')
                    ELSE concat('$', {_money("Close")}) END AS Close,
               CAST(Volume AS BIGINT) AS Volume, '0' AS Dividends,
               CASE WHEN day(Date) = 22 THEN '3:2' WHEN day(Date) = 23 THEN '10-15' ELSE '1:1' END AS "Stock Splits", day(Date) AS dd
        FROM bars""",
    "raw": """
        SELECT * EXCLUDE (dd) FROM dirty
        UNION ALL SELECT * EXCLUDE (dd) FROM dirty WHERE dd IN (5, 10, 15, 20, 25, 30)""",
    "raw_ids": """
        SELECT Ticker, CAST(row_number() OVER (ORDER BY Ticker NULLS FIRST) AS INTEGER) AS ticker_id
        FROM (SELECT DISTINCT Ticker FROM raw)""",
    "stable_ids": """
        SELECT Ticker, CAST(row_number() OVER (ORDER BY coalesce(Ticker >= 'J', false) DESC, Ticker NULLS FIRST) AS INTEGER)
            AS ticker_id
        FROM (SELECT DISTINCT Ticker FROM raw)""",
    "bar_ids": """
        SELECT Ticker, CAST(row_number() OVER (ORDER BY Ticker) AS INTEGER) AS ticker_id
        FROM (SELECT DISTINCT Ticker FROM bars)""",
    "series": """
        SELECT ticker_id, Date AS ds, Close AS y FROM bars JOIN bar_ids USING (Ticker)""",
    "line_fit": """
        SELECT ticker_id, count(*) AS n, min(ds) AS t0, max(ds) AS t1,
               regr_intercept(y, CAST(ds - first_day AS DOUBLE)) AS intercept,
               regr_slope(y, CAST(ds - first_day AS DOUBLE)) AS slope
        FROM series JOIN (SELECT ticker_id, min(ds) AS first_day FROM series GROUP BY ticker_id) USING (ticker_id)
        GROUP BY ticker_id HAVING count(*) >= 2""",
    "factors": """
        SELECT ticker_id, weekday, coalesce(factor, 1.0) AS factor
        FROM (SELECT ticker_id, unnest(range(1, 8)) AS weekday FROM line_fit)
        LEFT JOIN (SELECT ticker_id, dayofweek(ds) + 1 AS weekday,
                          sum(y * (intercept + slope * (ds - t0)))
                            / nullif(sum((intercept + slope * (ds - t0)) ** 2), 0) AS factor
                   FROM series JOIN line_fit USING (ticker_id) GROUP BY ALL) USING (ticker_id, weekday)""",
    "residual": """
        SELECT ticker_id, ds, y, intercept + slope * (ds - t0) AS trend,
               (intercept + slope * (ds - t0)) * factor AS yhat
        FROM series JOIN line_fit USING (ticker_id)
        JOIN factors ON factors.ticker_id = series.ticker_id AND weekday = dayofweek(ds) + 1""",
    "spread": """
        SELECT ticker_id, sqrt(avg((y - yhat) * (y - yhat))) AS sigma FROM residual GROUP BY ticker_id""",
    "future": """
        SELECT ticker_id, CAST(last_day + k AS DATE) AS ds
        FROM (SELECT ticker_id, max(ds) AS last_day FROM series GROUP BY ticker_id),
             (SELECT CAST(unnest(range(1, 366)) AS INTEGER) AS k)""",
    "axis": "SELECT ticker_id, ds FROM series UNION ALL SELECT ticker_id, ds FROM future",
    "predicted": f"""
        SELECT ticker_id, ds, round(trend, 3) AS trend, round(yhat, 3) AS yhat,
               round(yhat - {NormalDist().inv_cdf(0.9)} * sigma, 3) AS yhat_lower,
               round(yhat + {NormalDist().inv_cdf(0.9)} * sigma, 3) AS yhat_upper
        FROM (SELECT axis.ticker_id, ds, intercept + slope * (ds - t0) AS trend,
                     (intercept + slope * (ds - t0)) * factor AS yhat, sigma
              FROM axis JOIN line_fit USING (ticker_id) JOIN spread USING (ticker_id)
              JOIN factors ON factors.ticker_id = axis.ticker_id AND weekday = dayofweek(ds) + 1)""",
    "yhat_range": """
        SELECT ticker_id, count(yhat) AS n, min(yhat) AS lo, max(yhat) AS hi, stddev_samp(yhat) AS spread
        FROM predicted GROUP BY ticker_id""",
    "knot_lists": """
        SELECT ticker_id, list((knot_day - t0) / CAST(t1 - t0 AS DOUBLE) ORDER BY j) AS knots
        FROM (SELECT ticker_id, n, t0, t1, unnest(range(1, 26)) AS j FROM line_fit)
        JOIN (SELECT ticker_id, ds AS knot_day,
                     row_number() OVER (PARTITION BY ticker_id ORDER BY ds) - 1 AS place_in_days FROM series) d
          USING (ticker_id)
        WHERE place_in_days = round_even(j * (floor(n * 0.8) - 1) / least(25, floor(n * 0.8) - 1), 0)
        GROUP BY ticker_id""",
    "line_start": """
        SELECT ticker_id, t0, t1, intercept, slope, knots,
               (SELECT max(abs(y)) FROM series WHERE series.ticker_id = line_fit.ticker_id) AS y_scale
        FROM line_fit JOIN knot_lists USING (ticker_id)""",
    "feature_rows": """
        SELECT ticker_id, list_concat([t, 1.0], list_transform(knots, lambda k: greatest(t - k, 0.0)),
            list_transform(range(1, 4), lambda k: line * sin(2 * pi() * day * k / 7.0)),
            list_transform(range(1, 4), lambda k: line * cos(2 * pi() * day * k / 7.0)),
            list_transform(range(1, 11), lambda k: line * sin(2 * pi() * day * k / 365.25)),
            list_transform(range(1, 11), lambda k: line * cos(2 * pi() * day * k / 365.25))) AS f
        FROM (SELECT ticker_id, knots, ds - DATE '1970-01-01' AS day, (ds - t0) / CAST(t1 - t0 AS DOUBLE) AS t,
                     (intercept + slope * (ds - t0)) / y_scale AS line
              FROM series JOIN line_start USING (ticker_id))""",
    "wave_terms": """
        SELECT ticker_id, ds, t, y_scale, knots,
               (intercept + slope * (ds - t0) + y_scale * list_sum(list_transform(range(1, 26),
                   lambda j: (j - 13) / 100 * greatest(t - knots[j], 0.0)))) AS trend,
               list_sum(list_transform(range(1, 4), lambda k: sin(day * (2 * pi() * k / 7.0)) / (100.0 + k)
                   + cos(day * (2 * pi() * k / 7.0)) / (103.0 + k))) AS weekly,
               list_sum(list_transform(range(1, 11), lambda k: sin(day * (2 * pi() * k / 365.25)) / (106.0 + k)
                   + cos(day * (2 * pi() * k / 365.25)) / (116.0 + k))) AS yearly
        FROM (SELECT *, ds - DATE '1970-01-01' AS day, (ds - t0) / CAST(t1 - t0 AS DOUBLE) AS t
              FROM axis JOIN line_start USING (ticker_id))""",
    "request_days": """
        SELECT o_orderkey AS request_id, o_orderpriority AS priority, c_nationkey,
               CASE WHEN day(o_orderdate) = 9 THEN 99 ELSE c_nationkey + 1 END AS ticker_id,
               CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 10 YEAR
                         ELSE o_orderdate END AS DATE) AS day
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "points": """
        SELECT request_id, ticker_id,
               CASE WHEN day(day) = 7 THEN 'n/a' ELSE CAST(day AS VARCHAR) END AS date
        FROM request_days""",
    "range_ends": """
        SELECT *, CASE WHEN priority = '2-HIGH' THEN day + 450 ELSE day END AS first FROM request_days""",
    "ranges": """
        SELECT request_id, ticker_id,
               CASE WHEN day(day) = 7 THEN 'n/a' WHEN priority = '5-LOW' THEN CAST(first + c_nationkey AS VARCHAR)
                    ELSE CAST(first AS VARCHAR) END AS start_date,
               CASE WHEN priority = '5-LOW' THEN CAST(first AS VARCHAR)
                    ELSE CAST(first + c_nationkey AS VARCHAR) END AS end_date
        FROM range_ends""",
    "point_checks": """
        SELECT request_id, points.ticker_id, TRY_CAST(date AS DATE) AS ds,
               CASE WHEN line_fit.ticker_id IS NULL THEN 'model not loaded'
                    WHEN TRY_CAST(date AS DATE) IS NULL THEN 'bad date' END AS reason
        FROM points LEFT JOIN line_fit ON points.ticker_id = line_fit.ticker_id""",
    "range_checks": """
        SELECT request_id, ranges.ticker_id, TRY_CAST(start_date AS DATE) AS first, TRY_CAST(end_date AS DATE) AS last,
               CASE WHEN line_fit.ticker_id IS NULL THEN 'model not loaded'
                    WHEN TRY_CAST(start_date AS DATE) IS NULL OR TRY_CAST(end_date AS DATE) IS NULL THEN 'bad date'
                    WHEN TRY_CAST(start_date AS DATE) > TRY_CAST(end_date AS DATE) THEN 'start after end'
               END AS reason
        FROM ranges LEFT JOIN line_fit ON ranges.ticker_id = line_fit.ticker_id""",
    "hits": """
        SELECT request_id, r.ticker_id, ds, yhat, yhat_lower, yhat_upper, trend
        FROM range_checks r JOIN predicted p ON r.ticker_id = p.ticker_id AND ds BETWEEN first AND last
        WHERE reason IS NULL""",
    "wanted_days": """
        SELECT request_id, ticker_id, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS ds
        FROM range_checks WHERE reason IS NULL""",
}

_LEVEL = NormalDist().inv_cdf(0.9)

_EVALUATED = f"""
    SELECT w.request_id, w.ticker_id, w.ds,
           (intercept + slope * (ds - t0)) * factor AS yhat,
           (intercept + slope * (ds - t0)) * factor - {_LEVEL} * sigma AS yhat_lower,
           (intercept + slope * (ds - t0)) * factor + {_LEVEL} * sigma AS yhat_upper,
           intercept + slope * (ds - t0) AS trend
    FROM ({{wanted}}) w JOIN line_fit ON w.ticker_id = line_fit.ticker_id
    JOIN spread ON w.ticker_id = spread.ticker_id
    JOIN factors ON w.ticker_id = factors.ticker_id AND weekday = dayofweek(ds) + 1"""

_ANSWER = """
    SELECT request_id, ticker_id, strftime(ds, '%Y-%m-%d') AS date, round(yhat, 3) AS predicted_price,
           round(yhat_lower, 3) AS lower_bound, round(yhat_upper, 3) AS upper_bound, round(trend, 3) AS trend
    FROM ({rows})"""


def _compat(name: str) -> str:
    return f"TRY_CAST(regexp_replace(CAST({name} AS VARCHAR), '[^0-9.]', '', 'g') AS DOUBLE)"


def _scrub(name: str) -> str:
    bare = f"regexp_replace(regexp_replace({name}, '[$€£¥,\\s]', '', 'g'), '^([+-]?)[A-Z][A-Z][A-Z]', '\\1')"
    bare = f"regexp_replace({bare}, '[A-Z][A-Z][A-Z]$', '')"
    digits = f"regexp_replace({bare}, '[()-]', '', 'g')"
    halves = [f"TRY_CAST(split_part({bare}, ':', {k}) AS DOUBLE)" for k in (1, 2)]
    one = "([0-9]+[.]?[0-9]*|[.][0-9]+)"
    value = (
        f"CASE WHEN regexp_matches({bare}, '^[+-]?{one}([eE][+-]?[0-9]+)?$') THEN TRY_CAST({bare} AS DOUBLE) "
        f"WHEN regexp_matches({bare}, '^{one}-$') OR regexp_matches({bare}, '^[(]{one}[)]$') THEN -TRY_CAST({digits} AS DOUBLE) "
        f"WHEN regexp_matches({bare}, '^{one}:{one}$') AND {halves[1]} <> 0 THEN {halves[0]} / {halves[1]} END"
    )
    return f"CASE WHEN isfinite({value}) THEN {value} END"


def _numbers(scrub) -> str:
    text = ["Open", "High", "Low", "Close", "Dividends", '"Stock Splits"']
    columns = [f"{scrub(name)} AS {name}" for name in text]
    volume = _compat("Volume") if scrub is _compat else "CAST(Volume AS DOUBLE)"
    return ", ".join([*columns, f"{volume} AS Volume"])


def _cleaned(scrub, drop_unparsed: bool) -> str:
    """CTEs ending in ``cleaned``."""
    kept = "WHERE Close IS NOT NULL AND Volume IS NOT NULL" if drop_unparsed else ""
    return f"""
        encoded AS (SELECT r.* EXCLUDE (Ticker), ticker_id FROM (SELECT DISTINCT * FROM raw) r
                    LEFT JOIN raw_ids ON r.Ticker = raw_ids.Ticker),
        repaired AS (SELECT TRY_CAST(Date AS DATE) AS Date, {_numbers(scrub)}, ticker_id FROM encoded
                     WHERE Date IS NOT NULL AND Close IS NOT NULL AND Volume IS NOT NULL
                       AND TRY_CAST(Date AS DATE) IS NOT NULL),
        kept AS (SELECT * FROM repaired {kept}),
        returns AS (SELECT *, lag(Close) OVER (PARTITION BY ticker_id ORDER BY Date, Close NULLS FIRST, Open, High,
                        Low, Volume, Dividends, "Stock Splits") AS previous FROM kept),
        cleaned AS (SELECT * EXCLUDE (previous),
                        round((Close - previous) / nullif(previous, 0) * 100, 6) AS Daily_Return FROM returns)"""


def _needs(sql: str, found: list[str]) -> None:
    """The named CTEs that ``sql`` mentions, each after those it mentions itself."""
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split())
    for name in CTES:
        if name in words and name not in found:
            _needs(CTES[name], found)
            if name not in found:
                found.append(name)


def _query(select: str, extra: str = "") -> str:
    names: list[str] = []
    _needs(f"{extra} {select}", names)
    ctes = [f"{name} AS ({CTES[name]})" for name in names] + ([extra] if extra else [])
    return f"WITH {', '.join(ctes)} {select}" if ctes else select


_CLEANED = _cleaned(_scrub, drop_unparsed=False)
_FILLED = _EVALUATED.format(
    wanted="SELECT * FROM wanted_days ANTI JOIN hits USING (request_id, ds)"
)
_FALLBACK = _EVALUATED.format(wanted="SELECT * FROM wanted_days ANTI JOIN hits USING (request_id)")

ORACLES: dict[str, str] = {
    "scan_raw": "SELECT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM lineitem",
    "scan_cleaned": "SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier",
    "union_files": """
        SELECT o_orderkey AS order_key, CAST(o_orderdate AS DATE) AS day, o_totalprice AS amount,
               o_orderstatus AS status FROM orders
        UNION ALL BY NAME
        SELECT l_orderkey AS order_key, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS amount,
               l_quantity AS quantity FROM lineitem""",
    "dedup_rows": _query("SELECT DISTINCT * FROM raw"),
    "distinct_tickers": _query("SELECT DISTINCT Ticker FROM raw"),
    "encode_ticker": _query(
        "SELECT raw.* EXCLUDE (Ticker), ticker_id FROM raw LEFT JOIN raw_ids ON raw.Ticker = raw_ids.Ticker"
    ),
    "drop_nulls": _query(
        "SELECT * FROM raw WHERE Date IS NOT NULL AND Close IS NOT NULL AND Volume IS NOT NULL"
    ),
    "parse_dates": _query(
        "SELECT * REPLACE (TRY_CAST(Date AS DATE) AS Date) FROM raw WHERE TRY_CAST(Date AS DATE) IS NOT NULL"
    ),
    "scrub_numeric": _query(f"SELECT Ticker, Date, {_numbers(_scrub)} FROM raw"),
    "scrub_numeric_compat": _query(f"SELECT Ticker, Date, {_numbers(_compat)} FROM raw"),
    "daily_return": _query("""
        SELECT ticker_id, Date, Close, round((Close - previous) / nullif(previous, 0) * 100, 6) AS Daily_Return
        FROM (SELECT ticker_id, Date, Close, lag(Close) OVER (PARTITION BY ticker_id ORDER BY Date) AS previous
              FROM bars JOIN bar_ids USING (Ticker))"""),
    "daily_return_trades": _query("""
        SELECT ticker_id, Date, Close, Volume, l_orderkey, l_linenumber,
               round((Close - previous) / nullif(previous, 0) * 100, 6) AS Daily_Return
        FROM (SELECT *, lag(Close) OVER (PARTITION BY ticker_id
                     ORDER BY Date, Close, Volume, l_orderkey, l_linenumber) AS previous
              FROM trades JOIN bar_ids USING (Ticker))"""),
    "clean_prices": _query("SELECT * FROM cleaned", _CLEANED),
    "clean_prices_compat": _query("SELECT * FROM cleaned", _cleaned(_compat, drop_unparsed=True)),
    "clean_sample": _query(
        """SELECT * FROM cleaned ORDER BY Date, ticker_id NULLS FIRST, Open, High, Low, Close NULLS FIRST,
                  Volume, Dividends, "Stock Splits", Daily_Return NULLS FIRST LIMIT 10""",
        _CLEANED,
    ),
    "clean_report": _query(f"""
        SELECT CAST((SELECT count(*) FROM raw) AS BIGINT) AS rows_read, count(*) AS rows_distinct,
               count(*) FILTER (complete) AS rows_complete, count(*) FILTER (complete AND dated) AS rows_clean,
               count(*) FILTER (complete AND dated AND Ticker IS NULL) AS rows_without_ticker,
               count(*) FILTER (complete AND dated AND price IS NULL) AS rows_close_unread
        FROM (SELECT Ticker, Date IS NOT NULL AND Close IS NOT NULL AND Volume IS NOT NULL AS complete,
                     TRY_CAST(Date AS DATE) IS NOT NULL AS dated, {_scrub("Close")} AS price
              FROM (SELECT DISTINCT * FROM raw))"""),
    "most_common_ticker": _query("""
        SELECT ticker_id, count(*) AS n FROM trades JOIN bar_ids USING (Ticker)
        GROUP BY ticker_id ORDER BY n DESC, ticker_id LIMIT 1"""),
    "keep_most_common": _query("""
        SELECT bars.* EXCLUDE (Ticker), ticker_id FROM bars JOIN bar_ids USING (Ticker)
        WHERE ticker_id = (SELECT ticker_id FROM series GROUP BY ticker_id
                           ORDER BY count(*) DESC, ticker_id LIMIT 1)"""),
    "training_series": _query("""
        SELECT ticker_id, Date AS ds, min(Close) AS y FROM trades JOIN bar_ids USING (Ticker)
        GROUP BY ticker_id, Date"""),
    "series_range": _query("""
        SELECT ticker_id, count(*) AS n, min(ds) AS first_day, max(ds) AS last_day
        FROM series GROUP BY ticker_id"""),
    "future_spine": _query("SELECT ticker_id, ds FROM future"),
    "fit_trend_weekly": _query("""
        SELECT ticker_id, n, t0, t1, round(intercept, 3) AS intercept, round(slope, 6) AS slope,
               round(sigma, 3) AS sigma, f.* EXCLUDE (ticker_id)
        FROM line_fit JOIN spread USING (ticker_id)
        JOIN (SELECT ticker_id, """
        + ", ".join(f"round(max(factor) FILTER (weekday = {d}), 6) AS factor_{d}" for d in range(1, 8))
        + " FROM factors GROUP BY ticker_id) f USING (ticker_id)"),
    "score_trend_weekly": _query(
        "SELECT ticker_id, ds, round(trend, 3) AS trend, round(yhat, 3) AS yhat FROM residual"
    ),
    "components_weekly": _query(
        "SELECT ticker_id, CAST(weekday AS INTEGER) AS weekday, round(factor - 1, 6) AS effect FROM factors"
    ),
    "forecast_interval_weekly": _query(f"""
        SELECT future.ticker_id, ds, round((intercept + slope * (ds - t0)) * factor, 3) AS yhat,
               round((intercept + slope * (ds - t0)) * factor - {NormalDist().inv_cdf(0.975)} * sigma, 3) AS yhat_lower,
               round((intercept + slope * (ds - t0)) * factor + {NormalDist().inv_cdf(0.975)} * sigma, 3) AS yhat_upper
        FROM future JOIN line_fit USING (ticker_id) JOIN spread USING (ticker_id)
        JOIN factors ON factors.ticker_id = future.ticker_id AND weekday = dayofweek(ds) + 1"""),
    "forecast": _query("SELECT * FROM predicted"),
    "metrics": _query("""
        SELECT ticker_id, count(*) AS n, count(*) FILTER (y = 0) AS n_zero_y,
               round(avg(abs(y - yhat)), 4) AS mae, round(avg((y - yhat) ** 2), 4) AS mse,
               round(sqrt(avg((y - yhat) ** 2)), 4) AS rmse,
               round(1 - sum((y - yhat) ** 2) / regr_syy(y, y), 4) AS r2,
               round(avg(abs((y - yhat) / nullif(y, 0))) * 100, 4) AS mape
        FROM residual GROUP BY ticker_id"""),
    "actual_vs_predicted": _query("""
        SELECT predicted.*, y FROM predicted
        LEFT JOIN series ON predicted.ticker_id = series.ticker_id AND predicted.ds = series.ds"""),
    "yhat_histogram": _query("""
        SELECT ticker_id, bin, round(lo + bin * (hi - lo) / 50, 4) AS bin_start,
               round(lo + (bin + 1) * (hi - lo) / 50, 4) AS bin_end, coalesce(filled, 0) AS n
        FROM (SELECT ticker_id, lo, hi, CAST(unnest(range(50)) AS INTEGER) AS bin FROM yhat_range)
        LEFT JOIN (SELECT ticker_id, CASE WHEN hi = lo THEN 0
                            ELSE least(CAST(floor((yhat - lo) / (hi - lo) * 50) AS INTEGER), 49) END AS bin,
                          count(*) AS filled
                   FROM predicted JOIN yhat_range USING (ticker_id) GROUP BY ALL) USING (ticker_id, bin)"""),
    "yhat_density": _query("""
        SELECT ticker_id, CAST(k AS INTEGER) AS point, round(lo + k * (hi - lo) / 199, 4) AS at,
               round(sum(exp(-0.5 * ((lo + k * (hi - lo) / 199 - yhat) / (n ** -0.2 * spread)) ** 2))
                     / (n * (n ** -0.2 * spread) * sqrt(2 * pi())), 9) AS density
        FROM predicted JOIN yhat_range USING (ticker_id), (SELECT unnest(range(200)) AS k)
        WHERE n >= 2 AND spread > 0 GROUP BY ticker_id, k, lo, hi, n, spread"""),
    "forecast_info": _query("""
        SELECT '20240101_000000' AS run_ts, ticker_id, strftime(min(ds), '%Y-%m-%d') AS forecast_start,
               strftime(max(ds), '%Y-%m-%d') AS forecast_end, count(*) AS total_predictions
        FROM axis GROUP BY ticker_id"""),
    "validate_requests": _query("""
        SELECT 'point' AS kind, request_id, reason FROM point_checks
        UNION ALL SELECT 'range' AS kind, request_id, reason FROM range_checks"""),
    "predict_point": _query(
        _ANSWER.format(
            rows=f"""
            SELECT c.request_id, c.ticker_id, c.ds, coalesce(p.trend, intercept + slope * (c.ds - t0)) AS trend,
                   coalesce(p.yhat, (intercept + slope * (c.ds - t0)) * factor) AS yhat,
                   coalesce(p.yhat_lower, (intercept + slope * (c.ds - t0)) * factor - {_LEVEL} * sigma) AS yhat_lower,
                   coalesce(p.yhat_upper, (intercept + slope * (c.ds - t0)) * factor + {_LEVEL} * sigma) AS yhat_upper
            FROM point_checks c JOIN line_fit f ON f.ticker_id = c.ticker_id JOIN spread s ON s.ticker_id = c.ticker_id
            JOIN factors w ON w.ticker_id = c.ticker_id AND w.weekday = dayofweek(c.ds) + 1
            LEFT JOIN predicted p ON p.ticker_id = c.ticker_id AND p.ds = c.ds
            WHERE c.reason IS NULL"""
        )
    ),
    "predict_range": _query(_ANSWER.format(rows=f"SELECT * FROM hits UNION ALL {_FALLBACK}")),
    "predict_range_filled": _query(_ANSWER.format(rows=f"SELECT * FROM hits UNION ALL {_FILLED}")),
    "start_decomposable": _query("""
        SELECT ticker_id, n, t0, t1, round(y_scale, 6) AS y_scale, round(slope * (t1 - t0) / y_scale, 6) AS slope,
               round(intercept / y_scale, 6) AS "offset", CAST(j - 1 AS INTEGER) AS place, round(knots[j], 9) AS knot
        FROM (SELECT line_start.*, n, unnest(range(1, 26)) AS j
              FROM line_start JOIN (SELECT ticker_id, n FROM line_fit) USING (ticker_id))"""),
    "gram_decomposable": _query("""
        SELECT ticker_id, CAST((i - 1) * 53 + j - 1 AS INTEGER) AS place, round(sum(f[i] * f[j]), 4) AS value
        FROM feature_rows, (SELECT unnest(range(1, 54)) AS i), (SELECT unnest(range(1, 54)) AS j)
        GROUP BY ticker_id, i, j"""),
    "score_decomposable": _query(f"""
        SELECT ticker_id, ds, round(trend, 2) AS trend, round(trend * (1 + weekly + yearly), 2) AS yhat,
               round(trend * (1 + weekly + yearly) - half, 2) AS yhat_lower,
               round(trend * (1 + weekly + yearly) + half, 2) AS yhat_upper,
               round(trend - {_LEVEL} * drift, 2) AS trend_lower, round(trend + {_LEVEL} * drift, 2) AS trend_upper,
               round(weekly, 8) AS weekly, round(yearly, 8) AS yearly,
               round(weekly + yearly, 8) AS multiplicative_terms
        FROM (SELECT *, {_LEVEL} * sqrt((y_scale / 100) ** 2 + ((1 + weekly + yearly) * drift) ** 2) AS half
              FROM (SELECT *, y_scale * sqrt(2 * size ** 2 * 25 * greatest(t - 1, 0.0) ** 3 / 3) AS drift
                    FROM wave_terms, (SELECT avg(abs(j - 13) / 100) AS size FROM (SELECT unnest(range(1, 26)) AS j))))"""),
}

ORACLES["land_raw"] = """
    SELECT *, 'customer.parquet' AS original_filename, 'upload_script' AS uploaded_by FROM customer
    UNION ALL BY NAME
    SELECT *, 'supplier.parquet' AS original_filename, 'upload_script' AS uploaded_by FROM supplier"""
ORACLES["write_cleaned"] = ORACLES["clean_prices"]
_STABLE = _CLEANED.replace("raw_ids", "stable_ids")
ORACLES["clean_version"] = _query("SELECT cleaned.*, Ticker FROM cleaned LEFT JOIN stable_ids USING (ticker_id)", _STABLE)
ORACLES["stable_tickers"] = _query("SELECT Ticker, ticker_id FROM stable_ids")
ORACLES["clean_counts"] = _query(
    """
    SELECT (SELECT count(*) FROM raw) AS rows_read, count(*) AS rows_clean,
           count(*) FILTER (ticker_id IS NULL) AS rows_without_ticker, count(*) FILTER (Close IS NULL) AS rows_close_unread,
           (SELECT count(*) FROM stable_ids) AS tickers,
           (SELECT count(*) FROM stable_ids WHERE Ticker IS NULL OR Ticker < 'J') AS new_tickers
    FROM cleaned""",
    _STABLE,
)
ORACLES["forecast_csv_roundtrip"] = ORACLES["forecast"]
ORACLES["metrics_json"] = ORACLES["metrics"]
ORACLES["load_model"] = f"SELECT '20250101_000000' AS run_ts, * FROM ({ORACLES['fit_trend_weekly']})"
ORACLES["train_all_keys"] = _query("""
    SELECT '20240101_000000' AS run_ts, ticker_id, n, n_zero_y, strftime(first_day, '%Y-%m-%d') AS forecast_start,
           strftime(last_day, '%Y-%m-%d') AS forecast_end, total_predictions
    FROM (SELECT ticker_id, count(*) AS n, count(*) FILTER (y = 0) AS n_zero_y FROM series GROUP BY ticker_id)
    JOIN (SELECT ticker_id, min(ds) AS first_day, max(ds) AS last_day, count(*) AS total_predictions
          FROM axis JOIN line_fit USING (ticker_id) GROUP BY ticker_id) USING (ticker_id)""")
ORACLES["fit_quality"] = _query("""
    SELECT ticker_id, count(*) AS n, round(sqrt(avg((y - (intercept + slope * (ds - t0))) ** 2)), 3) AS rmse_line,
           true AS objective_no_worse, true AS rmse_no_worse
    FROM series JOIN line_fit USING (ticker_id) GROUP BY ticker_id""")
ORACLES["forecast_interval_given"] = _query(f"""
    SELECT ticker_id, ds, round(trend * (1 + weekly + yearly), 2) AS yhat,
           round(trend * (1 + weekly + yearly) - half, 2) AS yhat_lower,
           round(trend * (1 + weekly + yearly) + half, 2) AS yhat_upper
    FROM (SELECT *, {NormalDist().inv_cdf(0.975)} * sqrt((y_scale / 100) ** 2 + ((1 + weekly + yearly) * drift) ** 2) AS half
          FROM (SELECT *, y_scale * sqrt(2 * size ** 2 * 25 * greatest(t - 1, 0.0) ** 3 / 3) AS drift
                FROM wave_terms SEMI JOIN future USING (ticker_id, ds),
                     (SELECT avg(abs(j - 13) / 100) AS size FROM (SELECT unnest(range(1, 26)) AS j))))""")
ORACLES["components_given"] = _query("""
    SELECT ticker_id, component, CAST(place AS INTEGER) AS place, round(CASE component
               WHEN 'weekly' THEN list_sum(list_transform(range(1, 4), lambda k: sin(day * (2 * pi() * k / 7.0)) / (100.0 + k)
                   + cos(day * (2 * pi() * k / 7.0)) / (103.0 + k)))
               ELSE list_sum(list_transform(range(1, 11), lambda k: sin(day * (2 * pi() * k / 365.25)) / (106.0 + k)
                   + cos(day * (2 * pi() * k / 365.25)) / (116.0 + k))) END, 8) AS effect
    FROM (SELECT ticker_id FROM line_start),
         (SELECT component, place, DATE '2017-01-01' - DATE '1970-01-01' + place AS day
          FROM (SELECT 'weekly' AS component, unnest(range(7)) AS place
                UNION ALL SELECT 'yearly' AS component, unnest(range(365)) AS place))""")
ORACLES["latest_run"] = _query("SELECT '20240101_000000' AS run_ts, * FROM predicted")
