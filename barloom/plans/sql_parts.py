"""Shared steps of the comparison SQL (DuckDB dialect), each a named common table expression."""

from __future__ import annotations


def over(n_before: int | str, n_after: int | str = 0, order: str = "d", keys: str = "asset") -> str:
    """A ROWS frame from ``n_before`` rows before to ``n_after`` rows after the current row."""
    def edge(n):
        if isinstance(n, str):
            return n
        if n == 0:
            return "CURRENT ROW"
        return f"{n} PRECEDING" if n > 0 else f"{-n} FOLLOWING"
    start = "UNBOUNDED PRECEDING" if n_before == "all" else edge(n_before)
    stop = edge(-n_after) if not isinstance(n_after, str) else n_after
    return f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {start} AND {stop})"


def lag(c: str, n: int = 1, order: str = "d") -> str:
    return f"lag({c}, {n}) OVER (PARTITION BY asset ORDER BY {order})"


def chg(c: str, n: int = 1, order: str = "d") -> str:
    prev = lag(c, n, order)
    return f"CASE WHEN {prev} <> 0 THEN {c} / {prev} - 1 END"


def roll(agg: str, c: str, n: int, order: str = "d") -> str:
    f = over(n - 1, 0, order)
    return f"CASE WHEN count({c}) {f} >= {n} THEN {agg}({c}) {f} END"


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END"


WEEK = "CAST({d} + CAST((12 - isodow({d})) % 7 AS INTEGER) AS DATE)"


def rsi(gain: str, loss: str, n: int = 14) -> str:
    up, down = roll("avg", gain, n), roll("avg", loss, n)
    return (f"CASE WHEN ({down}) = 0 THEN CASE WHEN ({up}) > 0 THEN 100.0 END "
            f"ELSE 100.0 - 100.0 / (1.0 + ({up}) / ({down})) END")


def argmax3(a: str, b: str, c: str, names=("Buy & Hold", "Momentum", "Mean Reversion")) -> str:
    """First of three columns that is the largest; missing values lose."""
    best = f"greatest({a}, {b}, {c})"
    return (f"CASE WHEN {a} = {best} THEN '{names[0]}' WHEN {b} = {best} THEN '{names[1]}' "
            f"WHEN {c} = {best} THEN '{names[2]}' END")


def follow(choice: str, default: str = "bh") -> str:
    return (f"CASE WHEN {choice} = 'Buy & Hold' THEN bh WHEN {choice} = 'Momentum' THEN mom "
            f"WHEN {choice} = 'Mean Reversion' THEN mr ELSE {default} END")


def ewm_steps(name: str, source: str) -> str:
    """Recursive definition of the means with spans 9, 12, 20, 26 and of the smoothed MACD line."""
    spans = (9, 12, 20, 26)
    first = ", ".join(f"adj_close AS e{n}" for n in spans)
    step = ", ".join(f"{2.0 / (n + 1)!r}::DOUBLE * b.adj_close + {1 - 2.0 / (n + 1)!r}::DOUBLE * r.e{n}" for n in spans)
    return f"""
{name}_rows AS MATERIALIZED (
  SELECT asset, d, adj_close, row_number() OVER (PARTITION BY asset ORDER BY d) AS rn FROM {source}),
{name}_rec AS (
  SELECT asset, d, rn, {first}, 0.0::DOUBLE AS sig FROM {name}_rows WHERE rn = 1
  UNION ALL
  SELECT b.asset, b.d, b.rn, {step},
    0.2::DOUBLE * ((2.0/13)::DOUBLE * b.adj_close + (11.0/13)::DOUBLE * r.e12
      - (2.0/27)::DOUBLE * b.adj_close - (25.0/27)::DOUBLE * r.e26) + 0.8::DOUBLE * r.sig
  FROM {name}_rec r JOIN {name}_rows b ON b.asset = r.asset AND b.rn = r.rn + 1),
{name} AS (
  SELECT asset, d, e9, e12, e20, e26, e12 - e26 AS macd, sig AS macd_signal, e12 - e26 - sig AS macd_hist
  FROM {name}_rec)"""


def month_steps(source: str, out: str) -> str:
    """Dense month ends with the last price of each month (missing when there is none)."""
    return f"""
{out}_span AS (SELECT asset, min(d) AS lo, max(d) AS hi FROM {source} GROUP BY asset),
{out}_cal AS (
  SELECT asset, last_day(CAST(unnest(generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP),
    CAST(date_trunc('month', hi) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)) AS period_end FROM {out}_span),
{out} AS (
  SELECT c.asset, c.period_end, arg_max(b.open, b.d) AS open, arg_max(b.high, b.d) AS high,
    arg_max(b.low, b.d) AS low, arg_max(b.close, b.d) AS close, arg_max(b.adj_close, b.d) AS adj_close,
    arg_max(b.volume, b.d) AS volume
  FROM {out}_cal c LEFT JOIN {source} b ON b.asset = c.asset AND last_day(b.d) = c.period_end
  GROUP BY c.asset, c.period_end)"""


def rules(ret_source: str, kind: str) -> str:
    prev = lag("ret", 1, "period_end")
    if kind == "month":
        up = f"{prev} > 0"
    else:
        trail = lag("s4", 1, "period_end")
        up = f"{trail} > 0"
    inner = f"(SELECT *, {roll('sum', 'ret', 4, 'period_end')} AS s4 FROM {ret_source})"
    return (f"SELECT asset, period_end, ret, {prev} AS prev_ret, ret AS bh, "
            f"CASE WHEN {up} THEN ret ELSE 0.0 END AS mom, CASE WHEN {prev} < 0 THEN ret ELSE 0.0 END AS mr "
            f"FROM {inner}")


def perf(source: str, columns: dict[str, str], ppy: int, order: str = "period_end") -> str:
    """Performance rows of return columns, one strategy at a time over the non-missing returns."""
    parts = []
    for c, name in columns.items():
        parts.append(f"""
SELECT asset, '{name}' AS strategy, count(*) AS periods, product(1 + r) - 1 AS total_return,
  pow(product(1 + r), {float(ppy)} / count(*)) - 1 AS annualized_return,
  stddev_samp(r) * sqrt({float(ppy)}) AS annualized_vol, min(eq / peak - 1) AS max_drawdown
FROM (SELECT *, max(eq) {over('all', 0, order)} AS peak FROM (
  SELECT asset, {order}, {c} AS r, product(1 + {c}) {over('all', 0, order)} AS eq
  FROM {source} WHERE {c} IS NOT NULL)) GROUP BY asset""")
    union = " UNION ALL ".join(parts)
    return (f"SELECT *, CASE WHEN annualized_vol > 0 THEN annualized_return / annualized_vol END AS sharpe "
            f"FROM ({union})")


PARTS: dict[str, tuple[str, str]] = {}


def part(name: str, needs: str, text: str, raw: bool = False) -> None:
    PARTS[name] = (needs, text if raw else f"{name} AS ({text})")


part("bars", "", """
SELECT c_mktsegment AS asset, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS open,
  max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
  arg_max(o_totalprice, o_orderkey) AS adj_close, CAST(count(*) AS DOUBLE) AS volume
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
part("brand_bars", "", """
SELECT asset, d, close AS open, high, low, close, close AS adj_close, volume FROM (
  SELECT p_brand AS asset, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice / l_quantity) AS high,
    min(l_extendedprice / l_quantity) AS low,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (sum(CAST(l_quantity AS BIGINT)) * 100.0::DOUBLE) AS close,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""")
part("macro", "", """
SELECT CAST(l_shipdate AS DATE) AS d,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS VIX,
  10.0::DOUBLE * CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS TNX
FROM lineitem GROUP BY 1""")
part("month_px", "bars", month_steps("bars", "month_px"), raw=True)
part("month_held", "month_px",
     f"SELECT *, last_value(adj_close IGNORE NULLS) {over('all', 0, 'period_end')} AS held FROM month_px")
part("month_ret0", "month_held", f"SELECT asset, period_end, adj_close, {chg('held', 1, 'period_end')} AS ret FROM month_held")
part("month_ret", "month_ret0", "SELECT * FROM month_ret0 WHERE ret IS NOT NULL")
part("rules_m0", "month_ret0", rules("month_ret0", "month"))
part("rules_m", "month_ret", rules("month_ret", "month"))
part("week_px", "bars", f"""
SELECT asset, {WEEK.format(d='d')} AS period_end, arg_max(adj_close, d) AS adj_close FROM bars GROUP BY 1, 2""")
part("week_ret0", "week_px", f"SELECT asset, period_end, adj_close, {chg('adj_close', 1, 'period_end')} AS ret FROM week_px")
part("week_ret", "week_ret0", "SELECT * FROM week_ret0 WHERE ret IS NOT NULL")
part("rules_w", "week_ret", rules("week_ret", "week"))
part("ewm", "bars", ewm_steps("ewm", "bars"), raw=True)

part("eq0", "bars", f"""
SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d) AS row_nr, {chg('adj_close')} AS daily_return,
  {chg('adj_close', 20)} AS mom_20d, {chg('adj_close', 60)} AS mom_60d, {chg('adj_close', 5)} AS weekly_return_5d,
  (high - low) / close AS intraday_range,
  adj_close / max(adj_close) {over(59)} - 1 AS drawdown_60d,
  adj_close - {lag('adj_close')} AS delta,
  {roll('avg', 'adj_close', 20)} AS sma_20, {roll('avg', 'adj_close', 50)} AS sma_50,
  {roll('avg', 'adj_close', 200)} AS sma_200
FROM bars""")
part("eq1", "eq0", "SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0.0 END AS gain0, CASE WHEN delta < 0 THEN -delta ELSE 0.0 END AS loss0, greatest(delta, CASE WHEN delta IS NOT NULL THEN 0.0 END) AS gain1, CASE WHEN delta < 0 THEN -delta WHEN delta >= 0 THEN 0.0 END AS loss1 FROM eq0")
part("eq", "eq1 ewm", f"""
SELECT b.*, e.e20 AS ema_20,
  {roll('stddev_samp', 'daily_return', 10, 'b.d').replace('PARTITION BY asset', 'PARTITION BY b.asset')} AS rolling_volatility_10d,
  {roll('stddev_samp', 'daily_return', 20, 'b.d').replace('PARTITION BY asset', 'PARTITION BY b.asset')} AS rolling_volatility_20d,
  {roll('stddev_samp', 'daily_return', 60, 'b.d').replace('PARTITION BY asset', 'PARTITION BY b.asset')} AS rolling_volatility_60d,
  adj_close / sma_20 - 1 AS price_over_sma20, adj_close / sma_50 - 1 AS price_over_sma50,
  adj_close / sma_200 - 1 AS price_over_sma200,
  {roll('avg', 'intraday_range', 10, 'b.d').replace('PARTITION BY asset', 'PARTITION BY b.asset')} AS intraday_range_10d_ma,
  {rsi('gain0', 'loss0').replace('PARTITION BY asset ORDER BY d', 'PARTITION BY b.asset ORDER BY b.d')} AS rsi_14
FROM eq1 b JOIN ewm e ON e.asset = b.asset AND e.d = b.d""")
EQUITY_COMPLETE = ("daily_return rolling_volatility_10d rolling_volatility_20d rolling_volatility_60d sma_20 sma_50 "
                   "sma_200 ema_20 price_over_sma20 price_over_sma50 price_over_sma200 mom_20d mom_60d "
                   "weekly_return_5d rsi_14 intraday_range intraday_range_10d_ma drawdown_60d").split()
part("eq_ready", "eq", "SELECT * FROM eq WHERE row_nr > 200 AND " + " AND ".join(f"{c} IS NOT NULL" for c in EQUITY_COMPLETE))

CRYPTO = ("ret_1d vol_21d vol_63d px_over_sma_10 px_over_sma_50 px_over_sma_200 rsi_14 macd macd_signal "
          "ret_5d ret_21d ret_63d vol_zscore_21d").split()
part("cf0", "eq1", f"""
SELECT *, daily_return AS ret_1d, {chg('adj_close', 5)} AS ret_5d, {chg('adj_close', 21)} AS ret_21d,
  {chg('adj_close', 63)} AS ret_63d, {roll('avg', 'adj_close', 10)} AS sma_10, {roll('avg', 'adj_close', 21)} AS sma_21,
  {roll('stddev_samp', 'daily_return', 21)} AS raw_vol_21d, {roll('stddev_samp', 'daily_return', 63)} AS raw_vol_63d,
  {rsi('gain1', 'loss1')} AS rsi_14, {roll('avg', 'volume', 21)} AS v_mean, {roll('stddev_samp', 'volume', 21)} AS v_std
FROM eq1""")
part("cf1", "cf0", f"""
SELECT *, {roll('avg', 'raw_vol_21d', 252)} AS w_mean, {roll('stddev_samp', 'raw_vol_21d', 252)} AS w_std,
  adj_close / sma_10 - 1 AS px_over_sma_10, adj_close / sma_50 - 1 AS px_over_sma_50,
  adj_close / sma_200 - 1 AS px_over_sma_200 FROM cf0""")
part("cf_m", "cf1 ewm", f"""
SELECT f.* EXCLUDE (sma_20), raw_vol_21d * sqrt(252.0) AS vol_21d, raw_vol_63d * sqrt(252.0) AS vol_63d, e.macd, e.macd_signal,
  {div('volume - v_mean', 'v_std')} AS vol_zscore_21d FROM cf1 f JOIN ewm e ON e.asset = f.asset AND e.d = f.d""")
part("cf_w", "cf1 ewm", f"""
SELECT f.*, raw_vol_21d AS vol_21d, raw_vol_63d AS vol_63d, e.macd, e.macd_signal,
  {div('raw_vol_21d - w_mean', 'w_std')} AS vol_zscore_21d FROM cf1 f JOIN ewm e ON e.asset = f.asset AND e.d = f.d""")
part("cm_ready", "cf_m", "SELECT * FROM (SELECT asset, last_day(d) AS period_end, "
     + ", ".join(f"arg_max({c}, d) AS {c}" for c in CRYPTO)
     + " FROM cf_m GROUP BY 1, 2) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CRYPTO))
part("cw_ready", "cf_w", f"SELECT * FROM (SELECT asset, {WEEK.format(d='d')} AS period_end, arg_max(adj_close, d) AS adj_close, "
     + ", ".join(f"arg_max({c}, d) AS {c}" for c in CRYPTO)
     + " FROM cf_w GROUP BY 1, 2) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CRYPTO))


def next3(names=("Buy & Hold", "Momentum", "Mean Reversion")) -> str:
    cols = [f"lead({c}) OVER (PARTITION BY asset ORDER BY period_end)" for c in ("bh", "mom", "mr")]
    inner = ", ".join(f"{e} AS n_{c}" for c, e in zip(("bh", "mom", "mr"), cols))
    return f"SELECT * EXCLUDE (n_bh, n_mom, n_mr), {argmax3('n_bh', 'n_mom', 'n_mr', names)} AS best_strategy FROM (SELECT *, {inner} FROM {{src}})"


part("label_next", "rules_m", next3().format(src="rules_m"))
part("label_next0", "rules_m0", next3(("buy_hold", "momentum", "mean_reversion")).format(src="rules_m0"))
part("label_same", "rules_m", f"SELECT *, {argmax3('bh', 'mom', 'mr')} AS best_strategy FROM rules_m")
part("cw_zero", "cw_ready", f"SELECT asset, period_end, coalesce({chg('adj_close', 1, 'period_end')}, 0.0) AS ret FROM cw_ready")
part("rules_wz", "cw_zero", rules("cw_zero", "week"))
_ahead = "OVER (PARTITION BY asset ORDER BY period_end ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)"
part("fwd4", "rules_wz", "SELECT *, " + ", ".join(
    f"CASE WHEN count({c}) {_ahead} = 4 THEN product(1 + {c}) {_ahead} - 1 END AS fwd_{c}" for c in ("bh", "mom", "mr"))
    + " FROM rules_wz")
part("label_fwd4", "fwd4", f"SELECT *, {argmax3('fwd_bh', 'fwd_mom', 'fwd_mr')} AS best_strategy FROM fwd4")
part("pred_lag", "label_same", f"""
SELECT *, lag(best_strategy) OVER (PARTITION BY asset ORDER BY period_end) AS choice,
  greatest(bh, mom, mr) AS oracle FROM label_same""")
part("ml_lag", "pred_lag", f"SELECT *, {follow('choice')} AS ml FROM pred_lag")
part("month_feats", "month_ret", f"""
SELECT asset, period_end, ret, ret AS ret_1m, {roll('sum', 'ret', 3, 'period_end')} AS ret_3m,
  {roll('sum', 'ret', 6, 'period_end')} AS ret_6m, {roll('stddev_samp', 'ret', 3, 'period_end')} AS vol_3m,
  {roll('stddev_samp', 'ret', 6, 'period_end')} AS vol_6m FROM month_ret""")
part("ml_data", "month_feats label_next", """
SELECT f.*, l.best_strategy FROM month_feats f JOIN label_next l ON l.asset = f.asset AND l.period_end = f.period_end
WHERE ret_3m IS NOT NULL AND ret_6m IS NOT NULL AND vol_3m IS NOT NULL AND vol_6m IS NOT NULL AND l.best_strategy IS NOT NULL""")
part("positions", "ml_data", """
SELECT *, row_number() OVER (PARTITION BY asset ORDER BY period_end) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS n_rows
FROM ml_data""")
part("kfolds", "positions", """
SELECT *, CASE WHEN n_rows // 6 > 0 AND pos >= n_rows - 5 * (n_rows // 6)
  THEN (pos - (n_rows - 5 * (n_rows // 6))) // (n_rows // 6) + 1 END AS fold FROM positions""")


def compose(needs: list[str], body: str, final: str) -> str:
    """WITH clause of the needed steps in dependency order, then the answer and its output shape."""
    seen: list[str] = []

    def add(name: str) -> None:
        if name in seen:
            return
        for dep in PARTS[name][0].split():
            add(dep)
        seen.append(name)

    for name in needs:
        add(name)
    steps = [PARTS[name][1].strip() for name in seen] + [f"answer AS ({body})"]
    return "WITH RECURSIVE " + ",\n".join(steps) + "\n" + final
