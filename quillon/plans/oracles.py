"""The registered queries as SQL over the same tables, for DuckDB."""

from __future__ import annotations

from quillon.plans import FIXED_MODEL, SPLIT_AT


def r(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"ROUND(({x})::DOUBLE, {digits}) + 0.0 AS {name or x}"


def rs(*names: str) -> str:
    return ", ".join(r(x) for x in names)


#: Window over a series in time order.
W = "(PARTITION BY series_id ORDER BY ts)"
ALL = "bars AS (SELECT 'ALL' AS series_id, time_bucket(INTERVAL '15 minutes', ts) AS ts, arg_min(value, (ts, event_id)) AS open, MAX(value) AS high, MIN(value) AS low, arg_max(value, (ts, event_id)) AS close, COUNT(*) AS n_ticks FROM events GROUP BY ALL)"
BARS = "bars AS (SELECT event_type AS series_id, time_bucket(INTERVAL '15 minutes', ts) AS ts, arg_min(value, (ts, event_id)) AS open, MAX(value) AS high, MIN(value) AS low, arg_max(value, (ts, event_id)) AS close, COUNT(*) AS n_ticks FROM events GROUP BY ALL)"
SESSION = "ses AS (SELECT * FROM bars WHERE strftime(ts, '%H:%M') BETWEEN '09:15' AND '15:15')"
RETURNS = f"ret AS (SELECT *, LN(NULLIF(close, 0)) - LAG(LN(NULLIF(close, 0)), 1) OVER {W} AS ret_1, LN(NULLIF(close, 0)) - LAG(LN(NULLIF(close, 0)), 20) OVER {W} AS ret_20 FROM bars)"
TARGET = f"tgt AS (SELECT *, LEAD(LN(NULLIF(close, 0))) OVER {W} - LN(NULLIF(close, 0)) AS fwd FROM ret)"
LABELLED_Y = "yy AS (SELECT *, CASE WHEN fwd IS NOT NULL THEN CASE WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS y FROM tgt)"
SC = "sc AS (SELECT *, 1 / (1 + EXP(-ret_1)) AS p FROM yy WHERE y IS NOT NULL AND ret_1 IS NOT NULL)"
SCORED = f"{BARS}, {RETURNS}, {TARGET}, {LABELLED_Y}, {SC}"
BARS_OUT = f"series_id, ts, {rs('open', 'high', 'low', 'close')}, n_ticks"


def numbered(source: str, *more: str) -> str:
    return f"SELECT series_id, ts, ROW_NUMBER() OVER {W} - 1 AS r{''.join(', ' + m for m in more)} FROM {source}"


def wilder(name: str, source: str, columns: dict[str, tuple[str, int, int]]) -> str:
    """CTEs: {name} has series_id, ts and each column's average. columns: out -> (x, period, first row with a value)."""
    means = [f"AVG({x}) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW) AS m_{o}" for o, (x, p, _) in columns.items()]
    base = numbered(source, *[f"{x} AS x_{o}" for o, (x, _, _) in columns.items()], *means)
    first = ", ".join(f"(CASE WHEN {s + p - 1} = 0 THEN m_{o} END)::DOUBLE AS {o}" for o, (_, p, s) in columns.items())
    step = ", ".join(f"CASE WHEN b.r = {s + p - 1} THEN b.m_{o} WHEN b.r > {s + p - 1} THEN q.{o} + (b.x_{o} - q.{o}) / {float(p)}::DOUBLE END" for o, (_, p, s) in columns.items())
    return f"""{name}_b AS ({base}),
{name} AS (SELECT series_id, ts, r, {first} FROM {name}_b WHERE r = 0
  UNION ALL SELECT b.series_id, b.ts, b.r, {step} FROM {name} q JOIN {name}_b b ON b.series_id = q.series_id AND b.r = q.r + 1)"""


def ema(name: str, source: str, columns: dict[str, tuple[str, int]]) -> str:
    base = numbered(source, *[f"{x} AS x_{o}" for o, (x, _) in columns.items()])
    first = ", ".join(f"x_{o}::DOUBLE AS {o}" for o in columns)
    step = ", ".join(f"q.{o} + {2 / (s + 1)!r}::DOUBLE * (b.x_{o} - q.{o})" for o, (_, s) in columns.items())
    return f"""{name}_b AS ({base}),
{name} AS (SELECT series_id, ts, r, {first} FROM {name}_b WHERE r = 0
  UNION ALL SELECT b.series_id, b.ts, b.r, {step} FROM {name} q JOIN {name}_b b ON b.series_id = q.series_id AND b.r = q.r + 1)"""


def rank_1000(x: str, source: str, keep: str) -> str:
    """SELECT with pct: the average rank of x among the last 1000 rows' values."""
    return f"""SELECT {keep}, CASE WHEN {x} IS NOT NULL AND len(seen) >= 250
  THEN (len(list_filter(seen, lambda v: v < {x})) + (len(list_filter(seen, lambda v: v = {x})) + 1) / 2.0) / len(seen) END AS pct
  FROM (SELECT *, LIST({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS seen FROM {source})"""


TR = f"tr AS (SELECT *, GREATEST(high - low, ABS(high - LAG(close) OVER {W}), ABS(low - LAG(close) OVER {W})) AS true_range FROM bars)"
DM = f"""dm0 AS (SELECT *, high - LAG(high) OVER {W} AS up, LAG(low) OVER {W} - low AS dn FROM tr),
dm AS (SELECT *, CASE WHEN up IS NOT NULL THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END END AS dm_plus,
  CASE WHEN up IS NOT NULL THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END END AS dm_minus FROM dm0)"""
RSI = f"""WITH RECURSIVE {BARS}, gl0 AS (SELECT *, close - LAG(close) OVER {W} AS d FROM bars),
gl AS (SELECT *, CASE WHEN d IS NOT NULL THEN GREATEST(d, 0.0) END AS g, CASE WHEN d IS NOT NULL THEN GREATEST(-d, 0.0) END AS l FROM gl0),
{wilder("rec", "gl", {f"{k}{p}": (k, p, 1) for p in (7, 14, 21) for k in "gl"})},
v AS (SELECT series_id, ts, r, {", ".join(f"CASE WHEN g{p} IS NULL THEN NULL WHEN g{p} = 0 AND l{p} = 0 THEN 50.0 WHEN l{p} = 0 THEN 100.0 ELSE 100 - 100 / (1 + g{p} / l{p}) END AS rsi_{p}" for p in (7, 14, 21))} FROM rec),
f AS (SELECT *, COALESCE(rsi_14 > 70, FALSE) AS rsi_14_overbought, COALESCE(rsi_14 < 30, FALSE) AS rsi_14_oversold FROM v)
SELECT series_id, ts, {rs("rsi_7", "rsi_14", "rsi_21")}, {r("(rsi_14 - 50) / 50", "rsi_14_norm")}, {r(f"rsi_14 - LAG(rsi_14) OVER {W}", "rsi_14_chg")},
  {r(f"(rsi_14 - LAG(rsi_14, 5) OVER {W}) / 5", "rsi_14_slope_5")}, {r("rsi_7 - rsi_21", "rsi_spread_7_21")}, rsi_14_overbought, rsi_14_oversold,
  (rsi_14_overbought::INT - rsi_14_oversold::INT)::TINYINT AS rsi_14_zone, (rsi_7 IS NULL OR rsi_14 IS NULL OR rsi_21 IS NULL OR r < 105) AS rsi_is_warmup FROM f"""
MACD = f"""WITH RECURSIVE {BARS}, {ema("e1", "bars", {"f": ("close", 12), "s": ("close", 26)})},
m AS (SELECT e1.series_id, e1.ts, e1.r, f - s AS macd, close FROM e1 JOIN bars USING (series_id, ts)), {ema("e2", "m", {"sig": ("macd", 9)})},
h AS (SELECT m.*, sig AS macd_signal, macd - sig AS macd_hist FROM m JOIN e2 USING (series_id, ts)),
p AS (SELECT *, macd / NULLIF(close, 0) * 100 AS macd_pct, macd_signal / NULLIF(close, 0) * 100 AS macd_signal_pct, macd_hist / NULLIF(close, 0) * 100 AS macd_hist_pct, (macd > macd_signal)::INT AS above FROM h)
SELECT series_id, ts, {rs("macd_signal", "macd", "macd_hist", "macd_pct", "macd_signal_pct", "macd_hist_pct")}, {r(f"macd_hist_pct - LAG(macd_hist_pct) OVER {W}", "macd_hist_chg")},
  COALESCE(macd > macd_signal, FALSE) AS macd_above_signal, COALESCE(above - LAG(above) OVER {W}, 0)::TINYINT AS macd_cross, (macd IS NULL OR macd_signal IS NULL OR r < 175) AS macd_is_warmup FROM p"""
ATR = f"""WITH RECURSIVE {BARS}, {TR}, {wilder("rec", "tr", {"atr_14": ("true_range", 14, 0)})},
a AS (SELECT tr.*, rec.r, atr_14, atr_14 / NULLIF(close, 0) * 100 AS atr_pct FROM tr JOIN rec USING (series_id, ts)),
k AS ({rank_1000("atr_pct", "a", "series_id, ts, r, true_range, atr_14, atr_pct")})
SELECT series_id, ts, {rs("true_range", "atr_14", "atr_pct")}, {r("true_range / NULLIF(atr_14, 0)", "tr_over_atr")}, {r(f"(atr_14 / NULLIF(LAG(atr_14) OVER {W}, 0) - 1) * 100", "atr_chg_pct")},
  {r("pct", "atr_pctile_1000")}, (atr_14 IS NULL OR atr_pct IS NULL OR pct IS NULL OR r < 70) AS atr_is_warmup FROM k"""
ADX = f"""WITH RECURSIVE {BARS}, {TR}, {DM}, {wilder("rec", "dm", {"t": ("true_range", 14, 0), "a": ("dm_plus", 14, 1), "b": ("dm_minus", 14, 1)})},
di AS (SELECT series_id, ts, r, 100 * a / NULLIF(t, 0) AS di_plus, 100 * b / NULLIF(t, 0) AS di_minus FROM rec),
dx AS (SELECT *, CASE WHEN di_plus + di_minus = 0 THEN 0.0 ELSE 100 * ABS(di_plus - di_minus) / NULLIF(di_plus + di_minus, 0) END AS dx FROM di),
{wilder("rec2", "dx", {"adx_14": ("dx", 14, 14)})},
j AS (SELECT dx.*, adx_14, COALESCE(adx_14 > 25, FALSE) AS adx_trending FROM dx JOIN rec2 USING (series_id, ts))
SELECT series_id, ts, {rs("di_plus", "di_minus", "dx", "adx_14")}, {r("di_plus - di_minus", "di_spread")}, {r("adx_14 / 100", "adx_norm")}, {r(f"adx_14 - LAG(adx_14) OVER {W}", "adx_chg")}, adx_trending,
  (COALESCE(SIGN(di_plus - di_minus), 0) * adx_trending::INT)::TINYINT AS adx_regime, (adx_14 IS NULL OR di_plus IS NULL OR di_minus IS NULL OR r < 140) AS adx_is_warmup FROM j"""
BB = f"""bb0 AS (SELECT *, ROW_NUMBER() OVER {W} - 1 AS r, COUNT(close) OVER w AS n20, AVG(close) OVER w AS m20, STDDEV_POP(close) OVER w AS s20 FROM bars
  WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
bb1 AS (SELECT *, CASE WHEN n20 = 20 THEN m20 END AS bb_mid, CASE WHEN n20 = 20 THEN s20 END AS bb_std FROM bb0),
bb2 AS (SELECT *, bb_mid + 2 * bb_std AS bb_upper, bb_mid - 2 * bb_std AS bb_lower FROM bb1),
bb3 AS (SELECT *, (close - bb_lower) / NULLIF(bb_upper - bb_lower, 0) AS bb_pct_b, (bb_upper - bb_lower) / NULLIF(bb_mid, 0) * 100 AS bb_bandwidth, (close - bb_mid) / NULLIF(bb_mid, 0) * 100 AS bb_dist_mid_pct FROM bb2),
bb AS ({rank_1000("bb_bandwidth", "bb3", "* EXCLUDE (seen)")}),
bf AS (SELECT *, pct AS bb_bandwidth_pctile, COALESCE(pct < 0.10, FALSE) AS bb_squeeze, (COALESCE(close > bb_upper, FALSE)::INT - COALESCE(close < bb_lower, FALSE)::INT)::TINYINT AS bb_break,
  (bb_mid IS NULL OR bb_pct_b IS NULL OR bb_bandwidth IS NULL OR pct IS NULL OR r < 20) AS bb_is_warmup FROM bb)"""
BB_COLUMNS = ["bb_mid", "bb_upper", "bb_lower", "bb_std", "bb_pct_b", "bb_bandwidth", "bb_dist_mid_pct", "bb_bandwidth_pctile"]
BOLLINGER = f"WITH {BARS}, {BB} SELECT series_id, ts, {rs(*BB_COLUMNS)}, bb_squeeze, bb_break, bb_is_warmup FROM bf"
FLAGS = ["rsi_is_warmup", "macd_is_warmup", "atr_is_warmup", "adx_is_warmup", "bb_is_warmup"]
MATRIX = f"""SELECT b.series_id, b.ts, {", ".join(r(f"b.{c}", c) for c in ("open", "high", "low", "close"))}, b.n_ticks, a.* EXCLUDE (series_id, ts), m.* EXCLUDE (series_id, ts),
  t.* EXCLUDE (series_id, ts), x.* EXCLUDE (series_id, ts), o.* EXCLUDE (series_id, ts), ({" OR ".join(FLAGS)}) AS is_warmup
FROM (WITH {BARS} SELECT * FROM bars) b JOIN ({RSI}) a USING (series_id, ts) JOIN ({MACD}) m USING (series_id, ts) JOIN ({ATR}) t USING (series_id, ts)
  JOIN ({ADX}) x USING (series_id, ts) JOIN ({BOLLINGER}) o USING (series_id, ts)"""
COUNTS = """c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (p < 0.5 AND y = 0) AS tn, COUNT(*) FILTER (p >= 0.5 AND y = 0) AS fp, COUNT(*) FILTER (p < 0.5 AND y = 1) AS fn,
  COUNT(*) FILTER (p >= 0.5 AND y = 1) AS tp, AVG((p - y) ** 2) AS brier{key} FROM sc{group})"""
AREA = """k AS (SELECT *, RANK() OVER (PARTITION BY {key} ORDER BY p) + (COUNT(*) OVER (PARTITION BY {key}, p) - 1) / 2.0 AS rk FROM {source}),
a AS (SELECT {key} AS g, (SUM(rk) FILTER (y = 1) - COUNT(*) FILTER (y = 1) * (COUNT(*) FILTER (y = 1) + 1) / 2.0) / NULLIF(COUNT(*) FILTER (y = 1) * COUNT(*) FILTER (y = 0), 0)::DOUBLE AS auc FROM k GROUP BY g)"""
MCC = "CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / SQRT((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE {other} END"
METRICS = f"""n, 0.5::DOUBLE AS threshold, tn, fp, fn, tp, {r("(tp + tn) / n::DOUBLE", "accuracy")}, {r("CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END", "precision")},
  {r("CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END", "recall")}, {r("CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END", "f1")},
  {r(MCC.format(other=0), "mcc")}, {r("brier")}, {r("(tp + fp) / n::DOUBLE", "predicted_up_rate")}, {r("auc")}"""
HELD = f"""h0 AS (SELECT *, CASE WHEN p >= 0.5 THEN 1.0 ELSE -1.0 END AS pos FROM sc),
h AS (SELECT *, ABS(pos - COALESCE(LAG(pos) OVER {W}, 0.0)) / 2 AS turn FROM h0)"""
BASE = "bl AS (SELECT COUNT(*) AS n, AVG(y) AS rate, AVG(((ret_1 > 0) = (y = 1))::INT) AS again FROM sc)"


MODEL_STATES = range(4)
LOGS = [[f"LN({x}::DOUBLE)" for x in row] for row in FIXED_MODEL["transmat"]]
NAMES = [FIXED_MODEL["label_map"][str(k)] for k in MODEL_STATES]


def density(k: int) -> tuple[str, float]:
    """Minus half of the squared distance to state k, and its variance: the covariances are multiples of the unit one."""
    (u, v), var = FIXED_MODEL["means"][k], FIXED_MODEL["covars"][k][0][0]
    return f"-0.5 * ((ret_1 - {u}) ** 2 + (ret_20 - {v}) ** 2) / {var}", var


def filter_sql(source: str = "ret", before: str = f"{BARS}, {RETURNS}") -> str:
    a = FIXED_MODEL["transmat"]
    densities = ", ".join(f"EXP({density(k)[0]}) / {density(k)[1]} AS b{k}, {density(k)[0]} - LN({density(k)[1]}::DOUBLE) AS l{k}" for k in MODEL_STATES)
    base = f"fb AS MATERIALIZED (SELECT series_id, ts, ROW_NUMBER() OVER {W} - 1 AS r, {densities} FROM {source} WHERE ret_1 IS NOT NULL AND ret_20 IS NOT NULL)"
    first = ", ".join(f"b{k} / (b0 + b1 + b2 + b3) AS p{k}" for k in MODEL_STATES)
    raw = [f"({' + '.join(f'q.p{j} * {a[j][k]}::DOUBLE' for j in MODEL_STATES)}) * b.b{k}" for k in MODEL_STATES]
    step = ", ".join(f"{x} / ({' + '.join(raw)})" for x in raw)
    return f"""{before}, {base}, fr AS (SELECT series_id, ts, r, {first} FROM fb WHERE r = 0
  UNION ALL SELECT b.series_id, b.ts, b.r, {step} FROM fr q JOIN fb b ON b.series_id = q.series_id AND b.r = q.r + 1)"""


def smoother_sql() -> str:
    """sm: backwards over the filtered rows."""
    a = FIXED_MODEL["transmat"]
    ahead = [f"({' + '.join(f'f.p{j} * {a[j][k]}::DOUBLE' for j in MODEL_STATES)})" for k in MODEL_STATES]
    back = ", ".join(f"f.p{j} * ({' + '.join(f'{a[j][k]}::DOUBLE * q.p{k} / {ahead[k]}' for k in MODEL_STATES)})" for j in MODEL_STATES)
    return f"""{filter_sql()}, f AS MATERIALIZED (SELECT * FROM fr), ends AS (SELECT series_id, MAX(r) AS r FROM f GROUP BY series_id),
sm AS (SELECT f.* FROM f JOIN ends USING (series_id, r) UNION ALL SELECT f.series_id, f.ts, f.r, {back} FROM sm q JOIN f ON f.series_id = q.series_id AND f.r = q.r - 1)"""


def path_sql() -> str:
    """bt: the best path, backwards from the best last state."""
    first = ", ".join(f"LN({FIXED_MODEL['startprob'][k]}::DOUBLE) + l{k} AS v{k}" for k in MODEL_STATES)
    terms = [[f"q.v{j} + {LOGS[j][k]}" for j in MODEL_STATES] for k in MODEL_STATES]
    tops = [f"GREATEST({', '.join(t)})" for t in terms]
    step = ", ".join(f"{tops[k]} + b.l{k}" for k in MODEL_STATES)
    came = ", ".join("CASE " + " ".join(f"WHEN {t} = {tops[k]} THEN {j}" for j, t in enumerate(terms[k])) + " END" for k in MODEL_STATES)
    last = "CASE GREATEST(v0, v1, v2, v3) " + " ".join(f"WHEN v{k} THEN {k}" for k in MODEL_STATES) + " END"
    zero = ", ".join(f"0 AS c{k}" for k in MODEL_STATES)
    return f"""{filter_sql()}, vr AS (SELECT series_id, ts, r, {first}, {zero} FROM fb WHERE r = 0
  UNION ALL SELECT b.series_id, b.ts, b.r, {step}, {came} FROM vr q JOIN fb b ON b.series_id = q.series_id AND b.r = q.r + 1),
vb AS MATERIALIZED (SELECT * FROM vr), ends AS (SELECT series_id, MAX(r) AS r FROM vb GROUP BY series_id),
bt AS (SELECT series_id, ts, r, {last} AS state, c0, c1, c2, c3 FROM vb JOIN ends USING (series_id, r)
  UNION ALL SELECT b.series_id, b.ts, b.r, CASE q.state WHEN 0 THEN q.c0 WHEN 1 THEN q.c1 WHEN 2 THEN q.c2 ELSE q.c3 END, b.c0, b.c1, b.c2, b.c3 FROM bt q JOIN vb b ON b.series_id = q.series_id AND b.r = q.r - 1)"""


TOP = "GREATEST(p0, p1, p2, p3)"
ENTROPY = " - ".join(["0"] + [f"CASE WHEN p{k} > 0 THEN p{k} * LN(p{k}) ELSE 0 END" for k in MODEL_STATES])
NAMED = "CASE " + " ".join(f"WHEN p{k} = {TOP} THEN '{NAMES[k]}'" for k in MODEL_STATES) + " END"
REGIMES = f"{filter_sql()}, lab AS MATERIALIZED (SELECT ret.*, p0, p1, p2, p3, {NAMED} AS regime FROM ret LEFT JOIN fr USING (series_id, ts))"
REGIMES_OUT = f"""{", ".join(r(f"p{k}", f"regime_p_{NAMES[k]}") for k in MODEL_STATES)}, regime, {r(TOP, "regime_confidence")}, {r(f"1 - {TOP}", "regime_changepoint")},
  {r(f"CASE WHEN p0 IS NOT NULL THEN {ENTROPY} END", "regime_entropy")}"""
DAY = "strftime(ts, '%Y-%m-%d')"
USABLE = f"""{BARS}, {RETURNS}, {TARGET}, us AS (SELECT *, ROW_NUMBER() OVER {W} AS rn, (ret_1 IS NOT NULL AND ret_20 IS NOT NULL AND fwd IS NOT NULL AND ROW_NUMBER() OVER {W} > 20) AS usable,
  CASE WHEN fwd IS NOT NULL THEN (fwd > 0)::INT::DOUBLE END AS y FROM tgt),
wi AS (SELECT *, SUM(usable::INT) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) = 32 AS window_ok,
  SUM(ret_1::FLOAT::DOUBLE) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS s32 FROM us)"""
SHARE = ", ".join(r(f"COUNT(*) FILTER (regime = '{n}') * 100.0 / COUNT(*)", f"{n}_pct") for n in ("bull", "bear", "sideways", "high_vol"))

SESSION_COLUMNS = f"""{BARS}, {SESSION}, sd AS (SELECT *, {DAY} AS session_date FROM ses), sn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id, session_date ORDER BY ts) - 1 AS k FROM sd),
sec AS (SELECT series_id, ts, session_date, k::SMALLINT AS bar_of_day, k = 0 AS is_session_open, COALESCE(LEAD(session_date) OVER {W} <> session_date, TRUE) AS is_session_close FROM sn)"""
#: Value columns of each block, and the others that it adds.
VALUES = {
    "rsi": ["rsi_7", "rsi_14", "rsi_21", "rsi_14_norm", "rsi_14_chg", "rsi_14_slope_5", "rsi_spread_7_21"],
    "macd": ["macd", "macd_signal", "macd_hist", "macd_pct", "macd_signal_pct", "macd_hist_pct", "macd_hist_chg"],
    "atr": ["true_range", "atr_14", "atr_pct", "tr_over_atr", "atr_chg_pct", "atr_pctile_1000"],
    "adx": ["di_plus", "di_minus", "dx", "adx_14", "di_spread", "adx_norm", "adx_chg"],
    "bollinger": BB_COLUMNS,
}
MARKS = {
    "rsi": ["rsi_14_overbought", "rsi_14_oversold", "rsi_14_zone", "rsi_is_warmup"],
    "macd": ["macd_above_signal", "macd_cross", "macd_is_warmup"],
    "atr": ["atr_is_warmup"],
    "adx": ["adx_trending", "adx_regime", "adx_is_warmup"],
    "bollinger": ["bb_squeeze", "bb_break", "bb_is_warmup"],
}
NO_INPUT = "macd macd_signal macd_hist true_range atr_14 bb_mid bb_upper bb_lower bb_std dx".split()
MODEL_INPUTS = [c for b in VALUES for c in [*VALUES[b], *MARKS[b]] if c not in NO_INPUT and not c.endswith("is_warmup")]
ALL_COLUMNS = [(c, "bars") for c in ("series_id", "ts", "open", "high", "low", "close", "n_ticks")] + [(c, b) for b in VALUES for c in [*VALUES[b], *MARKS[b]]] + [("is_warmup", "bars")]


def warm(sql: str, rows: int) -> str:
    """A block's SQL over the later bars with the last rows earlier ones of each series before them."""
    tail = f"tail AS (SELECT * FROM bars0 WHERE ts < TIMESTAMP '{SPLIT_AT}' QUALIFY ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ts DESC) <= {rows})"
    bars = f"bars AS (SELECT * FROM tail UNION ALL SELECT * FROM bars0 WHERE ts >= TIMESTAMP '{SPLIT_AT}')"
    return sql.replace(BARS, f"{BARS.replace('bars AS', 'bars0 AS', 1)}, {tail}, {bars}")


def missing(columns) -> str:
    return " OR ".join(f"{c} IS NULL" for c in columns)


SPLIT_RETURNS = RETURNS.replace("PARTITION BY series_id", f"PARTITION BY series_id, ts >= TIMESTAMP '{SPLIT_AT}'")
WARM_ROWS = f"wr AS (SELECT * FROM ret WHERE ts >= TIMESTAMP '{SPLIT_AT}' UNION ALL (SELECT * FROM ret WHERE ts < TIMESTAMP '{SPLIT_AT}' QUALIFY ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 250))"
PARTS = """o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ts) AS k, COUNT(*) OVER (PARTITION BY series_id) AS total FROM wi WHERE window_ok),
p AS (SELECT *, CASE WHEN k > total - FLOOR(total * 0.15) THEN 'val' WHEN k > total - FLOOR(total * 0.15) - 33 THEN 'purge' ELSE 'train' END AS part FROM o)"""
#: ml: predictions of the three rules by model and part with the threshold of each.
RULES = f"""{REGIMES}, {USABLE.replace(f"{BARS}, {RETURNS}, ", "")}, {PARTS}, rw AS (SELECT p.series_id, p.ts, part, y, fwd, p.ret_1, p.ret_20, regime FROM p JOIN (SELECT series_id, ts, regime FROM lab) l USING (series_id, ts) WHERE part <> 'purge'),
rm AS (SELECT 'momentum' AS model, 1 / (1 + EXP(-ret_1)) AS p, * FROM rw UNION ALL SELECT 'reversal', 1 / (1 + EXP(ret_1)), * FROM rw UNION ALL SELECT 'trend', 1 / (1 + EXP(-ret_20)), * FROM rw),
tg AS (SELECT k::INT AS k, 0.30::DOUBLE + k * ((0.70::DOUBLE - 0.30::DOUBLE) / 80) AS threshold FROM range(81) t(k)),
ta AS (SELECT model, k, threshold, AVG(((p >= threshold) = (y = 1))::INT) AS accuracy FROM rm, tg WHERE part = 'val' GROUP BY ALL),
th AS (SELECT model, arg_max(threshold, (accuracy, -k)) AS threshold FROM ta GROUP BY model), ml AS MATERIALIZED (SELECT * FROM rm JOIN th USING (model))"""
METRICS_BY_MODEL = f"""{RULES}, c AS (SELECT model || '/' || part AS g, model, part, COUNT(*) AS n, MAX(threshold) AS threshold, COUNT(*) FILTER (p < threshold AND y = 0) AS tn, COUNT(*) FILTER (p >= threshold AND y = 0) AS fp,
  COUNT(*) FILTER (p < threshold AND y = 1) AS fn, COUNT(*) FILTER (p >= threshold AND y = 1) AS tp, AVG((p - y) ** 2) AS brier, AVG(((ret_1 > 0) = (y = 1))::INT) AS persistence FROM ml GROUP BY ALL),
{AREA.format(key="model || '/' || part", source="ml")}, mm AS (SELECT c.*, auc, (tp + tn) / n::DOUBLE AS accuracy FROM c JOIN a USING (g))"""
HELD_BY_MODEL = """h0 AS (SELECT *, CASE WHEN p >= threshold THEN 1.0 ELSE -1.0 END AS pos FROM ml WHERE part = 'val'),
h AS (SELECT *, ABS(pos - COALESCE(LAG(pos) OVER (PARTITION BY model, series_id ORDER BY ts), 0.0)) / 2 AS turn FROM h0)"""

ORACLES: dict[str, str] = {
    "bars15": f"WITH {ALL} SELECT {BARS_OUT} FROM bars",
    "bars_by_type": f"WITH {BARS} SELECT {BARS_OUT} FROM bars",
    "daily_order_bars": f"""SELECT o_orderdate, {r("arg_min(o_totalprice, o_orderkey)", "open")}, {r("MAX(o_totalprice)", "high")}, {r("MIN(o_totalprice)", "low")},
  {r("arg_max(o_totalprice, o_orderkey)", "close")}, COUNT(*) AS n_ticks FROM orders GROUP BY o_orderdate""",
    "supplier_moving_average": f"""WITH m AS (SELECT l_suppkey AS series_id, COUNT(*) OVER w AS n, AVG(l_extendedprice::DOUBLE) OVER w AS a FROM lineitem
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT series_id, COUNT(*) AS n, COUNT(*) FILTER (n = 20) AS n_ma, {r("MAX(a) FILTER (n = 20)", "max_ma")}, {r("MIN(a) FILTER (n = 20)", "min_ma")} FROM m GROUP BY series_id""",
    "session_filter": f"WITH {BARS}, {SESSION} SELECT {BARS_OUT} FROM ses",
    "session_columns": f"""WITH {BARS}, {SESSION}, d AS (SELECT *, {DAY} AS session_date FROM ses), n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id, session_date ORDER BY ts) - 1 AS k FROM d)
SELECT series_id, ts, session_date, k::SMALLINT AS bar_of_day, k = 0 AS is_session_open, COALESCE(LEAD(session_date) OVER {W} <> session_date, TRUE) AS is_session_close FROM n""",
    "dedupe_first": f"WITH {ALL} SELECT {BARS_OUT}, 0 AS ingest_seq FROM bars",
    "quality_audit": f"""WITH {BARS}, m AS (SELECT *, ABS(close / NULLIF(LAG(close) OVER {W}, 0) - 1) * 1e4 AS mv FROM bars)
SELECT series_id, COUNT(*) AS n_rows, COUNT(*) FILTER (high < low OR high < GREATEST(open, close) OR low > LEAST(open, close)) AS ohlc_violations,
  (COUNT(*) FILTER (open <= 0) + COUNT(*) FILTER (high <= 0) + COUNT(*) FILTER (low <= 0) + COUNT(*) FILTER (close <= 0))::BIGINT AS non_positive,
  (4 * COUNT(*) - COUNT(open) - COUNT(high) - COUNT(low) - COUNT(close))::BIGINT AS null_cells, MIN(ts) AS first_ts, MAX(ts) AS last_ts, {r("MAX(mv)", "max_abs_return_bps")} FROM m GROUP BY series_id""",
    "session_audit": f"""WITH {BARS}, {SESSION}, s AS (SELECT series_id, {DAY} AS d, COUNT(*) AS n FROM ses GROUP BY ALL)
SELECT series_id, COUNT(*) AS n_sessions, COUNT(*) FILTER (n < 25) AS short_sessions, (25 * COUNT(*) - SUM(n))::BIGINT AS missing_bars FROM s GROUP BY series_id""",
    "short_sessions": f"""WITH {BARS}, {SESSION} SELECT series_id, {DAY} AS session_date, COUNT(*) AS n_bars FROM ses GROUP BY ALL HAVING COUNT(*) < 25 ORDER BY n_bars, session_date, series_id LIMIT 10""",
    "null_census": f"""WITH {BARS}, {RETURNS}, {TARGET}, {LABELLED_Y}, n AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS n_null FROM yy" for c in ("series_id", "ts", "open", "high", "low", "close", "n_ticks", "ret_1", "ret_20", "fwd", "y"))})
SELECT * FROM n WHERE n_null > 0""",
    "log_close": f"WITH {BARS} SELECT series_id, ts, {r('LN(NULLIF(close, 0))', 'log_close')} FROM bars",
    "returns_log": f"WITH {BARS}, {RETURNS} SELECT series_id, ts, {rs('ret_1', 'ret_20')} FROM ret",
    "rolling_return": f"WITH {BARS}, {RETURNS} SELECT series_id, ts, {r('ret_20', 'sum_20')} FROM ret",
    "true_range": f"WITH {BARS}, {TR} SELECT series_id, ts, {rs('true_range')} FROM tr",
    "directional_movement": f"WITH {BARS}, {TR}, {DM} SELECT series_id, ts, {rs('dm_plus', 'dm_minus')} FROM dm",
    "rma14": f"WITH RECURSIVE {BARS}, {wilder('rec', 'bars', {'rma_14': ('close', 14, 0)})} SELECT series_id, ts, {rs('rma_14')} FROM rec",
    "sql_rma14": f"WITH RECURSIVE {BARS}, {wilder('rec', 'bars', {'rma_14': ('close', 14, 0)})} SELECT series_id, ts, {rs('rma_14')} FROM rec",
    "ema12": f"WITH RECURSIVE {BARS}, {ema('rec', 'bars', {'ema_12': ('close', 12)})} SELECT series_id, ts, {rs('ema_12')} FROM rec",
    "crossover": f"WITH {BARS} SELECT series_id, ts, COALESCE((close > open)::INT - LAG((close > open)::INT) OVER {W}, 0)::TINYINT AS cross FROM bars",
    "rsi_block": RSI,
    "macd_block": MACD,
    "atr_block": ATR,
    "adx_block": ADX,
    "bollinger_block": BOLLINGER,
    "band_breaks_per_day": f"WITH {BARS}, {BB} SELECT series_id, {DAY} AS day, COUNT(*) FILTER (bb_break > 0) AS n_up, COUNT(*) FILTER (bb_break < 0) AS n_down FROM bf WHERE bb_break <> 0 GROUP BY ALL",
    "bars_features": MATRIX,
    "warmup_counts": f"SELECT series_id, COUNT(*) AS n, {', '.join(f'COUNT(*) FILTER ({c}) AS n_{c}' for c in [*FLAGS, 'is_warmup'])} FROM ({MATRIX}) GROUP BY series_id",
    "summary_stats": f"""WITH {BARS}, {BB}, z AS (SELECT * FROM bf WHERE NOT bb_is_warmup), l AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS x FROM z" for c in ("close", "bb_mid", "bb_std", "bb_pct_b", "bb_bandwidth", "bb_dist_mid_pct"))})
SELECT column_name, COUNT(x) AS n, {r("AVG(x)", "mean")}, {r("STDDEV_SAMP(x)", "std")}, {r("MIN(x)", "min")}, {r("MEDIAN(x)", "median")}, {r("MAX(x)", "max")} FROM l GROUP BY column_name""",
    "flag_shares": f"SELECT flag, {r('AVG(x::INT) * 100', 'share_pct')} FROM (UNPIVOT (SELECT rsi_14_overbought, rsi_14_oversold, rsi_is_warmup FROM ({RSI})) ON COLUMNS(*) INTO NAME flag VALUE x) GROUP BY flag",
    "warm_start": f"SELECT series_id, ts, {', '.join(['bb_mid', 'bb_std', 'bb_pct_b', 'bb_bandwidth_pctile'])}, ({missing(BB_COLUMNS)}) AS bb_is_warmup FROM ({warm(BOLLINGER, 1250)}) WHERE ts >= TIMESTAMP '{SPLIT_AT}'",
    "warm_start_all": f"""WITH m AS (SELECT * FROM ({warm(MATRIX, 1250)}) WHERE ts >= TIMESTAMP '{SPLIT_AT}'), f AS (SELECT *, ({missing(c for v in VALUES.values() for c in v)}) AS gap FROM m)
SELECT series_id, ts, rsi_14, macd_signal_pct, atr_pctile_1000, adx_14, bb_pct_b, {", ".join(f"gap AS {c}" for c in [*FLAGS, "is_warmup"])} FROM f""",
    **{
        f"warm_{n}": f"SELECT * EXCLUDE ({f}), ({missing(VALUES[n])}) AS {f} FROM ({warm(sql, rows)}) WHERE ts >= TIMESTAMP '{SPLIT_AT}'"
        for n, sql, f, rows in (("rsi", RSI, "rsi_is_warmup", 250), ("macd", MACD, "macd_is_warmup", 250), ("atr", ATR, "atr_is_warmup", 1070), ("adx", ADX, "adx_is_warmup", 250), ("bollinger", BOLLINGER, "bb_is_warmup", 1020))
    },
    "leakage_check": f"""WITH {BARS}, tn AS (SELECT * FROM bars WHERE ts < TIMESTAMP '{SPLIT_AT}'), la AS (SELECT * FROM tn QUALIFY ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 3),
te AS (SELECT * FROM bars WHERE ts >= TIMESTAMP '{SPLIT_AT}' UNION ALL SELECT * FROM la), o AS (SELECT series_id, COUNT(*) AS n FROM tn SEMI JOIN te USING (series_id, ts) GROUP BY series_id),
a AS (SELECT series_id, COUNT(*) AS n_train, MAX(ts) AS train_end FROM tn GROUP BY series_id), b AS (SELECT series_id, COUNT(*) AS n_test, MIN(ts) AS test_begin FROM te GROUP BY series_id)
SELECT a.series_id, n_train, train_end, n_test, test_begin, COALESCE(o.n, 0)::BIGINT AS n_overlap, train_end < test_begin AS ordered FROM a JOIN b USING (series_id) LEFT JOIN o USING (series_id)""",
    "session_invariants": f"""WITH {SESSION_COLUMNS}, g AS (SELECT series_id, session_date, COUNT(*) AS n, arg_min(bar_of_day, ts) AS first, COUNT(*) FILTER (is_session_open) AS o, COUNT(*) FILTER (is_session_close) AS c FROM sec GROUP BY ALL)
SELECT series_id, COUNT(*) AS n_sessions, SUM(o)::BIGINT AS n_opens, SUM(c)::BIGINT AS n_closes, MAX(n) AS longest, MAX(first)::SMALLINT AS largest_first FROM g GROUP BY series_id""",
    "outside_sessions": f"""WITH {BARS} SELECT series_id, COUNT(*) AS n_rows, COUNT(DISTINCT {DAY})::INT AS n_dates, STRING_AGG(DISTINCT {DAY}, ',' ORDER BY {DAY}) AS dates
FROM bars WHERE NOT strftime(ts, '%H:%M') BETWEEN '09:15' AND '15:15' GROUP BY series_id""",
    "column_catalogue": f"""WITH m AS MATERIALIZED ({MATRIX}), c AS (SELECT {", ".join(f"COUNT({n}) AS {n}" for n, _ in ALL_COLUMNS)} FROM m), u AS (UNPIVOT c ON COLUMNS(*) INTO NAME column_name VALUE n_values)
SELECT x.*, n_values FROM (VALUES {", ".join(f"({k}, '{n}', '{b}', {str(n in MODEL_INPUTS).upper()})" for k, (n, b) in enumerate(ALL_COLUMNS))}) x("position", column_name, block, is_model_input) JOIN u USING (column_name)""",
    "target": f"WITH {BARS}, {RETURNS}, {TARGET}, {LABELLED_Y} SELECT series_id, ts, {rs('fwd', 'y')} FROM yy",
    "window_contiguity": f"WITH {USABLE} SELECT series_id, ts, usable, COALESCE(window_ok, FALSE) AS window_ok FROM wi",
    "windows32": f"WITH {USABLE} SELECT series_id, ts, (rn - 1)::BIGINT AS row_index, {r('y', digits=4)}, 32 AS n_rows, {r('s32', 'sum_ret_1', 4)} FROM wi WHERE window_ok",
    "chronological_split": f"""WITH {USABLE}, o AS (SELECT *, ROW_NUMBER() OVER {W} AS k, COUNT(*) OVER (PARTITION BY series_id) AS total FROM wi WHERE window_ok),
p AS (SELECT *, CASE WHEN k > total - FLOOR(total * 0.15) THEN 'val' WHEN k > total - FLOOR(total * 0.15) - 33 THEN 'purge' ELSE 'train' END AS part FROM o)
SELECT series_id, part, COUNT(*) AS n, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM p GROUP BY ALL""",
    "scaler_stats": f"""WITH {USABLE}, g AS (SELECT series_id, rn FROM wi WHERE window_ok), e AS (SELECT u.ret_1, u.ret_20 FROM g JOIN wi u ON u.series_id = g.series_id AND u.rn BETWEEN g.rn - 31 AND g.rn),
l AS (SELECT 'ret_1' AS column_name, ret_1 AS v FROM e UNION ALL SELECT 'ret_20', ret_20 FROM e)
SELECT column_name, COUNT(*) AS n, {r("AVG(v)", "mean")}, {r("STDDEV_POP(v)", "std")} FROM l GROUP BY column_name""",
    "baselines": f"WITH {SCORED}, {BASE} SELECT n, {r('rate', 'positive_rate')}, {r('GREATEST(rate, 1 - rate)', 'majority')}, {r('again', 'persistence')} FROM bl",
    "threshold_grid": f"""WITH {SCORED}, g AS (SELECT k::INT AS k, 0.30::DOUBLE + k * ((0.70::DOUBLE - 0.30::DOUBLE) / 80) AS threshold FROM range(81) t(k))
SELECT k, {r("threshold")}, {r("AVG(((p >= threshold) = (y = 1))::INT)", "accuracy")}, COUNT(*) AS n FROM sc, g GROUP BY k, threshold""",
    "classification_metrics": f"WITH {SCORED}, {COUNTS.format(key='', group='')}, {AREA.format(key='1', source='sc')} SELECT {METRICS} FROM c, a",
    "metrics_by_series": f"WITH {SCORED}, {COUNTS.format(key=', series_id', group=' GROUP BY series_id')}, {AREA.format(key='series_id', source='sc')} SELECT series_id, {METRICS} FROM c JOIN a ON a.g = c.series_id",
    "baseline_lift": f"""WITH {SCORED}, {BASE}, {COUNTS.format(key="", group="")}, v AS (SELECT (tp + tn) / c.n::DOUBLE AS accuracy, GREATEST(rate, 1 - rate) AS majority, again AS persistence FROM c, bl)
SELECT {rs("accuracy", "majority", "persistence")}, {r("accuracy - majority", "lift_majority")}, {r("accuracy - persistence", "lift_persistence")}, accuracy > persistence AS beats_persistence FROM v""",
    "auc_rank": f"WITH s AS (SELECT quality AS y, n_chars AS p FROM labels JOIN documents USING (doc_id)), {AREA.format(key='1', source='s')} SELECT {r('auc')} FROM a",
    "regime_breakdown": f"""WITH RECURSIVE {REGIMES}, {TARGET}, {LABELLED_Y}, {SC},
c AS (SELECT regime, COUNT(*) AS n, AVG(y) AS positive_rate, AVG(((p >= 0.5) = (y = 1))::INT) AS accuracy, COUNT(*) FILTER (p < 0.5 AND y = 0) AS tn, COUNT(*) FILTER (p >= 0.5 AND y = 0) AS fp,
  COUNT(*) FILTER (p < 0.5 AND y = 1) AS fn, COUNT(*) FILTER (p >= 0.5 AND y = 1) AS tp FROM sc JOIN (SELECT series_id, ts, regime FROM lab) USING (series_id, ts) WHERE regime IS NOT NULL GROUP BY regime)
SELECT regime, n, {r("n * 100.0 / (SELECT COUNT(*) FROM sc)", "share_pct")}, {rs("positive_rate", "accuracy")}, {r(MCC.format(other="NULL"), "mcc")} FROM c""",
    "cost_sensitivity": f"""WITH {SCORED}, {HELD}, t AS (SELECT SUM(pos * fwd) AS gross, SUM(turn) AS flips FROM h), g AS (SELECT UNNEST([0.0, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0])::DOUBLE AS cost_bps)
SELECT cost_bps, {r("gross * 100", "gross_pct")}, {r("flips")}, {r("(gross - flips * cost_bps / 1e4) * 100", "net_pct")}, {r("CASE WHEN flips > 0 THEN gross / flips * 1e4 END", "break_even_bps")} FROM t, g""",
    "directional_strategy": f"""WITH {SCORED}, {HELD}, v AS (SELECT pos * fwd AS g, turn, turn * 1.0 / 1e4 AS k, pos * fwd - turn * 1.0 / 1e4 AS net FROM h)
SELECT COUNT(*) AS n, {r("SUM(g) * 100", "gross_pct")}, {r("SUM(net) * 100", "net_pct")}, {r("SUM(k) * 100", "cost_pct")}, {r("AVG((g > 0)::INT)", "hit_rate")}, COUNT(*) FILTER (turn > 0) AS position_flips,
  {r("COUNT(*) FILTER (turn > 0) / (COUNT(*) / 25.0)", "flips_per_session")}, {r("AVG(net) / NULLIF(STDDEV_POP(net), 0) * SQRT(6250)", "sharpe")}, {r("AVG(net) * 6250 * 100", "annual_net_pct")} FROM v""",
    "persistence_agreement": f"WITH {SCORED} SELECT COUNT(*) AS n, {r('AVG(((p >= 0.5) = (ret_1 > 0))::INT)', 'agreement')} FROM sc",
    "hmm_filter_fixed": f"WITH RECURSIVE {filter_sql()} SELECT series_id, ts, {rs('p0', 'p1', 'p2', 'p3')} FROM fr",
    "regime_columns": f"WITH RECURSIVE {REGIMES} SELECT series_id, ts, {REGIMES_OUT}, (regime <> LAG(regime) OVER {W}) AND regime IS NOT NULL AS regime_changed FROM lab",
    "regime_runs": f"""WITH RECURSIVE {REGIMES}, s AS (SELECT *, COALESCE(regime <> LAG(regime) OVER {W}, TRUE)::INT AS fresh FROM lab), m AS (SELECT *, SUM(fresh) OVER {W} AS run_id FROM s WHERE regime IS NOT NULL)
SELECT series_id, run_id::BIGINT AS run_id, regime, MIN(ts) AS first_ts, MAX(ts) AS last_ts, COUNT(*) AS n_bars FROM m GROUP BY ALL""",
    "regime_changed": f"WITH RECURSIVE {REGIMES} SELECT series_id, ts, regime, (regime <> LAG(regime) OVER {W}) AND regime IS NOT NULL AS changed FROM lab",
    "daily_shares": f"WITH RECURSIVE {REGIMES} SELECT {DAY} AS period, {SHARE} FROM lab WHERE regime IS NOT NULL GROUP BY period",
    "daily_dominant": f"""WITH RECURSIVE {REGIMES}, c AS (SELECT {DAY} AS period, arg_max(close, (ts, series_id)) AS close, COUNT(*) FILTER (regime = 'bull') AS a, COUNT(*) FILTER (regime = 'bear') AS b,
  COUNT(*) FILTER (regime = 'sideways') AS s, COUNT(*) FILTER (regime = 'high_vol') AS v FROM lab WHERE regime IS NOT NULL GROUP BY period)
SELECT period, {r("close")}, CASE GREATEST(a, b, s, v) WHEN a THEN 'bull' WHEN b THEN 'bear' WHEN s THEN 'sideways' ELSE 'high_vol' END AS dominant FROM c""",
    "overall_shares": f"WITH RECURSIVE {REGIMES} SELECT regime, COUNT(*) AS n, {r('COUNT(*) * 100.0 / SUM(COUNT(*)) OVER ()', 'share_pct')} FROM lab WHERE regime IS NOT NULL GROUP BY regime",
    "hmm_scaler": f"""WITH {BARS}, {RETURNS}, ok AS (SELECT * FROM ret WHERE ret_1 IS NOT NULL AND ret_20 IS NOT NULL)
SELECT 'ret_1' AS column_name, {r("AVG(ret_1)", "mean")}, {r("STDDEV_POP(ret_1)", "std")}, COUNT(*) AS n_rows FROM ok
UNION ALL SELECT 'ret_20', {r("AVG(ret_20)", "mean")}, {r("STDDEV_POP(ret_20)", "std")}, COUNT(*) FROM ok""",
    "state_stats": f"""WITH RECURSIVE {REGIMES}, x AS (SELECT lab.*, atr_pct, adx_14 FROM lab JOIN ({ATR}) USING (series_id, ts) JOIN ({ADX}) USING (series_id, ts))
SELECT regime, COUNT(*) AS n, {r("AVG(ret_1)", "mean_ret_1")}, {r("AVG(ret_20)", "mean_ret_20")}, {r("AVG(atr_pct)", "mean_atr_pct", 4)}, {r("AVG(adx_14)", "mean_adx_14", 4)}, {r("COUNT(*) / SUM(COUNT(*)) OVER ()", "share")}
FROM x WHERE regime IS NOT NULL GROUP BY regime""",
    "transition_table": f"""WITH RECURSIVE {REGIMES}, m AS (SELECT regime AS from_regime, LEAD(regime) OVER {W} AS to_regime FROM lab WHERE regime IS NOT NULL),
c AS (SELECT from_regime, to_regime, COUNT(*) AS n FROM m WHERE to_regime IS NOT NULL GROUP BY ALL), q AS (SELECT *, n / SUM(n) OVER (PARTITION BY from_regime) AS p FROM c)
SELECT from_regime, to_regime, n, {r("p")}, {r("CASE WHEN from_regime = to_regime AND p < 1 THEN 1 / (1 - p) END", "expected_bars")} FROM q""",
    "known_period_check": f"""WITH RECURSIVE {REGIMES}, e(period, want) AS (VALUES ('2024-01-05', 'bull'), ('2024-01-10', 'sideways'), ('2024-01-15', 'high_vol'), ('2024-01-20', 'bear')),
c AS (SELECT {DAY} AS period, regime, COUNT(*) AS n FROM lab WHERE regime IS NOT NULL GROUP BY ALL), t AS (SELECT period, arg_max(regime, (n, regime)) AS regime, MAX(n) AS n, SUM(n) AS total FROM c JOIN e USING (period) GROUP BY period)
SELECT period, regime, {r("n * 100.0 / total", "share_pct")}, regime = want AS ok FROM t JOIN e USING (period)""",
    "rsi_summary": f"""WITH a AS (SELECT 'train' AS split, * FROM ({RSI}) WHERE ts < TIMESTAMP '{SPLIT_AT}' UNION ALL SELECT 'test', * EXCLUDE (rsi_is_warmup), ({missing(VALUES["rsi"])}) FROM ({warm(RSI, 1250)}) WHERE ts >= TIMESTAMP '{SPLIT_AT}'),
l AS ({" UNION ALL ".join(f"SELECT split, '{c}' AS feature, {c} AS x FROM a" for c in ("rsi_7", "rsi_14", "rsi_21", "rsi_14_chg", "rsi_spread_7_21"))}),
f AS ({" UNION ALL ".join(f"SELECT split, '{n}' AS feature, {c}::INT * 100.0::DOUBLE AS x FROM a" for c, n in (("rsi_14_overbought", "overbought_pct"), ("rsi_14_oversold", "oversold_pct"), ("rsi_is_warmup", "warmup_pct")))})
SELECT feature, split, COUNT(x) AS n, {r("AVG(x)", "mean", 4)}, {r("STDDEV_SAMP(x)", "std", 4)}, {r("MIN(x)", "min", 4)}, {r("MEDIAN(x)", "median", 4)}, {r("MAX(x)", "max", 4)} FROM l GROUP BY ALL
UNION ALL SELECT feature, split, NULL, {r("AVG(x)", "mean", 4)}, NULL, NULL, NULL, NULL FROM f GROUP BY ALL""",
    "rsi_export": f"""WITH s AS (WITH {SESSION_COLUMNS} SELECT sec.*, open, high, low, close FROM sec JOIN bars USING (series_id, ts))
SELECT s.series_id, s.ts, session_date, bar_of_day, {rs("open", "high", "low", "close")}, x.* EXCLUDE (series_id, ts) FROM s JOIN ({RSI.replace(BARS, BARS.replace("bars AS", "bars1 AS", 1) + ", bars AS (SELECT * FROM bars1 WHERE strftime(ts, '%H:%M') BETWEEN '09:15' AND '15:15')")}) x USING (series_id, ts)""",
    "regime_export": f"WITH RECURSIVE {REGIMES} SELECT series_id, ts, {DAY} AS session_date, {r('close')}, {REGIMES_OUT}, (regime <> LAG(regime) OVER {W}) AND regime IS NOT NULL AS regime_changed FROM lab",
    "latest_windows": f"WITH {USABLE} SELECT series_id, ts, (rn - 1)::BIGINT AS row_index, {r('y')} FROM wi WHERE window_ok ORDER BY ts DESC, series_id LIMIT 1000",
    "scaled_returns": f"""WITH {USABLE}, g AS (SELECT series_id, rn FROM wi WHERE window_ok), e AS (SELECT u.ret_1, u.ret_20 FROM g JOIN wi u ON u.series_id = g.series_id AND u.rn BETWEEN g.rn - 31 AND g.rn),
z AS (SELECT AVG(ret_1) AS m1, STDDEV_POP(ret_1) AS s1, AVG(ret_20) AS m2, STDDEV_POP(ret_20) AS s2 FROM e)
SELECT series_id, ts, {r("((ret_1 - m1) / s1)::FLOAT", "ret_1", 4)}, {r("((ret_20 - m2) / s2)::FLOAT", "ret_20", 4)} FROM wi, z""",
    "metrics_by_model": f"""WITH RECURSIVE {METRICS_BY_MODEL} SELECT model, part, n, {rs("accuracy", "persistence")}, {r("accuracy - persistence", "lift_persistence")}, accuracy > persistence AS beats_persistence, {r("auc")},
  {r(MCC.format(other=0), "mcc")}, {r("CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END", "f1")}, {r("CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END", "precision")},
  {r("CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END", "recall")}, {rs("brier", "threshold")}, {r("(tp + fp) / n::DOUBLE", "predicted_up_rate")}, tp, fp, tn, fn FROM mm""",
    "verdict": f"""WITH RECURSIVE {METRICS_BY_MODEL} SELECT arg_max(model, accuracy) AS model, {r("MAX(accuracy)", "accuracy")}, arg_max(accuracy > persistence, accuracy) AS beats_persistence FROM mm WHERE part = 'val'""",
    "breakdown_by_model": f"""WITH RECURSIVE {RULES}, v AS (SELECT * FROM ml WHERE part = 'val'), c AS (SELECT model, regime, COUNT(*) AS n, AVG(y) AS positive_rate, AVG(((p >= threshold) = (y = 1))::INT) AS accuracy,
  COUNT(*) FILTER (p < threshold AND y = 0) AS tn, COUNT(*) FILTER (p >= threshold AND y = 0) AS fp, COUNT(*) FILTER (p < threshold AND y = 1) AS fn, COUNT(*) FILTER (p >= threshold AND y = 1) AS tp FROM v WHERE regime IS NOT NULL GROUP BY ALL)
SELECT model, regime, n, {r("n * 100.0 / (SELECT COUNT(*) FROM v WHERE v.model = c.model)", "share_pct")}, {rs("positive_rate", "accuracy")}, {r(MCC.format(other="NULL"), "mcc")} FROM c""",
    "strategy_by_model": f"""WITH RECURSIVE {RULES}, {HELD_BY_MODEL}, v AS (SELECT model, pos * fwd AS g, turn, turn * 1.0 / 1e4 AS k, pos * fwd - turn * 1.0 / 1e4 AS net FROM h)
SELECT model, COUNT(*) AS n, {r("SUM(g) * 100", "gross_pct")}, {r("SUM(net) * 100", "net_pct")}, {r("SUM(k) * 100", "cost_pct")}, {r("AVG((g > 0)::INT)", "hit_rate")}, COUNT(*) FILTER (turn > 0) AS position_flips,
  {r("COUNT(*) FILTER (turn > 0) / (COUNT(*) / 25.0)", "flips_per_session")}, {r("AVG(net) / NULLIF(STDDEV_POP(net), 0) * SQRT(6250)", "sharpe")}, {r("AVG(net) * 6250 * 100", "annual_net_pct")} FROM v GROUP BY model""",
    "costs_by_model": f"""WITH RECURSIVE {RULES}, {HELD_BY_MODEL}, t AS (SELECT model, SUM(pos * fwd) AS gross, SUM(turn) AS flips FROM h GROUP BY model), g AS (SELECT UNNEST([0.0, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0])::DOUBLE AS cost_bps)
SELECT model, cost_bps, {r("gross * 100", "gross_pct")}, {r("flips")}, {r("(gross - flips * cost_bps / 1e4) * 100", "net_pct")}, {r("CASE WHEN flips > 0 THEN gross / flips * 1e4 END", "break_even_bps")} FROM t, g""",
    "edge_by_model": f"""WITH RECURSIVE {RULES}, {HELD_BY_MODEL} SELECT model, {r("AVG(((p >= threshold) = (ret_1 > 0))::INT)", "agreement")}, {r("CASE WHEN SUM(turn) > 0 THEN SUM(pos * fwd) / SUM(turn) * 1e4 END", "break_even_bps")},
  {r("COUNT(*) FILTER (turn > 0) / (COUNT(*) / 25.0)", "flips_per_session")} FROM h GROUP BY model""",
    "predictions_table": f"""WITH RECURSIVE {RULES} SELECT series_id, ts, {r("ANY_VALUE(y)", "y")}, {", ".join(r(f"ANY_VALUE(p) FILTER (model = '{m}')", f"p_{m}") for m in ("momentum", "reversal", "trend"))}, ANY_VALUE(regime) AS regime
FROM ml WHERE part = 'val' GROUP BY series_id, ts""",
    "hmm_smoother_fixed": f"WITH RECURSIVE {smoother_sql()} SELECT series_id, ts, {rs('p0', 'p1', 'p2', 'p3')} FROM sm",
    "hmm_viterbi_fixed": f"WITH RECURSIVE {path_sql()} SELECT series_id, ts, state::INT AS state FROM bt",
    "regimes_warm_start": f"""WITH RECURSIVE {filter_sql("wr", f"{BARS}, {SPLIT_RETURNS}, {WARM_ROWS}")}, n AS (SELECT wr.series_id, wr.ts, p0, p1, p2, p3, {NAMED} AS regime FROM wr LEFT JOIN fr USING (series_id, ts)),
c AS (SELECT *, (regime <> LAG(regime) OVER {W}) AND regime IS NOT NULL AS regime_changed FROM n)
SELECT series_id, ts, {REGIMES_OUT}, regime_changed FROM c WHERE ts >= TIMESTAMP '{SPLIT_AT}'""",
    "state_report": f"""WITH RECURSIVE {path_sql()}, s AS (SELECT state, COUNT(*) AS n, AVG(ret_1) AS a, AVG(ret_20) AS b FROM bt JOIN ret USING (series_id, ts) GROUP BY state)
SELECT state::INT AS state, CASE state {" ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES))} END AS regime, n, {r("n * 100.0 / SUM(n) OVER ()", "share_pct")}, {r("a * 1e4", "mean_ret_1_bps")}, {r("b * 100", "mean_trend_pct")} FROM s""",
    "transition_report": f"""WITH RECURSIVE {REGIMES}, m AS (SELECT regime AS from_regime, LEAD(regime) OVER {W} AS to_regime FROM lab WHERE regime IS NOT NULL),
c AS (SELECT from_regime, to_regime, COUNT(*) AS n FROM m WHERE to_regime IS NOT NULL GROUP BY ALL), q AS (SELECT *, n / SUM(n) OVER (PARTITION BY from_regime) AS p FROM c),
g(from_regime, to_regime, model_p, model_bars) AS (VALUES {", ".join(f"('{NAMES[i]}', '{NAMES[j]}', {x}::DOUBLE, {1 / (1 - row[i])!r}::DOUBLE)" for i, row in enumerate(FIXED_MODEL["transmat"]) for j, x in enumerate(row))})
SELECT from_regime, to_regime, n, {r("p")}, {r("CASE WHEN from_regime = to_regime AND p < 1 THEN 1 / (1 - p) END", "expected_bars")}, {rs("model_p", "model_bars")} FROM q JOIN g USING (from_regime, to_regime)""",
    "model_matrix": f"""SELECT series_id, ts, {", ".join(MODEL_INPUTS)}, ret_1, ret_20, * EXCLUDE (series_id, ts, ret_1, ret_20, {", ".join(n for n, _ in ALL_COLUMNS if n not in ("series_id", "ts"))})
FROM ({MATRIX}) JOIN (SELECT * EXCLUDE (regime) FROM (WITH RECURSIVE {REGIMES} SELECT series_id, ts, {rs("ret_1", "ret_20")}, {REGIMES_OUT} FROM lab)) USING (series_id, ts)""",
    "raw_csv_bars": f"""WITH {SESSION_COLUMNS.replace(BARS, ALL)} SELECT series_id, ts, {rs("open", "high", "low", "close")}, {r("n_ticks", "src_pivot")}, session_date, bar_of_day, is_session_open, is_session_close
FROM sec JOIN bars USING (series_id, ts)""",
    "incremental_features": MATRIX,
    "raw_csv_rejects": f"""WITH {ALL}, n AS (SELECT 2 * COUNT(*) AS n_all, COUNT(*) FILTER (hour(ts) = 10) AS n_word, COUNT(*) FILTER (hour(ts) = 11) AS n_date FROM bars)
SELECT * FROM (SELECT 'read' AS outcome, n_all::BIGINT AS n_lines FROM n UNION ALL SELECT 'low', n_word::BIGINT FROM n UNION ALL SELECT 'time', n_date::BIGINT FROM n) WHERE n_lines > 0""",
    "stored_splits": f"""WITH a AS ({RSI}), b AS ({warm(RSI, 1250)}) SELECT 'train' AS split, a.series_id, a.ts, {r("x.close", "close")}, rsi_14, rsi_is_warmup FROM a JOIN (WITH {BARS} SELECT * FROM bars) x USING (series_id, ts) WHERE a.ts < TIMESTAMP '{SPLIT_AT}'
UNION ALL SELECT 'test', b.series_id, b.ts, {r("x.close", "close")}, rsi_14, ({missing(VALUES["rsi"])}) FROM b JOIN (WITH {BARS} SELECT * FROM bars) x USING (series_id, ts) WHERE b.ts >= TIMESTAMP '{SPLIT_AT}'""",
    "stored_regimes": f"WITH RECURSIVE {REGIMES} SELECT series_id, ts, regime, {r(TOP, 'regime_confidence')} FROM lab",
    "stored_classifier": f"WITH {USABLE}, {PARTS} SELECT part, COUNT(*) AS n, 0::BIGINT AS n_other FROM p GROUP BY part",
    "stream_indicators": f"""SELECT a.series_id, a.ts, a.rsi_7, a.rsi_14, a.rsi_21, e.ema_12, f.p0, f.p1, f.p2, f.p3 FROM ({RSI}) a
JOIN (WITH RECURSIVE {BARS}, {ema('rec', 'bars', {'ema_12': ('close', 12)})} SELECT series_id, ts, {rs('ema_12')} FROM rec) e USING (series_id, ts)
LEFT JOIN (WITH RECURSIVE {filter_sql()} SELECT series_id, ts, {rs('p0', 'p1', 'p2', 'p3')} FROM fr) f USING (series_id, ts)""",
    "stream_bars": f"WITH {BARS} SELECT {BARS_OUT} FROM bars",
    "stream_average": f"""WITH RECURSIVE t AS MATERIALIZED (SELECT event_type AS series_id, value AS x, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS r FROM events WHERE value IS NOT NULL),
q AS (SELECT series_id, r, x::DOUBLE AS y FROM t WHERE r = 0 UNION ALL SELECT t.series_id, t.r, q.y + {2.0 / 13!r}::DOUBLE * (t.x - q.y) FROM q JOIN t ON t.series_id = q.series_id AND t.r = q.r + 1)
SELECT series_id, MAX(r) + 1 AS n, {r("arg_max(y, r)", "last_average")} FROM q GROUP BY series_id""",
}
ORACLES["stored_scaler"] = ORACLES["scaler_stats"]
ORACLES["stored_predictions"] = ORACLES["predictions_table"]
ORACLES["state_names"] = f"""WITH s AS ({ORACLES["state_stats"]}), v AS (SELECT regime FROM s ORDER BY mean_atr_pct DESC, regime LIMIT 1),
o AS (SELECT regime, ROW_NUMBER() OVER (ORDER BY mean_ret_20 DESC, regime) AS k FROM s WHERE regime NOT IN (FROM v))
SELECT regime, 'high_vol' AS name FROM v UNION ALL SELECT regime, ['bull', 'sideways', 'bear'][k] FROM o"""
