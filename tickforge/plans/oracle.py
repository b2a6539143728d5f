"""DuckDB twins of the queries: plain SQL over the same tables, written from the definitions and sharing no code with them."""

from __future__ import annotations

TICKS = """
e AS (SELECT event_id, ts, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
e2 AS MATERIALIZED (SELECT *, CAST(4000 AS DOUBLE) + CAST(0.25 AS DOUBLE) * CAST(sum(k % 9 - 4) OVER (ORDER BY ts, event_id) AS DOUBLE) AS price, CAST(1 + event_id % 2 AS DOUBLE) AS s,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type IN ('click', 'view') THEN -1 ELSE 0 END AS side FROM e),
ticks AS (SELECT event_id AS record_num, ts, price, CASE side WHEN 1 THEN price - s WHEN -1 THEN price ELSE price - s / 2 END AS level_low,
       CASE side WHEN 1 THEN price WHEN -1 THEN price + s ELSE price + s / 2 END AS level_high, k + 1 AS txn_count, side AS direction, side * (k + 1) AS volume_delta,
       CAST(ts - INTERVAL 18 HOUR AS DATE) AS session_date FROM e2)"""


def bars(width: str) -> str:
    """CTEs up to bars: every bar column and bar_seq."""
    seconds = {"1 day": 86400, "1 hour": 3600, "30 minutes": 1800, "1 minute": 60}[width]
    return f"""{TICKS},
tb AS (SELECT *, time_bucket(INTERVAL '{width}', ts) AS bar_time FROM ticks),
isl AS (SELECT bar_time, direction, row_number() OVER (PARTITION BY bar_time ORDER BY ts, record_num) - row_number() OVER (PARTITION BY bar_time, direction ORDER BY ts, record_num) AS g FROM tb),
rn AS (SELECT bar_time, coalesce(max(CASE WHEN direction = 1 THEN n END), 0) AS max_buy_run, coalesce(max(CASE WHEN direction = -1 THEN n END), 0) AS max_sell_run
       FROM (SELECT bar_time, direction, g, count(*) AS n FROM isl GROUP BY ALL) GROUP BY bar_time),
b0 AS MATERIALIZED (SELECT bar_time, arg_min(price, (ts, record_num)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, record_num)) AS close, CAST(sum(txn_count) AS BIGINT) AS volume, count(*) AS num_events,
       CAST(sum(CASE WHEN direction = 1 THEN txn_count ELSE 0 END) AS BIGINT) AS buy_volume, CAST(sum(CASE WHEN direction = -1 THEN txn_count ELSE 0 END) AS BIGINT) AS sell_volume,
       avg(CASE WHEN level_high - level_low >= 2 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS wide_spread_frac, max(txn_count) AS max_single_txn,
       coalesce(max(CASE WHEN direction = 1 THEN txn_count END), 0) AS max_single_buy, coalesce(max(CASE WHEN direction = -1 THEN txn_count END), 0) AS max_single_sell,
       sum(price * txn_count) AS price_volume FROM tb GROUP BY bar_time),
bars AS MATERIALIZED (SELECT b0.*, CAST(buy_volume - sell_volume AS DOUBLE) / nullif(volume, 0) AS flow_imbalance, num_events / CAST({seconds} AS DOUBLE) AS intensity, price_volume / nullif(volume, 0) AS vwap,
       max_buy_run, max_sell_run, row_number() OVER (ORDER BY bar_time) - 1 AS bar_seq FROM b0 JOIN rn USING (bar_time))"""


ROUND = 6


def r(x: str, name: str) -> str:
    return f"round({x}, {ROUND}) + 0.0 AS {name}"


def full(agg: str, x: str, n: int) -> str:
    over = f"OVER (ORDER BY bar_seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {agg}({x}) {over} END"


def change(x: str, n: int) -> str:
    return f"({x} / nullif(lag({x}, {n}) OVER (ORDER BY bar_seq), 0) - 1)"


def tr() -> str:
    last = "lag(close) OVER (ORDER BY bar_seq)"
    return f"greatest(high - low, abs(high - {last}), abs(low - {last}))"


def atr(n: int) -> str:
    return f"avg(tr) OVER (ORDER BY bar_seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def feature_ctes(width: str) -> str:
    """bars, f1 (true range, first microstructure), f2 (ATRs, stop distance)."""
    return f"""{bars(width)},
f1 AS (SELECT *, {tr()} AS tr, buy_volume - sell_volume AS delta, high - low AS bar_range, sign(close - open) AS price_direction, sign(buy_volume - sell_volume) AS delta_direction,
       volume / greatest((high - low) / 0.25, CAST(1 AS DOUBLE)) AS vol_per_tick, CAST(sum(buy_volume - sell_volume) OVER (ORDER BY bar_seq) AS BIGINT) AS cvd, {change('close', 1)} AS return_1 FROM bars),
f2 AS MATERIALIZED (SELECT *, {atr(5)} AS atr_5, {atr(14)} AS atr_14, CAST(round_even(CAST(least(greatest({atr(14)} * 1.5, 2.0), 8.0) AS DOUBLE) / 0.25, 0) AS DOUBLE) * 0.25 AS sl_points FROM f1)"""


ET = "timezone('America/New_York', timezone('UTC', bar_time))"
RTH = f"(hour({ET}) * 100 + minute({ET})) BETWEEN 930 AND 1529"
CLOSING = f"(hour({ET}) = 15 AND minute({ET}) >= 25)"


def outcome(side: str) -> str:
    """First touch by range self-join: (bar_seq, side_done, side_result, ...)."""
    good, bad = ("p.high - c.close", "c.close - p.low") if side == "long" else ("c.close - p.low", "p.high - c.close")
    lost = "p.low <= c.close - c.sl_points" if side == "long" else "p.high >= c.close + c.sl_points"
    won = "p.high >= c.close + c.sl_points * 1.5" if side == "long" else "p.low <= c.close - c.sl_points * 1.5"
    return f"""
{side}_x AS (SELECT c.bar_seq, min(CASE WHEN {lost} OR {won} THEN p.bar_seq END) AS x, arg_min(CASE WHEN {lost} THEN -1 ELSE 1 END, p.bar_seq) FILTER (WHERE {lost} OR {won}) AS res
       FROM f2 c JOIN f2 p ON p.bar_seq > c.bar_seq AND p.bar_seq <= c.bar_seq + 60 GROUP BY c.bar_seq),
{side}_m AS (SELECT c.bar_seq, greatest(max({bad}), 0) AS mae, greatest(max({good}), 0) AS mfe FROM f2 c JOIN {side}_x x USING (bar_seq) JOIN f2 p ON p.bar_seq > c.bar_seq AND p.bar_seq <= coalesce(x.x, c.bar_seq + 60) GROUP BY c.bar_seq)"""


def barrier_ctes(width: str) -> str:
    cols = ", ".join(f"CAST(coalesce({s}_x.res, 0) AS INTEGER) AS {s}_result, CAST(coalesce({s}_x.x - f2.bar_seq, 60) AS INTEGER) AS {s}_bars_held, CAST(coalesce({s}_m.mae, 0) AS FLOAT) AS {s}_mae, CAST(coalesce({s}_m.mfe, 0) AS FLOAT) AS {s}_mfe" for s in ("long", "short"))
    joins = " ".join(f"LEFT JOIN {s}_x ON {s}_x.bar_seq = f2.bar_seq LEFT JOIN {s}_m ON {s}_m.bar_seq = f2.bar_seq" for s in ("long", "short"))
    return f"""{feature_ctes(width)}, {outcome('long')}, {outcome('short')},
tbar AS (SELECT f2.*, sl_points * 1.5 AS tp_points, {cols} FROM f2 {joins})"""


def zones_ctes(width: str, volume: int) -> str:
    """zones by a recursive walk over bars with their best length."""
    ok = [f"(count(*) OVER w{n} = {n} AND avg(volume) OVER w{n} >= {volume})" for n in range(5, 11)]
    case = "CASE " + " ".join(f"WHEN NOT {x} THEN {n - 1 if n > 5 else 0}" for n, x in zip(range(5, 11), ok, strict=True)) + " ELSE 10 END"
    win = ", ".join(f"w{n} AS (ORDER BY bar_seq ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for n in range(5, 11))
    return f"""{bars(width)},
best AS MATERIALIZED (SELECT bar_seq, {case} AS len FROM bars WINDOW {win}),
nx AS MATERIALIZED (SELECT a.bar_seq AS s, b.bar_seq AS n FROM (SELECT * FROM best WHERE len > 0) a ASOF LEFT JOIN (SELECT bar_seq FROM best WHERE len > 0) b ON a.bar_seq + a.len <= b.bar_seq),
walk AS (SELECT min(s) AS s FROM nx UNION ALL SELECT n FROM walk JOIN nx USING (s) WHERE n IS NOT NULL),
zones AS MATERIALIZED (SELECT s AS zone_id, s AS start_seq, s + len - 1 AS end_seq FROM walk JOIN best ON s = bar_seq),
zb AS (SELECT zone_id, bars.* FROM zones JOIN bars ON bar_seq BETWEEN start_seq AND end_seq),
zs AS (SELECT zone_id, min(bar_time) AS consol_start, max(bar_time) AS last_bar, count(*) AS consol_bars, max(high) AS consol_high, min(low) AS consol_low, (max(high) - min(low)) / 0.25 AS consol_range_ticks,
       avg(volume) AS consol_avg_vol, max(max_single_buy) AS max_single_buy_pre, max(max_single_sell) AS max_single_sell_pre, CASE WHEN max(max_single_buy) >= max(max_single_sell) THEN 'BUY' ELSE 'SELL' END AS dominant_side_pre,
       greatest(max(max_single_buy), max(max_single_sell)) AS dominant_strength_pre FROM zb GROUP BY zone_id),
vp AS MATERIALIZED (SELECT zone_id, price, CAST(sum(CASE WHEN direction = 1 THEN txn_count ELSE 0 END) AS BIGINT) AS buy_vol, CAST(sum(CASE WHEN direction = -1 THEN txn_count ELSE 0 END) AS BIGINT) AS sell_vol, CAST(sum(txn_count) AS BIGINT) AS total_vol
       FROM tb JOIN (SELECT zone_id, bar_time FROM zb) z USING (bar_time) GROUP BY zone_id, price),
pm0 AS (SELECT zone_id, sum(CASE WHEN price >= (consol_low + consol_high) / 2 THEN total_vol ELSE 0 END) AS top, sum(CASE WHEN price < (consol_low + consol_high) / 2 THEN total_vol ELSE 0 END) AS bottom,
       arg_max(price, (total_vol, -price)) AS poc_price, any_value((consol_low + consol_high) / 2) AS mid, any_value((consol_high - consol_low) / 2) AS half FROM vp JOIN zs USING (zone_id) GROUP BY zone_id),
pm AS (SELECT zone_id, poc_price, CASE WHEN half <= 0 THEN 0 ELSE CAST(least(top, bottom) AS DOUBLE) / greatest(top, bottom) END AS balance, CASE WHEN half <= 0 THEN 0 ELSE greatest(0, 1 - abs(poc_price - mid) / half) END AS poc_centrality FROM pm0)"""


def pattern_ctes(width: str, volume: int, balance: float, target: int, stop: int) -> str:
    step = {"1 hour": "1 HOUR", "30 minutes": "30 MINUTE"}[width]
    up = "dir = 'UP'"
    return f"""{zones_ctes(width, volume)},
bo AS (SELECT zs.*, balance, poc_centrality, b.bar_seq AS bo_seq, b.bar_time AS breakout_time, b.close AS bc, abs(b.close - b.open) / 0.25 AS body, b.volume AS breakout_volume, b.flow_imbalance AS breakout_imbalance, b.vwap AS bvwap,
       CASE WHEN b.close > consol_high THEN 'UP' WHEN b.close < consol_low THEN 'DOWN' END AS dir FROM zs JOIN zones USING (zone_id) JOIN pm USING (zone_id) JOIN bars b ON b.bar_seq = end_seq + 1 WHERE balance >= {balance}),
bo2 AS (SELECT *, CASE WHEN {up} THEN consol_high ELSE consol_low END AS edge FROM bo WHERE dir IS NOT NULL AND body >= 4),
rt AS (SELECT zone_id, dir, bc, consol_high, consol_low, r, max(b.bar_time) AS last_time, min(b.low) AS lo, max(b.high) AS hi, CAST(sum(b.buy_volume) AS BIGINT) AS rb, CAST(sum(b.sell_volume) AS BIGINT) AS rs
       FROM bo2, range(1, 6) t(r) JOIN bars b ON b.bar_seq > bo_seq AND b.bar_seq <= bo_seq + r GROUP BY ALL HAVING count(*) = r),
rt2 AS (SELECT *, CASE WHEN {up} THEN lo ELSE hi END AS extreme, CASE WHEN {up} THEN (bc - lo) / nullif(greatest(bc - consol_low, 0), 0) ELSE (hi - bc) / nullif(greatest(consol_high - bc, 0), 0) END AS pct FROM rt),
rt3 AS (SELECT * FROM rt2 WHERE coalesce(pct, 0) >= 0.5 QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY r) = 1),
md AS (SELECT zone_id, median(total_vol) AS med FROM vp GROUP BY zone_id),
lv AS (SELECT rt3.zone_id, CASE WHEN total_vol < med * 0.5 THEN 'low_activity' WHEN buy_vol + sell_vol > 0 AND CAST(greatest(buy_vol, sell_vol) AS DOUBLE) / (buy_vol + sell_vol) > 0.65 THEN 'high_one_sided' ELSE 'neutral' END AS level_type
       FROM rt3 JOIN vp USING (zone_id) JOIN md USING (zone_id) QUALIFY row_number() OVER (PARTITION BY rt3.zone_id ORDER BY abs(price - extreme), price) = 1),
tn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, record_num) - 1 AS tick_no FROM ticks),
en AS MATERIALIZED (SELECT rt3.*, rt3.last_time + INTERVAL {step} AS entry_time, t.price AS entry_price, t.tick_no AS entry_no FROM rt3 JOIN tn t ON t.tick_no = (SELECT min(tick_no) FROM tn WHERE tn.ts >= rt3.last_time + INTERVAL {step})),
tc AS (SELECT en.zone_id, arg_min(CASE WHEN CASE WHEN {up} THEN t.price >= entry_price + {target} * 0.25 ELSE t.price <= entry_price - {target} * 0.25 END THEN 'success' ELSE 'fail' END, t.tick_no) AS outcome, min(t.tick_no) AS touch_no, arg_min(t.ts, t.tick_no) AS touch_ts
       FROM en JOIN tn t ON t.tick_no > entry_no AND CASE WHEN {up} THEN t.price >= entry_price + {target} * 0.25 OR t.price <= entry_price - {stop} * 0.25 ELSE t.price <= entry_price - {target} * 0.25 OR t.price >= entry_price + {stop} * 0.25 END GROUP BY en.zone_id),
ev AS (SELECT bo2.consol_start, bo2.last_bar + INTERVAL {step} AS consol_end, bo2.consol_bars, bo2.consol_high, bo2.consol_low, bo2.consol_range_ticks, bo2.consol_avg_vol, bo2.balance AS consol_balance_score, bo2.poc_centrality AS consol_poc_centrality,
       bo2.max_single_buy_pre, bo2.max_single_sell_pre, bo2.dominant_side_pre, bo2.dominant_strength_pre, bo2.breakout_time, bo2.dir AS breakout_direction, bo2.bc AS breakout_close, bo2.body AS breakout_body_ticks, bo2.breakout_volume, bo2.breakout_imbalance,
       CASE WHEN abs(bo2.bc - edge) < 1e-9 THEN 0.5 ELSE least(greatest((bvwap - edge) / (bo2.bc - edge), 0), 1) END AS breakout_vwap_position, en.r AS retrace_bars, en.extreme AS retrace_extreme, en.pct AS retrace_pct, level_type AS retrace_level_type,
       en.rb AS retrace_buy_vol, en.rs AS retrace_sell_vol, coalesce(CAST(en.rb - en.rs AS DOUBLE) / nullif(en.rb + en.rs, 0), 0) AS retrace_imbalance, en.entry_price, coalesce(tc.outcome, 'timeout') AS outcome,
       coalesce(touch_no, (SELECT max(tick_no) FROM tn)) - entry_no AS ticks_to_resolve, CAST(epoch_us(coalesce(touch_ts, (SELECT max(ts) FROM tn))) - epoch_us(entry_time) AS DOUBLE) / 1e6 AS seconds_to_resolve
       FROM bo2 JOIN en USING (zone_id) JOIN lv USING (zone_id) LEFT JOIN tc USING (zone_id))"""


def trade_ctes(width: str) -> str:
    """Candidates by range self-joins, the chain by recursion: taken has the trades."""
    hit = lambda c: f"min(CASE WHEN {c} THEN p.bar_seq END)"
    lost = "CASE WHEN c.side = 1 THEN p.low <= c.slp ELSE p.high >= c.slp END"
    won = "CASE WHEN c.side = 1 THEN p.high >= c.tpp ELSE p.low <= c.tpp END"
    return f"""{feature_ctes(width)},
sc AS (SELECT *, (1 + coalesce(flow_imbalance, 0)) / 2 AS pl, (1 - coalesce(flow_imbalance, 0)) / 2 AS ps, {RTH} AS rth, {CLOSING} AS closing FROM f2),
c0 AS (SELECT *, CASE WHEN pl > 0.55 AND pl > ps THEN 1 WHEN ps > 0.55 AND ps > pl THEN -1 ELSE 0 END AS side FROM sc),
c1 AS (SELECT *, close + side * 0.25 AS entry_price, close + side * 0.25 - side * sl_points AS slp, close + side * 0.25 + side * sl_points * 1.5 AS tpp FROM c0 WHERE side <> 0 AND rth AND NOT closing AND 1 - wide_spread_frac >= 0.3),
x0 AS (SELECT c.bar_seq, {hit(lost)} AS sl, {hit(won)} AS tp, {hit('p.closing')} AS eod, c.bar_seq + 60 AS late, (SELECT max(bar_seq) FROM bars) AS last FROM c1 c LEFT JOIN sc p ON p.bar_seq > c.bar_seq AND p.bar_seq <= c.bar_seq + 60 GROUP BY c.bar_seq),
x1 AS (SELECT *, least(coalesce(sl, 1e12), coalesce(tp, 1e12), coalesce(eod, 1e12), late) AS first FROM x0),
x2 AS (SELECT bar_seq, CASE WHEN first > last THEN last ELSE first END AS exit_seq, CASE WHEN first > last THEN 'END' WHEN first = sl THEN 'SL' WHEN first = tp THEN 'TP' WHEN first = eod THEN 'EOD' ELSE 'TIMEOUT' END AS exit_reason FROM x1),
x3 AS MATERIALIZED (SELECT c.*, CAST(x2.exit_seq AS BIGINT) AS exit_seq, exit_reason, p.bar_time AS exit_time, CASE exit_reason WHEN 'SL' THEN slp - side * 0.25 WHEN 'TP' THEN tpp - side * 0.25 WHEN 'END' THEN p.close ELSE p.close - side * 0.25 END AS exit_price
       FROM c1 c JOIN x2 USING (bar_seq) JOIN sc p ON p.bar_seq = x2.exit_seq),
nx AS MATERIALIZED (SELECT a.bar_seq AS s, b.bar_seq AS n FROM (SELECT * FROM x3 WHERE exit_reason <> 'END') a ASOF LEFT JOIN (SELECT bar_seq FROM x3) b ON a.exit_seq <= b.bar_seq),
walk AS (SELECT min(bar_seq) AS s FROM x3 UNION ALL SELECT n FROM walk JOIN nx USING (s) WHERE n IS NOT NULL),
ex AS (SELECT c.bar_seq, greatest(coalesce(max(CASE WHEN c.side = 1 THEN c.entry_price - p.low ELSE p.high - c.entry_price END), 0), 0) AS mae, greatest(coalesce(max(CASE WHEN c.side = 1 THEN p.high - c.entry_price ELSE c.entry_price - p.low END), 0), 0) AS mfe
       FROM x3 c LEFT JOIN sc p ON p.bar_seq > c.bar_seq AND p.bar_seq <= c.exit_seq GROUP BY c.bar_seq),
taken AS MATERIALIZED (SELECT bar_seq, bar_time AS entry_time, exit_time, CASE side WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS direction, entry_price, exit_price, slp AS sl_price, tpp AS tp_price, exit_reason, (exit_price - entry_price) * side AS pnl_points,
       (exit_price - entry_price) * side * 50 - 5 AS pnl_dollars, CAST(exit_seq - bar_seq AS INTEGER) AS bars_held, mae, mfe, exit_seq FROM x3 JOIN ex USING (bar_seq) WHERE bar_seq IN (SELECT s FROM walk)),
dd AS (SELECT *, sum(pnl_dollars) OVER o AS cum_pnl FROM taken WINDOW o AS (ORDER BY exit_time, entry_time)),
dd2 AS (SELECT *, max(cum_pnl) OVER (ORDER BY exit_time, entry_time) AS peak FROM dd)"""
