"""Simulators over the quote view, grids and walk-forward runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.operators import evaluation as E
from tidebook.operators import features as X
from tidebook.operators import simulators as S
from tidebook.sources import views as V

from .registry import query, rounded, shown
from .relations import _M, mids

TRADE = ("symbol", "date", "param_id", "entry_seq", "exit_seq", "hold_packets", "direction", "exit_method")
GRID = [S.Taker(threshold=t, cooldown=2, max_hold=h, stop_ticks=s) for t in (0.05, 0.1) for h in (5, 15) for s in (100.0, 400.0)]
MAKERS = [S.Maker(threshold=t, cooldown=1, max_hold=h, order_timeout=4) for t in (0.05, 0.1) for h in (5, 15)]


def _signals(spark, d):
    return X.microprice(mids(spark, d)).withColumnRenamed("micro_deviation", "signal")


_TAKER = (
    _M
    + """, s AS (SELECT symbol, date, seq, mid, (bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty + 1e-9::DOUBLE) - mid AS sig, row_number() OVER (PARTITION BY symbol, date ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY symbol, date) AS n FROM m),
    g AS (SELECT * FROM (VALUES (0, 0.05::DOUBLE, 5, 100), (1, 0.05::DOUBLE, 5, 400), (2, 0.05::DOUBLE, 15, 100), (3, 0.05::DOUBLE, 15, 400), (4, 0.1::DOUBLE, 5, 100), (5, 0.1::DOUBLE, 5, 400), (6, 0.1::DOUBLE, 15, 100), (7, 0.1::DOUBLE, 15, 400)) t(param_id, thr, hold, stop)),
    r AS (SELECT symbol, date, param_id, thr, hold, stop, i, n, CASE WHEN abs(sig) >= thr THEN (CASE WHEN sig > 0 THEN 1 ELSE -1 END) ELSE 0 END AS dir, i AS t0, seq AS eseq, mid + (CASE WHEN sig > 0 THEN 1 ELSE -1 END) * 0.05::DOUBLE AS price, -3::BIGINT AS last_exit,
        NULL::BIGINT AS xat, NULL::BIGINT AS xseq, NULL::BIGINT AS xeseq, NULL::INT AS xdir, NULL::DOUBLE AS xin, NULL::DOUBLE AS xout, NULL::VARCHAR AS why FROM s, g WHERE i = 0
      UNION ALL SELECT symbol, date, param_id, thr, hold, stop, i, n,
        CASE WHEN dir <> 0 THEN CASE WHEN why2 IS NULL THEN dir ELSE 0 END WHEN i - last_exit > 2 AND abs(sig) >= thr THEN (CASE WHEN sig > 0 THEN 1 ELSE -1 END) ELSE 0 END,
        CASE WHEN dir <> 0 THEN t0 ELSE i END, CASE WHEN dir <> 0 THEN eseq ELSE seq END, CASE WHEN dir <> 0 THEN price ELSE mid + (CASE WHEN sig > 0 THEN 1 ELSE -1 END) * 0.05::DOUBLE END,
        CASE WHEN why2 IS NOT NULL THEN i ELSE last_exit END,
        CASE WHEN why2 IS NOT NULL THEN i - t0 END, CASE WHEN why2 IS NOT NULL THEN seq END, CASE WHEN why2 IS NOT NULL THEN eseq END, CASE WHEN why2 IS NOT NULL THEN dir END, CASE WHEN why2 IS NOT NULL THEN price END, CASE WHEN why2 IS NOT NULL THEN mid - dir * 0.05::DOUBLE END, why2
      FROM (SELECT r.symbol, r.date, r.param_id, r.thr, r.hold, r.stop, s.i, s.n, s.seq, s.mid, s.sig, r.dir, r.t0, r.eseq, r.price, r.last_exit,
        CASE WHEN r.dir <> 0 THEN CASE WHEN s.i - r.t0 >= r.hold THEN 'max_hold' WHEN r.dir * (s.mid - r.price) < -r.stop * 0.05::DOUBLE THEN 'stop' WHEN s.i = s.n - 1 THEN 'eod' END END AS why2
        FROM r JOIN s ON s.symbol = r.symbol AND s.date = r.date AND s.i = r.i + 1)),
    x AS (SELECT symbol, date, param_id, xeseq AS entry_seq, xseq AS exit_seq, xat::INT AS hold_packets, xdir AS direction, xin AS entry_price, xout AS exit_price, why AS exit_method FROM r WHERE why IS NOT NULL
      UNION ALL SELECT symbol, date, param_id, eseq, eseq, 0, dir, price, (price - dir * 0.05::DOUBLE) - dir * 0.05::DOUBLE, 'eod' FROM r WHERE dir <> 0 AND i = n - 1)"""
)
#: The same trades with 550 a lot, gross, charges and net, and results by day and by set.
_RESULTS = _TAKER + """, g1 AS (SELECT *, direction * (exit_price - entry_price) * 550 AS gross_pnl, 550 * CASE WHEN direction > 0 THEN entry_price ELSE exit_price END AS buy, 550 * CASE WHEN direction > 0 THEN exit_price ELSE entry_price END AS sell FROM x),
    g2 AS (SELECT *, (2 * 20.0::DOUBLE + (0.00002::DOUBLE + 0.000001::DOUBLE) * (buy + sell)) * (1 + 0.18::DOUBLE) + 0.000125::DOUBLE * sell + 0.00002::DOUBLE * buy AS fee FROM g1),
    tr AS (SELECT *, gross_pnl - fee AS net_pnl FROM g2)"""


def _summary_sql(by: str, source: str = "tr") -> str:
    """CTEs up to sm, the rows of evaluation.run_summary of source by the named columns."""
    return f""", dd AS (SELECT {by}, date, count(*) AS k, sum(net_pnl) AS net, sum(gross_pnl) AS gross, sum(fee) AS fees, count(CASE WHEN net_pnl > 0 THEN 1 END) AS wins FROM {source} GROUP BY ALL),
    dc AS (SELECT *, sum(net) OVER (PARTITION BY {by} ORDER BY date) AS cum FROM dd), dw AS (SELECT *, cum - max(cum) OVER (PARTITION BY {by} ORDER BY date) AS down FROM dc),
    sm AS (SELECT {by}, sum(k)::BIGINT AS n_trades, sum(net) AS net, sum(gross) AS gross, sum(fees) AS fees, sum(wins) / sum(k) AS win_rate, CASE WHEN count(*) >= 2 THEN avg(net) / (stddev_samp(net) + 1e-9::DOUBLE) * sqrt(252) END AS sharpe, min(down) AS max_drawdown FROM dw GROUP BY ALL)"""


@query(_TAKER + " SELECT symbol, date, param_id, entry_seq, exit_seq, hold_packets, direction, exit_method, round(entry_price, 4) + 0.0 AS entry_price, round(exit_price, 4) + 0.0 AS exit_price FROM x")
def e1_taker(spark, d):
    return shown(S.backtest(_signals(spark, d), GRID), TRADE, "entry_price", "exit_price", digits=4)


@query()
def e2_maker(spark, d):
    return shown(S.backtest(_signals(spark, d), MAKERS), TRADE, "entry_price", "exit_price", "gross_pnl", "fee", "net_pnl", digits=4)


def _arms(spark, d):
    arms = spark.createDataFrame([("control", ["click", "view"]), ("expanded", ["click", "error", "purchase", "signup", "view"])], "arm string, universe array<string>")
    return V.quotes(spark, d).join(F.broadcast(arms.select("arm", F.explode("universe").alias("symbol"))), "symbol")


@query()
def e3_broker(spark, d):
    p = S.Strategy(entry_threshold=0.05, max_hold=20, min_hold=2, order_timeout=4, edge_margin=0.1, queue_fill=0.0, last_entry=1440)
    return shown(S.broker(_arms(spark, d), p), ("arm", "date", "symbol", "exit_seq", "direction", "exit_method", "hold_packets"), "entry_price", "exit_price", "gross_pnl", "fee", "net_pnl", digits=4)


@query()
def e4_day_risk(spark, d):
    """The same under a limit that all symbols of an arm share: no new entries once it is met."""
    p = S.Strategy(entry_threshold=0.05, max_hold=20, min_hold=2, order_timeout=4, edge_margin=0.1, queue_fill=0.0, last_entry=1440)
    t = S.broker(_arms(spark, d), p, limit=-20_000.0)
    return shown(t.groupBy("arm", "date").agg(F.count("*").alias("n"), F.sum("net_pnl").alias("net")), ("arm", "date", "n"), "net", digits=2)


@query()
def e12_live_positions(spark, d):
    """What each arm holds at noon of each day: positions, their open result, what is pending."""
    p = S.Strategy(entry_threshold=0.05, max_hold=20, min_hold=2, order_timeout=4, edge_margin=0.1, queue_fill=0.0, last_entry=1440)
    rows = S.broker_positions(_arms(spark, d).filter(F.hour("ts") < 12), p, limit=-20_000.0)
    return shown(rows, ("arm", "date", "symbol", "seq", "packet_at", "direction", "qty", "pending_entry", "pending_exit", "posts", "fills", "cancels", "trades", "halted"), "entry_price", "last_mid", "unrealized", "realized", "day_net", digits=4)


@query()
def e6_fill_haircut(spark, d):
    p = S.Strategy(entry_threshold=0.05, max_hold=20, min_hold=2, order_timeout=4, edge_margin=0.1, queue_fill=0.0, last_entry=1440, stop_ticks=0)
    return shown(S.haircut(V.quotes(spark, d), p), ("symbol", "date"), "touch_net", "queue_net", "haircut", "haircut_pct", digits=2)


@query()
def e5_replay(spark, d):
    """A replay of each symbol's day: trades, net, the share of maker exits, and net by exit."""
    p = S.Strategy(entry_threshold=0.05, max_hold=20, min_hold=2, order_timeout=4, edge_margin=0.1, queue_fill=0.0, last_entry=1440)
    t = S.broker(V.quotes(spark, d).withColumn("arm", F.col("symbol")), p)
    kinds = ("maker_exit", "taker_stop", "taker_max_hold", "taker_reversal", "taker_eod")
    return shown(S.replay_summary(t.drop("symbol").withColumnRenamed("arm", "symbol"), "symbol", "date"), ("symbol", "date", "n"), "net", "maker_exit_rate", *[f"net_{k}" for k in kinds], digits=2)


@query(_RESULTS + f" SELECT symbol, date, entry_seq, exit_seq, exit_method, {rounded('entry_price * 550 AS notional', 'hold_packets * 0.4::DOUBLE AS hold_secs', 'net_pnl', digits=2)} FROM tr WHERE param_id = 0")
def e8_trade_log(spark, d):
    """Trades with their notional and seconds held (0.4 a packet)."""
    t = S.backtest(_signals(spark, d), GRID[:1])
    return shown(t.withColumns({"notional": F.col("entry_price") * 550, "hold_secs": F.col("hold_packets") * 0.4}), ("symbol", "date", "entry_seq", "exit_seq", "exit_method"), "notional", "hold_secs", "net_pnl", digits=2)


@query(_RESULTS + ", one AS (SELECT * FROM tr WHERE param_id = 0)" + _summary_sql("symbol", "one") + f" SELECT symbol, n_trades, {rounded('net', 'gross', 'fees', 'win_rate', 'sharpe', 'max_drawdown', digits=3)} FROM sm")
def e9_walk_forward(spark, d):
    """One parameter set over all sessions: daily results and their statistics."""
    out = E.run_summary(S.backtest(_signals(spark, d), GRID[:1]), "symbol")
    return shown(out, ("symbol", "n_trades"), "net", "gross", "fees", "win_rate", "sharpe", "max_drawdown", digits=3)


@query(_RESULTS + _summary_sql("param_id") + f" SELECT param_id, thr AS threshold, hold AS max_hold, stop::DOUBLE AS stop_ticks, n_trades, {rounded('net', 'win_rate', 'sharpe', digits=3)} FROM sm JOIN g USING (param_id)")
def e10_grid_search(spark, d):
    """Every set over every session, the sets ordered by Sharpe, those without one last."""
    sets = S.params_frame(spark, GRID).select("param_id", "threshold", "max_hold", "stop_ticks")
    out = E.run_summary(S.backtest(_signals(spark, d), GRID), "param_id").join(F.broadcast(sets), "param_id")
    return shown(out, ("param_id", "threshold", "max_hold", "stop_ticks", "n_trades"), "net", "win_rate", "sharpe", digits=3).orderBy(F.desc_nulls_last("sharpe"), "param_id")


#: Fixed days that part the training from the test sessions.
FIRST_TEST_DAY = "2024-01-23"


@query(
    _RESULTS
    + f", lb AS (SELECT *, CASE WHEN date < DATE '{FIRST_TEST_DAY}' THEN 'train' ELSE 'test' END AS part FROM tr WHERE param_id = 0)"
    + _summary_sql("part", "lb")
    + f" SELECT part, n_trades, {rounded('net', 'gross', 'fees', 'win_rate', 'sharpe', digits=3)} FROM sm"
)
def e11_train_test(spark, d):
    """A fixed parameter set on fixed training days and on the test days after them."""
    t = S.backtest(_signals(spark, d), GRID[:1])
    t = t.withColumn("part", F.when(F.col("date") < F.lit(FIRST_TEST_DAY).cast("date"), "train").otherwise("test"))
    return shown(E.run_summary(t, "part"), ("part", "n_trades"), "net", "gross", "fees", "win_rate", "sharpe", digits=3)
