"""Trades against the mid, and live totals, by hand."""

import datetime as dt

from pyspark.sql import functions as F

from tidebook.operators import marks as M

T0 = dt.datetime(2026, 6, 1, 10, 0)
TRADE = "symbol string, date string, seq long, ts timestamp_ntz, exit_ts timestamp_ntz, direction int, entry_price double, exit_price double, qty int, net_pnl double, fee double"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def quotes(spark):
    mids = [100.0, 100.0, 100.0, 100.0, 100.0, 99.0, 98.0]
    return spark.createDataFrame([("A", "d", at(k), k, m) for k, m in enumerate(mids)], "symbol string, date string, ts timestamp_ntz, seq long, mid double")


def test_markouts_and_results_at_the_mid(spark):
    trades = spark.createDataFrame(
        [
            ("A", "d", 1, at(0), at(3), 1, 99.5, 100.5, 10, 9.0, 1.0),  # bought half below the mid
            ("A", "d", 2, at(1), at(4), -1, 100.0, 100.0, 10, -1.0, 1.0),  # a flat market: the fee is left
            ("A", "d", 3, at(2), at(60), 1, 100.0, 101.0, 10, 9.0, 1.0),  # no mid at the exit
            ("B", "d", 4, at(2), at(3), 1, 100.0, 101.0, 10, 9.0, 1.0),  # no quotes at all
        ],
        TRADE,
    )
    marked = M.trade_markouts(trades, quotes(spark), (0, 5, 30), 5)
    rows = {r["seq"]: r for r in marked.collect()}
    assert len(rows) == 4 and rows[1]["mk_0"] == 0.5 and rows[1]["mk_5"] == -0.5 and rows[1]["mk_30"] is None
    assert rows[2]["mid_entry"] == rows[2]["mid_exit"] == 100.0 and rows[3]["mid_exit"] is None and rows[4]["mid_entry"] is None
    t = M.mark_totals(marked.filter("symbol = 'A'"), "symbol", horizons_s=(0, 5)).first()
    assert t["trades"] == 3 and t["sim_net"] == 17.0 and t["mid_to_mid"] == -2.0 and t["spread_capture"] == 19.0
    assert t["mid_win_rate"] == 0.0 and abs(t["mk_0_rs"] - 5 / 3) < 1e-12
    assert [tuple(r) for r in M.unpriced(trades, quotes(spark)).collect()] == [("B", "d", 1)]
    n = {round(r["f"], 2): r for r in M.net_of_retention(M.mark_totals(marked.filter("symbol = 'A'"), "symbol"), 4).collect()}
    assert n[0.0]["net"] == -2.0 and n[1.0]["net"] == 17.0 and abs(n[0.5]["break_even"] - 2 / 19) < 1e-12


def test_totals_of_a_moment(spark):
    rows = [
        ("a", at(-90_000), at(-80_000), -900.0, -1000.0),  # the day before
        ("a", at(10), at(20), -400.0, -500.0),
        ("a", at(20), at(30), 900.0, 800.0),  # a halt isn't taken back
        ("a", at(30), at(900), 50.0, 40.0),  # open
        ("a", at(800), at(900), 70.0, 60.0),  # not known yet
        ("b", at(5), at(100), 10.0, 5.0),  # ends at this moment
    ]
    trades = spark.createDataFrame(rows, "arm string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, gross_pnl double, net_pnl double")
    got = {r["arm"]: r for r in M.telemetry_totals(trades, F.lit(at(100)), 450.0).collect()}
    a, b = got["a"], got["b"]
    assert (a["n_trades"], a["open_positions"], a["realized"], a["unrealized"], a["total"]) == (3, 1, -700.0, 50.0, -650.0)
    assert (a["day_net"], a["halted"], a["feed_age_s"]) == (300.0, True, 70)
    assert (b["n_trades"], b["open_positions"], b["day_net"], b["halted"], b["feed_age_s"]) == (1, 0, 5.0, False, 0)
