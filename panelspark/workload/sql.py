"""The derived tables as CTEs, and a builder for oracle statements."""

from __future__ import annotations

import re

_MINUTE_TIME = "CAST((570+MinuteIndex)//60*10000 + (570+MinuteIndex)%60*100 AS INT)"
_SCORE = "CAST((CAST(StockCode AS BIGINT)*7919 + CAST(Date AS BIGINT)*31 + MinuteIndex*104729) % 50 AS DOUBLE)/50 - 0.5"

CTES = {
    "trades": """SELECT CAST(l_suppkey AS INT) AS StockCode,
 CAST((year(l_shipdate)+20)*10000 + month(l_shipdate)*100 + 1 AS INT) AS Date,
 CAST((day(l_shipdate)-1)//2 AS INT) AS MinuteIndex,
 100.0::DOUBLE + 20.0::DOUBLE*(l_extendedprice/l_quantity)/(l_extendedprice/l_quantity + 3000.0::DOUBLE) AS px,
 l_quantity AS qty, l_shipdate, l_orderkey, l_linenumber FROM lineitem""",
    "bars": """SELECT StockCode, Date, MinuteIndex,
 min_by(px, row(l_shipdate, l_orderkey, l_linenumber, px)) AS Open,
 max_by(px, row(l_shipdate, l_orderkey, l_linenumber, px)) AS Close,
 max(px) AS High, min(px) AS Low, sum(qty) AS Vol, round(sum(px*qty), 6) AS Amount
 FROM trades GROUP BY 1, 2, 3""",
    "dirty": """SELECT * REPLACE (CASE (StockCode+Date+MinuteIndex*5) % 17 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE
 WHEN 2 THEN 'infinity'::DOUBLE WHEN 3 THEN 0.0 WHEN 4 THEN '-infinity'::DOUBLE ELSE Close END AS Close) FROM bars""",
    "pred": f"""SELECT CAST(Date % 1000000 AS INT) AS date, {_MINUTE_TIME} AS time, StockCode AS code,
 {_SCORE} AS prediction FROM bars""",
    "daily": """SELECT StockCode AS code, Date, max(High) AS up_limit, min(Low) AS down_limit,
 CASE WHEN (StockCode+Date) % 11 = 0 THEN 0.0 ELSE round(sum(Amount), 6) END AS daily_amount
 FROM bars GROUP BY StockCode, Date""",
    "calendar": "SELECT DISTINCT Date FROM trades",
    "periods": "SELECT * FROM (VALUES (3, 20150301, 20160615), (7, 20180101, 99991231)) t(code, start_date, end_date)",
    "xsec": """SELECT CAST((year(l_shipdate)+20)%100*10000 + month(l_shipdate)*100 + day(l_shipdate) AS INT) AS date,
 CAST(l_suppkey AS INT) AS code, round(avg(l_discount), 6) AS prediction, round(avg(l_tax) - 0.04, 6) AS target,
 round(sum(l_extendedprice), 2) AS amount, 93000 AS time FROM lineitem GROUP BY 1, 2""",
    "labels": """SELECT b.*, ln(b.Close) AS log_close, ln(f.Close) - ln(e.Close) AS label_ret
 FROM bars b
 LEFT JOIN bars e ON e.StockCode=b.StockCode AND e.Date=b.Date AND e.MinuteIndex=b.MinuteIndex+1
 LEFT JOIN bars f ON f.StockCode=b.StockCode AND f.Date=b.Date AND f.MinuteIndex=b.MinuteIndex+4""",
    "labeled": f"""SELECT CAST(Date % 1000000 AS INT) AS date, {_MINUTE_TIME} AS time, StockCode AS code,
 {_SCORE} AS prediction, label_ret AS target FROM labels WHERE label_ret IS NOT NULL""",
    # feature columns: returns by row, everything else by formula
    "steps": """SELECT *, ln(Close) - lag(ln(Close), 1) OVER s AS r1, ln(Close) - lag(ln(Close), 2) OVER s AS r2,
 ln(Close) - lag(ln(Close), 3) OVER s AS r3, ln(Vol + 1.0) AS log_vol, ln(Amount + 1.0) AS log_amount
 FROM bars WINDOW s AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex)""",
    "feature_rows": """SELECT StockCode, Date, MinuteIndex, Close, ln(Close) AS log_close,
 sign(r1)*ln(1+abs(r1)) AS ret_1m, sign(r2)*ln(1+abs(r2)) AS ret_2m, sign(r3)*ln(1+abs(r3)) AS ret_3m,
 ln(High/Low) AS hl, ln(Close/Open) AS oc, log_vol, log_amount,
 CASE WHEN count(r1) OVER w >= 2 THEN stddev_pop(r1) OVER w END AS vol_3m,
 avg(log_vol) OVER w AS log_vol_3m_mean, avg(log_amount) OVER w AS log_amount_3m_mean,
 MinuteIndex/240.0::DOUBLE AS minute_norm, (MinuteIndex%120)/120.0::DOUBLE AS session_minute_norm
 FROM steps WINDOW w AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "training": """SELECT f.*, l.label_ret FROM feature_rows f JOIN labels l USING (StockCode, Date, MinuteIndex)
 WHERE f.MinuteIndex <= 11 AND l.label_ret IS NOT NULL AND ret_1m IS NOT NULL AND ret_2m IS NOT NULL
 AND ret_3m IS NOT NULL AND vol_3m IS NOT NULL""",
    # market state
    "adv": """SELECT k.code, k.Date, (SELECT avg(a) FROM (SELECT v.daily_amount AS a FROM daily v
 WHERE v.code=k.code AND v.Date<k.Date AND v.daily_amount>0 ORDER BY v.Date DESC LIMIT 5)) AS adv_amount FROM daily k""",
    "flags": """SELECT b.*, CAST(b.Date % 1000000 AS INT) AS date_short, d.up_limit, d.down_limit, a.adv_amount, Amount/Vol AS vwap,
 EXISTS (SELECT 1 FROM periods p WHERE p.code=b.StockCode AND b.Date BETWEEN p.start_date AND p.end_date) AS is_st
 FROM bars b LEFT JOIN daily d ON d.code=b.StockCode AND d.Date=b.Date LEFT JOIN adv a ON a.code=b.StockCode AND a.Date=b.Date""",
    "tradable": """SELECT *, (Open>0 AND Vol>0 AND Amount>0 AND NOT is_st) AS tradable_base,
 coalesce(High=Low AND (High=up_limit OR Low=down_limit), false) AS is_one_price_limit,
 bool_and(coalesce(High=up_limit AND Low=up_limit, false)) OVER d AS is_limit_up_all_day,
 bool_and(coalesce(High=down_limit AND Low=down_limit, false)) OVER d AS is_limit_down_all_day,
 Close/lag(Close) OVER s - 1 AS ret FROM flags
 WINDOW s AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex), d AS (PARTITION BY StockCode, Date)""",
    "state": """SELECT *, tradable_base AND NOT is_one_price_limit AS current_tradable,
 CASE WHEN count(ret) OVER r >= 2 THEN stddev_samp(ret) OVER r END AS sigma_intraday,
 min(CASE WHEN tradable_base AND NOT is_one_price_limit THEN MinuteIndex END) OVER n AS next_minute
 FROM tradable WINDOW r AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
 n AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "next_trade": """SELECT s.StockCode AS code, s.date_short AS date, s.MinuteIndex AS schedule_minute, s.next_minute AS exec_minute,
 x.Open AS px_open, x.vwap AS px_vwap FROM state s LEFT JOIN state x
 ON x.StockCode=s.StockCode AND x.Date=s.Date AND x.MinuteIndex=s.next_minute""",
    "feats": """SELECT s.date_short AS date, CAST((570+s.MinuteIndex)//60*10000 + (570+s.MinuteIndex)%60*100 AS INT) AS time,
 s.StockCode AS code, CAST(s.MinuteIndex % 4 AS INT) AS minute_slot, s.MinuteIndex AS base_minute, p.prediction,
 p.prediction IS NOT NULL AS prediction_available, s.Open AS signal_open, s.Close AS signal_close, s.Vol AS signal_vol,
 s.Amount AS signal_amount, s.adv_amount, s.current_tradable, s.sigma_intraday, s.up_limit, s.down_limit,
 s.is_limit_up_all_day, s.is_limit_down_all_day,
 s.MinuteIndex+1 AS entry_schedule_minute, e.exec_minute AS entry_exec_minute, e.px_open AS entry_open, e.px_vwap AS entry_vwap,
 e.exec_minute+4 AS exit_schedule_minute, x.exec_minute AS exit_exec_minute, x.px_open AS exit_open, x.px_vwap AS exit_vwap,
 x.px_open/e.px_open-1 AS ret_open_exec_10, x.px_vwap/e.px_vwap-1 AS ret_vwap_exec_10,
 e.px_open IS NOT NULL AND x.px_open IS NOT NULL AS fillable_open, e.px_vwap IS NOT NULL AND x.px_vwap IS NOT NULL AS fillable_vwap,
 coalesce(e.px_open>=s.up_limit, false) AS entry_open_is_up_limit, coalesce(e.px_open<=s.down_limit, false) AS entry_open_is_down_limit,
 coalesce(x.px_open>=s.up_limit, false) AS exit_open_is_up_limit, coalesce(x.px_open<=s.down_limit, false) AS exit_open_is_down_limit,
 coalesce(e.px_vwap>=s.up_limit, false) AS entry_vwap_is_up_limit, coalesce(e.px_vwap<=s.down_limit, false) AS entry_vwap_is_down_limit,
 coalesce(x.px_vwap>=s.up_limit, false) AS exit_vwap_is_up_limit, coalesce(x.px_vwap<=s.down_limit, false) AS exit_vwap_is_down_limit
 FROM state s
 LEFT JOIN pred p ON p.date=s.date_short AND p.code=s.StockCode
  AND p.time=CAST((570+s.MinuteIndex)//60*10000 + (570+s.MinuteIndex)%60*100 AS INT)
 LEFT JOIN next_trade e ON e.code=s.StockCode AND e.date=s.date_short AND e.schedule_minute=s.MinuteIndex+1
 LEFT JOIN next_trade x ON x.code=s.StockCode AND x.date=s.date_short AND x.schedule_minute=e.exec_minute+4""",
    "eligible": """SELECT *, ntile(3) OVER (PARTITION BY date, time ORDER BY signal_amount DESC, code) AS liq_bucket
 FROM feats WHERE current_tradable AND prediction_available AND adv_amount > 0 AND sigma_intraday IS NOT NULL""",
}


def _needs(text: str) -> list[str]:
    words = set(re.findall(r"\b[a-z_]+\b", text))
    return [name for name in CTES if name in words]


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by every CTE it refers to, directly or not."""
    extra = extra or {}
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        if name in seen:
            return
        for dep in _needs(CTES[name]):
            if dep != name:
                add(dep)
        seen[name] = CTES[name]

    for text in [*extra.values(), body]:
        for name in _needs(text):
            if name not in extra:
                add(name)
    seen.update(extra)
    parts = ",\n".join(f"{name} AS ({text})" for name, text in seen.items())
    return f"WITH RECURSIVE {parts}\n{body}" if parts else body


def oracle(body: str, floats: str = "", digits: int = 8, special: dict[str, int] | None = None, **ctes: str) -> str:
    """Statement whose ``floats`` columns are rounded the way ``tidy`` does."""
    special = special or {}
    if floats:
        def rounded_as(c: str) -> str:
            d = special.get(c, digits)
            value = f'CAST("{c}" AS DOUBLE)'
            return f'round(CASE WHEN isfinite({value}) THEN {value} END + 1.7e-{d + 3}::DOUBLE, {d}) + 0.0 AS "{c}"'

        rounded = ", ".join(rounded_as(c) for c in floats.split())
        body = f"SELECT * REPLACE ({rounded}) FROM ({body})"
    return with_ctes(body, ctes)
