"""Plain-Python counterparts used to check the plans on small data."""

from __future__ import annotations

import math
import random


def rows_of(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def assert_same(left, right, tol=1e-9):
    """Equal lists of dicts, floats within ``tol``."""
    assert len(left) == len(right), (len(left), len(right))
    for a, b in zip(left, right):
        assert a.keys() == b.keys()
        for k in a:
            if isinstance(a[k], float) or isinstance(b[k], float):
                assert close(a[k], b[k], tol), (k, a, b)
            else:
                assert a[k] == b[k], (k, a, b)


def pearson(xs, ys):
    n = len(xs)
    if n < 2:
        return None
    mx, my = sum(xs) / n, sum(ys) / n
    sxx, syy = sum((x - mx) ** 2 for x in xs), sum((y - my) ** 2 for y in ys)
    if sxx <= 1e-18 or syy <= 1e-18:
        return None
    return sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / math.sqrt(sxx * syy)


def avg_ranks(xs):
    out = [0.0] * len(xs)
    for i, x in enumerate(xs):
        less, same = sum(y < x for y in xs), sum(y == x for y in xs)
        out[i] = less + (same + 1) / 2
    return out


def random_features(seed, slots=3, bars=8, codes=12):
    """Execution-feature rows with gaps, missing returns and unfillable rows."""
    rng = random.Random(seed)
    rows = []
    for b in range(bars * slots):
        for c in range(1, codes + 1):
            if rng.random() < 0.15:
                continue
            ret = rng.gauss(0, 0.02) if rng.random() < 0.9 else None
            rows.append(dict(
                date=260101 + b // (2 * slots), time=93000 + 100 * (b % (2 * slots)), code=c, minute_slot=b % slots,
                prediction=round(rng.gauss(0, 1), 1), prediction_available=True, current_tradable=rng.random() < 0.95,
                signal_amount=float(rng.randint(1, 50)), sigma_intraday=rng.uniform(0.005, 0.02),
                adv_amount=rng.uniform(1e5, 1e6), is_limit_up_all_day=False, is_limit_down_all_day=rng.random() < 0.03,
                fillable_vwap=ret is not None and rng.random() < 0.95, ret_vwap_exec_10=ret,
                entry_vwap_is_up_limit=rng.random() < 0.05, entry_vwap_is_down_limit=rng.random() < 0.05,
                exit_vwap_is_up_limit=rng.random() < 0.05, exit_vwap_is_down_limit=rng.random() < 0.05))
    return rows


FEATURE_SCHEMA = (
    "date int, time int, code int, minute_slot int, prediction double, prediction_available boolean, "
    "current_tradable boolean, signal_amount double, sigma_intraday double, adv_amount double, "
    "is_limit_up_all_day boolean, is_limit_down_all_day boolean, fillable_vwap boolean, ret_vwap_exec_10 double, "
    "entry_vwap_is_up_limit boolean, entry_vwap_is_down_limit boolean, exit_vwap_is_up_limit boolean, "
    "exit_vwap_is_down_limit boolean"
)


def feature_frame(spark, rows):
    names = [f.split()[0] for f in FEATURE_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], FEATURE_SCHEMA)
