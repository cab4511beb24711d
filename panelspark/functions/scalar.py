"""Scalar column expressions. Everything stays inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: ColumnLike) -> Column:
    """True for a value that is neither NULL, NaN nor infinite; never NULL."""
    v = col(c).cast("double")
    return F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)) & F.coalesce(~F.isnan(v), F.lit(False))


def clean(c: ColumnLike) -> Column:
    """The value as double, with NaN and infinities turned into NULL."""
    return F.when(is_finite(c), col(c).cast("double"))


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def falsy(c: Column) -> Column:
    """A comparison in which a missing side counts as False."""
    return F.coalesce(c, F.lit(False))


# --- transforms -----------------------------------------------------------

def signed_log1p(c: ColumnLike) -> Column:
    return F.signum(col(c)) * F.log1p(F.abs(col(c)))


def squash(c: ColumnLike, scale: float) -> Column:
    return F.tanh(col(c) / F.lit(float(scale)))


def clip(c: ColumnLike, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def is_zero(c: ColumnLike) -> Column:
    return (col(c) == 0).cast("double")


def zscore(c: ColumnLike, mean: float, std: float) -> Column:
    return (col(c).cast("double") - F.lit(float(mean))) / F.lit(float(std))


def unzscore(c: ColumnLike, mean: float, std: float) -> Column:
    return col(c).cast("double") * F.lit(float(std)) + F.lit(float(mean))


def rank_bin(c: ColumnLike, digits: int = 3) -> Column:
    """Integer bin key of a value rounded half-even to ``digits`` places."""
    return F.bround(col(c) * F.lit(float(10 ** digits)), 0).cast("int")


def vwap(amount: ColumnLike = "Amount", volume: ColumnLike = "Vol") -> Column:
    return ratio(amount, volume)


# --- calendar -------------------------------------------------------------

def full_date(short: ColumnLike) -> Column:
    """yymmdd -> yyyymmdd in the 2000s."""
    return (col(short) + F.lit(20000000)).cast("int")


def short_date(full: ColumnLike) -> Column:
    """yyyymmdd -> yymmdd."""
    return (col(full) % F.lit(1000000)).cast("int")


def year_of(date: ColumnLike) -> Column:
    """Four-digit year of a yymmdd or yyyymmdd integer."""
    y = F.floor(col(date) / F.lit(10000)).cast("int")
    return F.when(y < 1000, y + 2000).otherwise(y)


def month_of(date: ColumnLike) -> Column:
    """The date without its day part: yymm or yyyymm."""
    return F.floor(col(date) / F.lit(100)).cast("int")


def date_col(full: ColumnLike) -> Column:
    """yyyymmdd -> DATE."""
    d = col(full)
    return F.make_date(F.floor(d / 10000).cast("int"), (F.floor(d / 100) % 100).cast("int"), (d % 100).cast("int"))


def time_int(ts: ColumnLike) -> Column:
    """Timestamp -> hhmmss."""
    t = col(ts)
    return (F.hour(t) * 10000 + F.minute(t) * 100 + F.second(t)).cast("int")


def date_int(ts: ColumnLike) -> Column:
    """Timestamp -> yymmdd."""
    t = col(ts)
    return ((F.year(t) % 100) * 10000 + F.month(t) * 100 + F.dayofmonth(t)).cast("int")


def timestamp_key(date: ColumnLike, time: ColumnLike, epoch_days: bool) -> Column:
    """Timestamp of a (date, time) key pair.

    Two encodings are in use: yymmdd + hhmmss, and days since 1970 + seconds
    of the day. ``epoch_days`` says which; see ``uses_epoch_days``.
    """
    d, t = col(date), col(time)
    if epoch_days:
        return (F.date_add(F.lit("1970-01-01").cast("date"), d.cast("int")).cast("timestamp_ntz")
                + F.make_dt_interval(secs=t.cast("double")))
    return F.make_timestamp_ntz(
        (F.lit(2000) + F.floor(d / 10000)).cast("int"), (F.floor(d / 100) % 100).cast("int"), (d % 100).cast("int"),
        F.floor(t / 10000).cast("int"), (F.floor(t / 100) % 100).cast("int"), (t % 100).cast("int"),
    )


def uses_epoch_days(max_date: int) -> bool:
    """Encoding switch: yymmdd dates of this century exceed 100000."""
    return int(max_date) <= 100000


def session_minute(time: ColumnLike) -> Column:
    """hhmmss -> minute of the trading session, 0..239; NULL outside it.

    Morning 09:30-11:29 maps to 0..119, afternoon 13:00-14:59 to 120..239.
    """
    t = col(time)
    clock = F.floor(t / 10000) * 60 + F.floor(t / 100) % 100
    return (F.when(clock.between(570, 689), clock - 570)
            .when(clock.between(780, 899), clock - 780 + 120)).cast("int")


def minute_time(minute: ColumnLike) -> Column:
    """Session minute -> hhmmss, the inverse of ``session_minute``."""
    m = col(minute)
    clock = F.when(m < 120, m + 570).otherwise(m + 660)
    return (F.floor(clock / 60) * 10000 + (clock % 60) * 100).cast("int")


def minute_slot(minute: ColumnLike, k: int) -> Column:
    return (col(minute) % F.lit(int(k))).cast("int")


def minute_norm(minute: ColumnLike) -> Column:
    return col(minute).cast("double") / F.lit(240.0)


def session_minute_norm(minute: ColumnLike) -> Column:
    return (col(minute) % 120).cast("double") / F.lit(120.0)


def session_id(minute: ColumnLike) -> Column:
    return (col(minute) >= 120).cast("double")


# --- inverse normal -------------------------------------------------------

# Coefficients of algorithm AS 241 (Wichura 1988), double precision.
_CENTRAL = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def _rational(x: Column, table) -> Column:
    return _horner(x, table[0]) / _horner(x, table[1])


def inverse_normal(p: ColumnLike) -> Column:
    """Quantile of the standard normal for 0 < p < 1."""
    prob = col(p).cast("double")
    q = prob - 0.5
    tail = F.sqrt(-F.ln(F.least(prob, 1.0 - prob)))
    sign = F.when(q < 0, -1.0).otherwise(1.0)
    return (F.when(F.abs(q) <= 0.425, q * _rational(F.lit(0.180625) - q * q, _CENTRAL))
            .when(tail <= 5.0, sign * _rational(tail - 1.6, _MIDDLE))
            .otherwise(sign * _rational(tail - 5.0, _FAR)))


def seeded_hash(seed: int | str, *columns: str) -> Column:
    """Hex digest of the seed and the columns' text; any SQL engine computes the same."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))
