"""Scalar functions of the platform's screens and templates.

All are built-in column expressions (JVM-side, inside whole-stage codegen);
none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dims import TOKEN_SYMBOL

RUPEE = "₹"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_round(x) -> Column:
    """JavaScript ``Math.round``: halves go toward +∞ (Spark ``round`` goes away
    from zero, so −2.5 would give −3 instead of −2)."""
    return F.floor(_c(x) + F.lit(0.5))


def money_inr(x) -> Column:
    """``'₹' + n.toLocaleString('en-IN')``: Indian digit grouping (12,34,567),
    up to three fraction digits, trailing zeros dropped. Exact on DECIMAL."""
    v = _c(x).cast("decimal(38,3)")
    s = F.abs(v).cast("string")
    int_part = F.split_part(s, F.lit("."), F.lit(1))
    frac = F.regexp_replace(F.split_part(s, F.lit("."), F.lit(2)), "0+$", "")
    grouped = F.regexp_replace(int_part, r"(?<=\d)(?=(\d\d)+\d$)", ",")
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(F.lit(RUPEE), sign, grouped, F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")))


def axis_k(x) -> Column:
    """Chart axis label ``'₹' + Math.round(v / 1000) + 'K'``."""
    return F.concat(F.lit(RUPEE), js_round(_c(x) / F.lit(1000)).cast("bigint").cast("string"), F.lit("K"))


def plain_number(x) -> Column:
    """A DECIMAL as JavaScript prints a number: no trailing fraction zeros."""
    s = _c(x).cast("string")
    return F.when(F.instr(s, ".") > 0, F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def relative_time(ts, as_of) -> Column:
    """'just now', 'N minutes/hours/days/months/years ago' (floor of the gap)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    secs = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(_c(ts).cast("timestamp"))) / F.lit(1000000))

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("bigint").cast("string"), F.lit(" " + unit),
                        F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))

    return (F.when(secs < 60, F.lit("just now"))
            .when(secs < 3600, ago(F.floor(secs / 60), "minute"))
            .when(secs < 86400, ago(F.floor(secs / 3600), "hour"))
            .when(secs < 30 * 86400, ago(F.floor(secs / 86400), "day"))
            .when(secs < 365 * 86400, ago(F.floor(secs / (30 * 86400)), "month"))
            .otherwise(ago(F.floor(secs / (365 * 86400)), "year")))


def token_symbol(asset) -> Column:
    m = F.create_map(*[F.lit(x) for kv in TOKEN_SYMBOL.items() for x in kv])
    return m[_c(asset)]


def activity_text(tx_type, quantity, asset) -> Column:
    """'Bought 2.5g Gold BGT'."""
    verb = (F.when(_c(tx_type) == "BUY", "Bought").when(_c(tx_type) == "SELL", "Sold")
            .when(_c(tx_type) == "REDEEM", "Redeemed").when(_c(tx_type) == "TRANSFER", "Transferred"))
    return F.concat(verb, F.lit(" "), plain_number(quantity), F.lit("g "), F.initcap(_c(asset)), F.lit(" "),
                    token_symbol(asset))


def render_template(text, values: dict) -> Column:
    """Replace ``{{key}}`` for each known key; unknown placeholders stay."""
    out = _c(text)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), _c(v) if not isinstance(v, str) else F.lit(v))
    return out


def iso_text(ts: Column) -> Column:
    """UTC time as ISO text with milliseconds, e.g. 2001-02-03T04:05:06.789Z."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
