"""Column -> Column helpers: scalar math, bands, bins, text and dates.

Everything here stays in built-in expressions, so it is part of whole-stage
code generation wherever it is used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named risk scales as (edges, labels, side the edge belongs to).
RISK_SCALES: dict[str, tuple[list[float], list[str], str]] = {
    "probability": ([0.3, 0.7], ["Low Risk", "Medium Risk", "High Risk"], "upper"),
    "composite": ([0.3, 0.6], ["Low", "Medium", "High"], "lower"),
    "quartile": ([0.25, 0.5, 0.75], ["Low Risk", "Medium Risk", "High Risk", "Very High Risk"], "upper"),
    "config": ([0.2, 0.5, 0.8], ["Low Risk", "Medium Risk", "High Risk", "Very High Risk"], "upper"),
    "score": ([40.0, 70.0], ["Low", "Medium", "High"], "upper"),
}

# Display colors of the probability scale.
RISK_COLORS = {"Low Risk": "#2ca02c", "Medium Risk": "#ff7f0e", "High Risk": "#d62728"}
DEFAULT_COLOR = "#1f77b4"

# Credit score ranges, lower bound first.
SCORE_BANDS = [(800, 850, "Excellent"), (740, 799, "Very Good"), (670, 739, "Good"), (580, 669, "Fair"), (300, 579, "Poor")]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def banded(c: Column | str, edges: Sequence[float], labels: Sequence, side: str = "upper") -> Column:
    """Label of the interval that holds ``c``; ``side`` says which band owns an edge."""
    c = col(c)
    out = None
    for edge, label in zip(edges, labels):
        hit = c < edge if side == "upper" else c <= edge
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.when(c.isNotNull(), out.otherwise(F.lit(labels[-1])))


def risk_band(c: Column | str, scale: str = "probability") -> Column:
    edges, labels, side = RISK_SCALES[scale]
    return banded(c, edges, labels, side)


def risk_color(label: Column | str) -> Column:
    return lookup(label, RISK_COLORS, DEFAULT_COLOR)


def score_band(c: Column | str) -> Column:
    """Credit-score range name; fractions fall to the range of their integer part."""
    c = F.floor(col(c))
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(SCORE_BANDS):
        out = F.when(c.between(lo, hi), name).otherwise(out)
    return out


def lookup(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Small constant mapping as a chain of equality tests."""
    c = col(c)
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def confidence_label(p: Column | str) -> Column:
    p = col(p)
    return (
        F.when((p < 0.1) | (p > 0.9), "High")
        .when((p < 0.3) | (p > 0.7), "Medium")
        .when(p.isNotNull(), "Low")
    )


# Recommendation texts of the probability and of the 0-100 scale.
PROBABILITY_ADVICE = (
    "APPROVE - Low risk of default. Application can be approved.",
    "REVIEW - Medium risk. Consider additional verification or reduced credit limit.",
    "REJECT - High risk of default. Consider declining the application.",
)
SCORE_ADVICE = ("Approve", "Review Required", "Reject")


def recommendation(c: Column | str, scale: str = "probability") -> Column:
    if scale == "probability":
        return banded(c, [0.3, 0.7], PROBABILITY_ADVICE)
    return banded(c, [40.0, 70.0], SCORE_ADVICE)


def safe_divide(a: Column | str, b: Column | str, default: float | None = 0.0) -> Column:
    """a / b, ``default`` when b is 0 or either side is null."""
    q = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(default))


def credit_utilization(bill, limit) -> Column:
    return safe_divide(bill, limit)


def payment_ratio(paid, bill) -> Column:
    return safe_divide(paid, bill)


def clip(c: Column | str, lo=None, hi=None) -> Column:
    """Bound to [lo, hi]; null stays null (greatest/least skip nulls)."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(F.lit(lo), out)
    if hi is not None:
        out = F.least(F.lit(hi), out)
    return F.when(c.isNotNull(), out)


# --- statistics across the columns of one row, skipping nulls -----------------

# Each helper is parsed as one expression: building it term by term costs a
# round trip to the JVM per term.

def _terms(cols: Sequence[str], term: str, sep: str = " + ") -> str:
    return "(" + sep.join(term.format(c=f"`{c}`") for c in cols) + ")"


def _count_sql(cols: Sequence[str]) -> str:
    return _terms(cols, "IF({c} IS NULL, 0, 1)")


def _sum_sql(cols: Sequence[str]) -> str:
    return _terms(cols, "coalesce(CAST({c} AS DOUBLE), 0.0D)")


def row_count(cols: Sequence[str]) -> Column:
    return F.expr(_count_sql(cols))


def row_sum(cols: Sequence[str]) -> Column:
    return F.expr(_sum_sql(cols))


def row_mean(cols: Sequence[str]) -> Column:
    return F.expr(f"try_divide({_sum_sql(cols)}, {_count_sql(cols)})")


def row_max(cols: Sequence[str]) -> Column:
    return F.greatest(*cols)


def row_min(cols: Sequence[str]) -> Column:
    return F.least(*cols)


def row_std(cols: Sequence[str]) -> Column:
    """Sample standard deviation (ddof 1) in the two-pass form, null below two values."""
    mean = f"try_divide({_sum_sql(cols)}, {_count_sql(cols)})"
    squares = _terms(cols, "coalesce(pow({c} - m, 2), 0.0D)").replace(" - m,", f" - {mean},")
    n = _count_sql(cols)
    return F.expr(f"CASE WHEN {n} > 1 THEN sqrt({squares} / ({n} - 1)) END")


def row_count_if(cols: Sequence[str], test: str) -> Column:
    """Columns that meet ``test``, a comparison such as ``> 0``."""
    return F.expr(_terms(cols, "IF({c} " + test + ", 1, 0)"))


# --- loans --------------------------------------------------------------------

def monthly_payment(amount, rate_percent, term_months) -> Column:
    """Annuity payment for a yearly rate in percent."""
    a, m, t = col(amount), col(rate_percent) / 1200.0, col(term_months)
    return F.try_divide(a * m, 1 - F.pow(1 + m, -t))


def offered_rate(risk, base: float = 3.5, cap: float = 25.0) -> Column:
    r = col(risk)
    return F.when(r.isNotNull(), F.least(F.lit(base) + r * 10, F.lit(cap)))


# --- bins ---------------------------------------------------------------------

def bin_fixed(c: Column | str, edges: Sequence[float], labels: Sequence | None = None) -> Column:
    """Right-closed bins (lo, hi]; values outside the edges become null."""
    c = col(c)
    labels = labels or list(range(1, len(edges)))
    out = F.when(c <= edges[0], F.lit(None))
    for hi, label in zip(edges[1:], labels):
        out = out.when(c <= hi, F.lit(label))
    return out


def equal_width_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Equal-width right-closed edges whose lowest edge is moved down by 0.1 % of the range."""
    if lo == hi:
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi = lo - pad, hi + pad
        return [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    edges = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    edges[-1] = hi
    edges[0] = lo - (hi - lo) * 0.001
    return edges


def bin_by_edges(c: Column | str, edges: Sequence[float], labels: Sequence | None = None) -> Column:
    """Right-closed bins where the first one also takes its lower edge."""
    c = col(c)
    labels = labels or list(range(1, len(edges)))
    out = F.when((c < edges[0]) | (c > edges[-1]), F.lit(None))
    for hi, label in zip(edges[1:], labels):
        out = out.when(c <= hi, F.lit(label))
    return out


def histogram_bin(c: Column | str, lo: float, hi: float, bins: int) -> Column:
    """0-based left-closed bin over [lo, hi]; the last bin also takes hi; null outside."""
    c = col(c)
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    idx = F.least(F.floor((c - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return F.when(c.between(lo, hi), idx)


# --- text and dates -----------------------------------------------------------

def format_value(c: Column | str, kind: str = "default", places: int = 2) -> Column:
    """Number as text, exact ties to the even digit; null gives N/A."""
    c = col(c)
    digits = "0" if places == 0 else "0." + "0" * places
    if kind == "currency":
        out = F.concat(F.lit("$"), F.format_number(c, places))
    elif kind == "percentage":
        out = F.concat(F.call_function("format_number", c.cast("double") * 100, F.lit(digits)), F.lit("%"))
    elif kind == "scientific":
        x, pattern = c.cast("double"), F.lit(digits + "E00")
        # decimals keep exact ties; doubles cover the sizes a decimal cannot hold
        exact = F.call_function("format_number", x.try_cast("decimal(38,16)"), pattern)
        raw = F.when(F.abs(x).between(1e-3, 1e20), exact).otherwise(F.call_function("format_number", x, pattern))
        out = F.replace(F.regexp_replace(raw, r"E(?=\d)", "e+"), F.lit("E-"), F.lit("e-"))
    else:
        out = F.format_number(c, places)
    return F.coalesce(out, F.lit("N/A"))


def format_datetime(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.coalesce(F.date_format(col(c), pattern), F.lit("N/A"))


def format_bytes(c: Column | str) -> Column:
    """Size in B, KB, MB, GB or TB with at most two decimals."""
    c = col(c).cast("double")
    out = F.when(c == 0, "0 B")
    units = ["B", "KB", "MB", "GB", "TB"]
    for i, unit in enumerate(units):
        inside = c < 1024.0 ** (i + 1) if i < len(units) - 1 else F.lit(True)
        out = out.when(inside, F.concat(F.round(c / 1024.0 ** i, 2).cast("string"), F.lit(" " + unit)))
    return F.when(c.isNotNull(), out)


def truncate_text(c: Column | str, max_length: int = 50, suffix: str = "...") -> Column:
    c = col(c)
    return F.when(F.length(c) <= max_length, c).otherwise(
        F.concat(F.substring(c, 1, max_length - len(suffix)), F.lit(suffix)))


def month_of(c: Column | str) -> Column:
    return F.date_trunc("month", col(c))


def month_difference(later, earlier) -> Column:
    """Whole calendar months between two dates, ignoring the day of month."""
    a, b = col(later), col(earlier)
    return ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("int")


def month_end(c: Column | str, ahead: int | Column = 0) -> Column:
    return F.last_day(F.add_months(col(c), ahead))


def parse_timestamp(c: Column | str, pattern: str | None = None) -> Column:
    """Text to timestamp, null when it does not parse."""
    c = col(c)
    return F.try_to_timestamp(c, F.lit(pattern)) if pattern else F.try_to_timestamp(c)


def texts(*pairs: tuple[Column, Column | str], default: str | None = None) -> Column:
    """Array of the texts whose condition holds; ``[default]`` when none does."""
    parts = F.array_compact(F.array(*[
        F.when(cond, F.lit(t) if isinstance(t, str) else t) for cond, t in pairs]))
    if default is None:
        return parts
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(default)))
