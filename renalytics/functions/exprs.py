"""Column expressions (JVM-side, codegen-friendly; no Python UDFs).

Each function returns a ``Column`` so callers compose them inside one
projection and Catalyst keeps the whole chain in a single codegen stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# numbers
# ---------------------------------------------------------------------------
def round_half_up(c: ColumnOrName, decimals: int) -> Column:
    """Sign-aware half-away-from-zero rounding, identical in DuckDB.

    ``round`` differs between engines on ties (1.005); this form is written the
    same way in the oracle SQL so both sides agree bit for bit.  From 2**53 / 10**decimals
    on a double has no digits left to round, and ``floor`` would saturate: it stays.
    """
    c = col(c)
    scale = float(10 ** decimals)
    r = (F.signum(c) * F.floor(F.abs(c) * F.lit(scale) + F.lit(0.5)).cast("double")
         / F.lit(scale))
    # -0.0 (a tiny negative rounded away) would hash differently from 0.0
    return (F.when(F.abs(c) >= F.lit(2.0 ** 53 / scale), c.cast("double"))
            .when(r == 0, F.lit(0.0)).otherwise(r))


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` with 0 for a zero or NULL denominator (zero_division=0)."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")),
                      F.lit(0.0))


def nan_to_null(c: ColumnOrName) -> Column:
    """NaN compares as larger than every number in Spark; make it NULL."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


# ---------------------------------------------------------------------------
# categorical encodings
# ---------------------------------------------------------------------------
def encode_map(c: ColumnOrName, mapping: dict[str, int], default: int = 0) -> Column:
    """Exact-match mapping; unmapped, wrong-case and NULL values become ``default``."""
    c = col(c)
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == F.lit(k), F.lit(v)) if expr is None
                else expr.when(c == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default)).cast("int")


def is_unmapped(c: ColumnOrName, mapping: dict[str, int]) -> Column:
    """True when the value would fall to the default (NULL counts as unmapped)."""
    c = col(c)
    return F.coalesce(~c.isin(list(mapping.keys())), F.lit(True))


def display_name(name: str) -> str:
    """Display name of a column: dictionary, else underscores to spaces, title case."""
    return fixed.DISPLAY_NAMES.get(name, name.replace("_", " ").title())


def display_name_expr(c: ColumnOrName) -> Column:
    """Same as :func:`display_name` for a column that holds column names."""
    c = col(c)
    m = F.create_map(*[F.lit(x) for kv in fixed.DISPLAY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), F.initcap(F.regexp_replace(c, "_", " ")))


# ---------------------------------------------------------------------------
# kidney function
# ---------------------------------------------------------------------------
def is_female(gender: ColumnOrName, numeric: bool = False) -> Column:
    """'Female' for a text column, 0 for an encoded one; unknown takes the male branch."""
    g = col(gender)
    return F.coalesce(g == F.lit(0) if numeric else g == F.lit("Female"), F.lit(False))


def egfr_ckd_epi(scr: ColumnOrName, age: ColumnOrName, female: Column,
                 female_factor: float = 1.0, decimals: int = 2) -> Column:
    """eGFR from creatinine (mg/dL), age and sex, rounded to ``decimals``.

    No 1.012 female factor by default (as in the original).  Non-positive or
    missing creatinine gives NULL (``pow(0, negative)`` would be Infinity).
    """
    scr = col(scr).cast("double")
    age = col(age).cast("double")
    kappa = F.when(female, F.lit(fixed.EGFR_KAPPA_FEMALE)).otherwise(F.lit(fixed.EGFR_KAPPA_MALE))
    alpha = F.when(female, F.lit(fixed.EGFR_ALPHA_FEMALE)).otherwise(F.lit(fixed.EGFR_ALPHA_MALE))
    exponent = F.when(scr <= kappa, alpha).otherwise(F.lit(fixed.EGFR_EXP_HIGH))
    value = (F.lit(fixed.EGFR_CONST) * F.pow(scr / kappa, exponent)
             * F.pow(F.lit(fixed.EGFR_AGE_BASE), age))
    if female_factor != 1.0:
        value = value * F.when(female, F.lit(female_factor)).otherwise(F.lit(1.0))
    return F.when(scr > 0, round_half_up(value, decimals))


def egfr_stage(egfr: ColumnOrName, strict: bool = False) -> Column:
    """eGFR to stage by inclusive lower bounds; NULL falls to the last stage.

    ``strict=True`` returns NULL for a missing eGFR instead.
    """
    e = col(egfr)
    expr = None
    for stage, lower, _desc, _colour in fixed.STAGES[:-1]:
        cond = e >= F.lit(lower)
        expr = F.when(cond, F.lit(stage)) if expr is None else expr.when(cond, F.lit(stage))
    last = F.lit(fixed.STAGES[-1][0])
    if strict:
        return F.when(e.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(last))
    return expr.otherwise(last)


def stage_description(stage: ColumnOrName) -> Column:
    m = F.create_map(*[F.lit(x) for s in fixed.STAGES for x in (s[0], s[2])])
    return F.coalesce(F.try_element_at(m, col(stage)), F.lit(fixed.UNKNOWN_STAGE_DESCRIPTION))


def stage_ordinal(stage: ColumnOrName) -> Column:
    m = F.create_map(*[F.lit(x) for i, s in enumerate(fixed.STAGES) for x in (s[0], i + 1)])
    return F.try_element_at(m, col(stage))


def stage_colour(stage: ColumnOrName) -> Column:
    m = F.create_map(*[F.lit(x) for s in fixed.STAGES for x in (s[0], s[3])])
    return F.coalesce(F.try_element_at(m, col(stage)), F.lit(fixed.DEFAULT_COLOUR))


# ---------------------------------------------------------------------------
# risk bands
# ---------------------------------------------------------------------------
def risk_band(p: ColumnOrName, closed: str = "right") -> Column:
    """Probability to Low / Medium / High.

    ``closed="right"``: (-0.01, 0.3], (0.3, 0.7], (0.7, 1.01], outside -> NULL
    (batch table).  ``closed="left"``: < 0.3, < 0.7, else High (single patient).
    """
    p = col(p)
    if closed == "right":
        e = fixed.BAND_EDGES_RIGHT_CLOSED
        expr = None
        for lo, hi, label in zip(e[:-1], e[1:], fixed.BAND_ORDER):
            cond = (p > F.lit(lo)) & (p <= F.lit(hi))
            expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
        return expr
    if closed == "left":
        return (F.when(p.isNull(), F.lit(None).cast("string"))
                .when(p < F.lit(fixed.BAND_LOW_MAX), F.lit("Low"))
                .when(p < F.lit(fixed.BAND_MEDIUM_MAX), F.lit("Medium"))
                .otherwise(F.lit("High")))
    raise ValueError(f"closed must be 'right' or 'left', got {closed!r}")


def band_ordinal(band: ColumnOrName) -> Column:
    m = F.create_map(*[F.lit(x) for i, b in enumerate(fixed.BAND_ORDER) for x in (b, i + 1)])
    return F.try_element_at(m, col(band))


def band_colour(band: ColumnOrName) -> Column:
    m = F.create_map(*[F.lit(x) for kv in fixed.BAND_COLOURS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col(band)), F.lit(fixed.DEFAULT_COLOUR))


# ---------------------------------------------------------------------------
# bins
# ---------------------------------------------------------------------------
def age_group(age: ColumnOrName) -> Column:
    """Right-closed age bins (0,30], (30,40], ... (70,120]; outside -> NULL."""
    a = col(age)
    e = fixed.AGE_EDGES
    expr = None
    for lo, hi, label in zip(e[:-1], e[1:], fixed.AGE_LABELS):
        cond = (a > F.lit(lo)) & (a <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def hist_bin(x: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName, n_bins: int) -> Column:
    """Equal-width bin 0..n-1 over [lo, hi]; the last bin is closed on the right."""
    x, lo, hi = col(x), col(lo), col(hi)
    width = (hi - lo) / F.lit(float(n_bins))
    raw = F.floor((x - lo) / width)
    return F.when(hi == lo, F.lit(0)).otherwise(
        F.least(raw, F.lit(n_bins - 1)).cast("int"))


def add_all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
