"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Raw reason codes and the labels they are shown as; other values pass through.
REASON_START_LABELS = {
    "backbtn": "back button",
    "fwdbtn": "forward button",
    "playbtn": "play button",
}
REASON_END_LABELS = {
    "backbtn": "back button",
    "endplay": "end play",
    "fwdbtn": "forward button",
}
# reason_end value that marks a play as complete
FULL_PLAY_REASON = "trackdone"
# reason_end label that marks a skip
SKIP_REASON = "forward button"
# separator of the website's composite (name, artist) key
COMPOSITE_SEP = "~~sep~~"
# an offline epoch above this is in milliseconds
OFFLINE_MS_THRESHOLD = 2_000_000_000
# an offline epoch at or below this (after unit fix) is not a valid time
OFFLINE_MIN_VALID = 100
# weekday and month names in display order
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
# ---------------------------------------------------------------------------

MS_PER_HOUR = 3_600_000
MS_PER_MINUTE = 60_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Control characters between and inside packed texts; texts may hold them too.
_NEXT, _MARK = "\x01", "\x02"


def text_columns(df: DataFrame) -> list[str]:
    """The columns of plain text, of which equality is that of the bytes."""
    return [f.name for f in df.schema.fields if f.dataType == T.StringType()]


def pack_texts(df: DataFrame, texts: Sequence[str], into: str = "_texts") -> DataFrame:
    """These text columns as one text, from which :func:`unpack_texts` gets them back, nulls and any characters included.

    A text has a place and length in its row, which no codec shortens: a row with a dozen texts is shuffled at little
    over half its size when they are one. Rows are equal exactly if their packed rows are.
    """
    def one(c: str) -> Column:
        marked = F.replace(F.col(c), F.lit(_MARK), F.lit(_MARK + "e"))
        return F.coalesce(F.replace(marked, F.lit(_NEXT), F.lit(_MARK + "s")), F.lit(_MARK + "n"))

    rest = [F.col(c) for c in df.columns if c not in texts]
    return df.select(*rest, F.concat_ws(_NEXT, *[one(c) for c in texts]).alias(into))


def unpack_texts(df: DataFrame, texts: Sequence[str], columns: Sequence[str], packed: str = "_texts") -> DataFrame:
    """``columns`` of what :func:`pack_texts` packed."""
    def one(i: int) -> Column:
        part = F.col(packed)[i]
        plain = F.replace(F.replace(part, F.lit(_MARK + "s"), F.lit(_NEXT)), F.lit(_MARK + "e"), F.lit(_MARK))
        return F.when(part != _MARK + "n", plain)

    apart = df.withColumn(packed, F.split(F.col(packed), _NEXT))
    return apart.select(*[one(texts.index(c)).alias(c) if c in texts else F.col(c) for c in columns])


def map_values(c: str | Column, mapping: dict[str, str]) -> Column:
    """Replace listed values, keep all others (incl. null) unchanged."""
    expr = col(c)
    out = None
    for raw, label in mapping.items():
        out = (F.when(expr == raw, F.lit(label))) if out is None else out.when(expr == raw, F.lit(label))
    return out.otherwise(expr) if out is not None else expr


def _sql_operand(x) -> str | None:
    if isinstance(x, bool):
        return None
    if isinstance(x, int):
        return str(x)
    if isinstance(x, str):
        return f"`{x}`"
    return None


def round_ratio(num, den, digits: int = 2, mult: int = 1) -> Column:
    """Exact half-even rounding of the rational ``mult * num / den`` (non-negative integers).

    ``num``/``den`` are column names, integer constants or Columns. Floating
    rounding of a double sum disagrees between engines on ties; the integer
    form is exact: quotient and remainder of ``num * mult * 10^digits`` by
    ``den`` in decimal(38,0) (Σms × 10^4 overflows a long at 100 TB scale),
    ties to the even quotient, then one IEEE division. ``den = 0`` → null.

    With names/constants the expression is emitted as one SQL expression
    (one call instead of dozens of Column builder calls).
    """
    scale = 10**digits
    n_sql, d_sql = _sql_operand(num), _sql_operand(den)
    if n_sql is not None and d_sql is not None:
        n = f"(CAST({n_sql} AS DECIMAL(38,0)) * {scale * mult})"
        d = f"NULLIF(CAST({d_sql} AS DECIMAL(38,0)), 0)"
        q = f"({n} div {d})"
        r = f"({n} % {d})"
        rounded = f"({q} + CASE WHEN 2 * {r} > {d} THEN 1 WHEN 2 * {r} = {d} THEN {q} % 2 ELSE 0 END)"
        return F.expr(f"{rounded} / {scale}" if digits else f"CAST({rounded} AS BIGINT)")
    num = F.lit(num) if isinstance(num, int) else col(num)
    den = F.lit(den) if isinstance(den, int) else col(den)
    n = num.cast("decimal(38,0)") * F.lit(scale * mult).cast("decimal(38,0)")
    d = F.nullif(den.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    r = n % d
    q = ((n - r) / d).cast("decimal(38,0)")
    adj = F.when(r * 2 > d, F.lit(1)).when(r * 2 == d, q % 2).otherwise(F.lit(0))
    rounded = (q + adj).cast("long")
    return rounded / F.lit(scale) if digits > 0 else rounded


def round_int_ratio(num, den, mult: int = 1) -> Column:
    """Half-even rounding of ``mult * num / den`` to a whole number (long)."""
    out = round_ratio(num, den, 0, mult)
    return out if _sql_operand(num) is not None and _sql_operand(den) is not None else out.cast("long")


def percent(part, whole, digits: int = 0) -> Column:
    """``part / whole * 100`` rounded half-even (exact)."""
    return round_ratio(part, whole, digits, 100) if digits else round_int_ratio(part, whole, 100)


def hours_rounded(sum_ms, digits: int = 2) -> Column:
    """Σ ms as hours, rounded half-even to ``digits``."""
    return round_ratio(sum_ms, MS_PER_HOUR, digits)


def hours(sum_ms: Column) -> Column:
    """Σ ms as hours; one division of an exact integer."""
    return sum_ms / F.lit(MS_PER_HOUR)


def format_hours(h: Column) -> Column:
    """``≥10`` → ``"<round(h)>h"``, else ``"H:MMh"`` with minutes rounded half-even."""
    minutes = F.bround((h - F.floor(h)) * 60, 0).cast("long")
    return (
        F.when(h >= 10, F.concat(F.bround(h, 0).cast("long").cast("string"), F.lit("h")))
        .otherwise(
            F.concat(
                F.floor(h).cast("long").cast("string"),
                F.lit(":"),
                F.lpad(minutes.cast("string"), 2, "0"),
                F.lit("h"),
            )
        )
    )
