"""Text, number and date coercion expressions.

Each helper returns a ``Column``; none of them is a Python UDF.  The
semantics follow the reference's pandas/Python behaviour (see SURVEY §2.13),
with the documented divergences D1 (NaN/inf text is null) and D2 (slash
dates are day-first).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: the product category list, in
# the reference's order (first match wins when parsing tagged responses).
CATEGORIES = ["Choker Set", "Earrings", "Bangles", "Polki", "Kundan", "Ring", "Other"]

# A plain decimal or scientific number, optionally signed and space padded.
# Everything else (``1,200``, ``₹5``, ``0x10``, ``inf``, ``1f``) is not a number.
NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Accepted date spellings (D2: slashes are day-first), each with the text
# shape that can possibly parse under it.  The shapes are disjoint, so
# trying only the matching format equals trying all of them in order -- and
# skips the costly failed parse attempts.
DATE_FORMATS = [
    ("MMMM d, yyyy", r"^\p{L}"),
    ("yyyy-M-d", r"^\d{4}-"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy H:m:s", r"^\d{1,2}/\d{1,2}/\d{4} "),
]

# Amounts: 28 integer digits and 8 decimals leave room for two subtractions
# and for sums without rounding; anything larger is an overflow error.
MONEY = "decimal(36,8)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters Python's ``str.strip()`` removes (``str.isspace``), as a
# public property of Python's string model: ASCII tab, line feed, vertical
# tab, form feed, carriage return, the file/group/record/unit separators,
# space, next line, no-break space, and the Unicode space separators.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def clean_text(c) -> Column:
    """``str(x).strip()`` for non-null text: removes Python's whitespace set
    at both ends with a plain character-set trim (no regex; Spark ``trim``
    alone only removes spaces)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def is_blank(c) -> Column:
    """Null or only whitespace (Q12: null text counts as blank)."""
    return F.coalesce(clean_text(c) == F.lit(""), F.lit(True))


def clean_number(c) -> Column:
    """``pd.to_numeric(errors='coerce')`` as a nullable double."""
    s = _c(c).cast("string")
    return F.when(s.rlike(NUMBER_RE), F.trim(s).try_cast("double"))


def money(c, fill_zero: bool = True) -> Column:
    """Money amount as a wide decimal, cast straight from the text so that the
    written digits are kept; text that is not a number -> 0 (or null), a
    number too large for the type is an error.

    Sums stay exact in decimal, so totals do not depend on partition order."""
    s = _c(c).cast("string")
    num = F.when(s.rlike(NUMBER_RE), clean_text(s).cast(MONEY))
    return F.coalesce(num, F.lit(0).cast(MONEY)) if fill_zero else num


def parse_date(c) -> Column:
    """Per-row mixed-format date parse of the stripped text; unparsable ->
    null (timestamp)."""
    s = clean_text(c)
    out = None
    for fmt, shape in DATE_FORMATS:
        out = (F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt))) if out is None
               else out.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt))))
    return out


def python_title(c) -> Column:
    """Python ``str.title()``: upper-case the first letter of every run of
    letters, lower-case the rest (``Men's`` -> ``Men'S``, ``semi-precious``
    -> ``Semi-Precious``).  Spark ``initcap`` only restarts after spaces."""
    runs = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)),
                                                             F.substring(x, 2, 1 << 30))), "")


def truncate(c, limit: int, keep: int, suffix: str) -> Column:
    """``s[:keep] + suffix`` when ``len(s) > limit`` else ``s``."""
    s = _c(c)
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, keep), F.lit(suffix))).otherwise(s)


def format_money(c, decimals: int) -> Column:
    """Python ``f"{x:,.Nf}"``: thousands separators, half-even on the binary
    value -- Spark ``format_number`` agrees, ``format_string`` does not."""
    return F.format_number(_c(c).cast("double"), decimals)


def search_tokens(c) -> Column:
    """Search tokeniser: commas become spaces, then ``text_runs``.  Repeated
    tokens are kept (each one scores)."""
    return text_runs(F.regexp_replace(_c(c), ",", " "))


def text_runs(c) -> Column:
    """Python's ``str.lower().split()``: lower-cased runs between whitespace
    (the same set as ``clean_text``); empties dropped."""
    parts = F.split(F.lower(_c(c)), f"[{PY_WHITESPACE}]+")
    return F.filter(parts, lambda x: x != F.lit(""))
