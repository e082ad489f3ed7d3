"""Nested line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopfloor.functions.text import MONEY, clean_text, python_title, truncate


# Column names of the JSON fields.
FIELDS = {"sku": "Item_SKU", "category": "Category", "details": "Custom Details", "quantity": "Quantity",
          "source_price": "Source Price (₹)", "selling_price": "Selling Price (₹)", "unit_price": "Unit Price (₹)"}


NUMBERS = {"quantity", "source_price", "selling_price", "unit_price"}


def _json(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(text: Column) -> Column:
    """A JSON number, or text that holds one, as a double; anything else, NaN and infinities
    included, is missing (null).  ``translate`` keeps out Java's ``1d``, ``1f`` and ``Infinity``."""
    return F.nanvl(F.translate(text, "dDfF", "????").try_cast("double"), F.lit(None).cast("double"))


def _variant(c: Column) -> Column:
    """The text as a VARIANT, null if it isn't JSON; bare NaN and infinities, which Python
    writes and JSON doesn't know, are taken as text."""
    return F.try_parse_json(F.regexp_replace(c, r":\s*(-?Infinity|NaN)\b", ': "$1"'))


def _elements(v: Column) -> Column:
    """Elements of a JSON array; a lone object is an array of one (D3), anything else null."""
    kind = F.schema_of_variant(v)
    return (F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
            .when(kind.startswith("OBJECT"), F.array(v)))


def _is_object(element: Column) -> Column:
    return F.coalesce(F.schema_of_variant(element).startswith("OBJECT"), F.lit(False))


def _numbered(c: Column, columns: list[str]) -> Column:
    """Array of (line_no, it) with the fields of ``columns`` as text, line_no counting the
    elements from 1.

    Well-formed arrays of objects, nearly all, are read by one ``from_json``.  Only
    if that gives nothing, the text is read as a VARIANT and its elements are taken one
    by one: an element that isn't an object doesn't cost the others."""
    fields = [FIELDS[x] for x in columns]
    row = lambda i, it: F.struct((i + 1).cast("bigint").alias("line_no"), it.alias("it"))
    whole = F.from_json(c, T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in fields])))
    numbered = F.transform(_elements(_variant(c)), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    objects = F.filter(numbered, lambda e: _is_object(e["x"]))
    picked = F.transform(objects, lambda e: row(e["i"], F.struct(
        *[F.try_variant_get(e["x"], f"$['{f}']", "string").alias(f) for f in fields])))
    return F.coalesce(F.transform(whole, lambda x, i: row(i, x)), picked)


def parse_items(json_col="line_items_json", columns: list[str] | None = None):
    """Line items of a JSON text as an array of structs: null for malformed, blank or null
    text; a lone object is a one-element array (D3); elements that aren't objects are
    left out.  Only the fields of ``columns`` are parsed."""
    columns = columns or list(FIELDS)
    typed = lambda it: F.struct(*[(number(it[FIELDS[x]]) if x in NUMBERS else it[FIELDS[x]]).alias(FIELDS[x]) for x in columns])
    objects = F.filter(_numbered(_json(json_col), columns), lambda e: e["it"].isNotNull())
    return F.transform(objects, lambda e: typed(e["it"]))


def line_items(sales: DataFrame, keep: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """J1/P8f: one row per JSON line item of every sale, with ``columns``
    (all by default); ``line_no`` is the element's place in its array.

    ``inline_outer`` of ``posexplode``-style structs evaluates ``from_json``
    once; the non-outer form makes Catalyst add ``size() > 0`` guards that
    parse the text three times."""
    keep, columns = keep or [], columns or list(FIELDS)
    exploded = (sales.select("row_pos", *keep, F.inline_outer(_numbered(F.col("line_items_json"), columns)))
                .where(F.col("it").isNotNull()))
    it = F.col("it")
    return exploded.select("row_pos", *keep, "line_no",
                           *[(number(it[FIELDS[x]]) if x in NUMBERS else it[FIELDS[x]]).alias(x) for x in columns])


#: Why an element, or with element_no 0 a whole text, gives no line or no quantity.
NOT_JSON, NOT_A_LIST, NOT_AN_OBJECT, BAD_QUANTITY = "not JSON", "not a list", "not an object", "quantity is not a number"


def item_rejects(sales: DataFrame) -> DataFrame:
    """row_pos, element_no and reason of everything that ``line_items`` can't use: texts that
    are no JSON or no list (element_no 0), elements that are no object, and quantities
    that are no number (their line stays, without pieces).  Blank texts are no reject."""
    c = F.col("line_items_json")
    read = sales.where(F.trim(c) != "").select("row_pos", _variant(c).alias("v"))
    quantity_text = lambda x: F.try_variant_get(x, f"$['{FIELDS['quantity']}']", "string")
    reason = lambda x: (F.when(~_is_object(x), F.lit(NOT_AN_OBJECT))
                        .when(quantity_text(x).isNotNull() & number(quantity_text(x)).isNull(), F.lit(BAD_QUANTITY)))
    each = F.transform(_elements(F.col("v")), lambda x, i: F.struct((i + 1).cast("bigint").alias("element_no"), reason(x).alias("reason")))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("element_no"),
                             F.when(F.col("v").isNull(), F.lit(NOT_JSON)).otherwise(F.lit(NOT_A_LIST)).alias("reason")))
    return (read.select("row_pos", F.inline_outer(F.coalesce(each, whole))).where(F.col("reason").isNotNull())
            .select("row_pos", "element_no", "reason"))


def display_category(category="category", details="details"):
    """stripped, Python-title-cased category; ``Other`` with details
    becomes ``Other: <first 15 chars>...``.  Null/blank -> ``Unknown`` (D4)."""
    cat = F.col(category) if isinstance(category, str) else category
    det = F.col(details) if isinstance(details, str) else details
    title = python_title(clean_text(cat))
    d = F.coalesce(clean_text(det), F.lit(""))
    has_details = (d != "") & (F.lower(d) != "nan")
    return (F.when(cat.isNull() | (clean_text(cat) == ""), F.lit("Unknown"))
            .when((title == "Other") & has_details, F.concat(F.lit("Other: "), truncate(d, 15, 15, "...")))
            .otherwise(title))


def cart_totals(lines: DataFrame) -> DataFrame:
    """Pieces, cost and revenue per sale, exact in decimal; a missing
    quantity counts 0 pieces."""
    return (lines.groupBy("row_pos")
            .agg(F.sum(quantity()).alias("total_pieces"),
                 F.sum(line_amount("source_price")).cast("double").alias("total_cost"),
                 F.sum(line_amount("selling_price")).cast("double").alias("total_revenue"),
                 F.count(F.lit(1)).alias("n_lines")))


def quantity(c="quantity"):
    """Quantity of a line; missing or NaN -> 0, as in a sum that skips NaN."""
    return F.nanvl(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))


def line_amount(price: str):
    """Quantity times price, exact; a missing one makes 0, an overflow is an error."""
    amount = quantity().cast("decimal(18,6)") * F.nanvl(F.col(price), F.lit(None).cast("double")).cast("decimal(20,8)")
    return F.coalesce(amount, F.lit(0).cast("decimal(38,14)"))
