"""Text expressions: normalising, tokenising, cleaning and rendering (all JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default English stop words of the full-text analyzer.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that "
    "the their then there these they this to was will with"
).split()

# Whitespace removed by strip().
BLANKS = " \t\n\r\f\v"

# Limits of the table converter.
MAX_COLUMN_NAME = 64
MAX_CELL = 128


def strip(c) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def norm_text(c) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def words(c) -> Column:
    """Lower-case word tokens of at least two characters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= 2)


def index_terms(c) -> Column:
    return F.filter(words(c), lambda t: ~t.isin(STOP_WORDS))


def token_count(c) -> Column:
    """Whitespace tokens: additive under concatenation with a free-standing separator."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda t: t != ""))


def split_ws(c) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def collapse_ws(c) -> Column:
    return F.array_join(split_ws(c), " ")


def cut_at_word(c, limit: int) -> Column:
    """Longest run of leading words within `limit` characters; a too long first word is cut."""
    kept = F.aggregate(
        F.slice(split_ws(c), 1, limit),
        F.struct(F.lit("").alias("s"), F.lit(True).alias("open")),
        lambda acc, w: F.when(
            acc["open"] & (F.length(acc["s"]) + F.length(w) + F.when(acc["s"] == "", 0).otherwise(1) <= limit),
            F.struct(
                F.when(acc["s"] == "", w).otherwise(F.concat(acc["s"], F.lit(" "), w)).alias("s"),
                F.lit(True).alias("open"),
            ),
        ).otherwise(F.struct(acc["s"].alias("s"), F.lit(False).alias("open"))),
        lambda acc: acc["s"],
    )
    return F.when(F.length(kept) > 0, kept).otherwise(F.substring(c, 1, limit))


def clip_cell(c, limit: int = MAX_CELL) -> Column:
    s = strip(c)
    return F.when(F.length(s) > limit, cut_at_word(s, limit)).otherwise(s)


def clean_header(name: Column, blank_ordinal: Column) -> Column:
    """Column name with commas as periods, parentheses as spaces, single blanks, at most 64 characters."""
    s = strip(name)
    s = F.when((s == "") | (s == "`"), F.concat(F.lit("unk_"), blank_ordinal.cast("string"))).otherwise(s)
    s = collapse_ws(F.translate(s, ",()", ".  "))
    return F.when(F.length(s) > MAX_COLUMN_NAME, cut_at_word(s, MAX_COLUMN_NAME)).otherwise(s)


def is_blank_header(name: Column) -> Column:
    s = strip(name)
    return (s == "") | (s == "`")


def is_bool(c) -> Column:
    return norm_text(c).isin("true", "false", "t", "f")


def is_int(c) -> Column:
    return strip(c).rlike(r"^[+-]?[0-9]+$")


def is_float(c) -> Column:
    return strip(c).rlike(r"^-?[0-9]+\.[0-9]+$")


def is_polygon(c) -> Column:
    s = F.regexp_replace(norm_text(c), r'^"(.*)"$', "$1")
    return s.rlike(r"^multipolygon[0-9(), .]*$")


def cell_type(c) -> Column:
    return (
        F.when(is_bool(c), "BOOL")
        .when(is_int(c), "INT")
        .when(is_float(c), "FLOAT")
        .when(is_polygon(c), "POLYGON")
        .otherwise("Other")
    )


def canonical_float(c) -> Column:
    """`5.00` and `5.0` as one text, in plain digits at every size; null when the text is not a float literal."""
    digits = F.regexp_replace(F.regexp_replace(strip(c), r"^(-?)0+(?=[0-9])", "$1"), r"(\.[0-9]+?)0+$", "$1")
    return F.when(is_float(c), F.when(digits == "-0.0", "0.0").otherwise(digits))


def sheet_letters(col_no: Column) -> Column:
    """1-based column number in spreadsheet letters, of any length a long can need."""
    start = F.struct(col_no.cast("long").alias("left"), F.lit("").alias("text"))

    def step(at, _):
        rest = at["left"] - 1
        letter = F.chr(F.pmod(rest, F.lit(26)) + 65)
        return F.when(at["left"] <= 0, at).otherwise(
            F.struct(F.floor(rest / 26).cast("long").alias("left"), F.concat(letter, at["text"]).alias("text"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda at: at["text"])  # 26^14 exceeds a long


def row_text(columns: list[str], sep: str = " | ", null_text: str = "") -> Column:
    """`col: value | col: value` over the columns of a typed row."""
    parts = [
        F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null_text))) for c in columns
    ]
    return F.concat_ws(sep, *parts)


def table_of_doc(doc_id) -> Column:
    return F.substring_index(doc_id, "_SEP_", 1)


def kind_of_doc(doc_id) -> Column:
    return F.when(F.get(F.split(doc_id, "_SEP_"), F.lit(1)).startswith("contents"), "content").otherwise("context")


def cut_tokens(c, limit: int) -> Column:
    """First `limit` whitespace tokens of a text."""
    return F.array_join(F.slice(split_ws(c), 1, limit), " ")


def mentions(needle: Column, text: Column, strict: bool = False) -> Column:
    """`needle` stands in `text` between blanks or parentheses.

    strict=True needs a neighbour on both sides and looks at the first occurrence only."""
    if strict:
        at = F.instr(text, needle)
        before = F.substring(text, at - 1, F.lit(1))
        after = F.substring(text, at + F.length(needle), F.lit(1))
        return (at > 1) & before.isin(" ", "(") & after.isin(" ", ")")
    framed = F.concat(F.lit(" "), F.translate(text, "()", "  "), F.lit(" "))
    return F.contains(framed, F.concat(F.lit(" "), F.translate(needle, "()", "  "), F.lit(" ")))
