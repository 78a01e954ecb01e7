"""Scalar functions as Column expressions: all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

#: white space that trimming removes: Unicode's, and the byte order mark
_EDGE = "(?U)^[\\s\\x{FEFF}]+|[\\s\\x{FEFF}]+$"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, _EDGE, "")


def tag_key(x: Column) -> Column:
    """Letters and digits only, upper case."""
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


def stem(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]*[A-Z]*$"), F.regexp_extract(token, "^([0-9]*)", 1)).otherwise(token)


def letters(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]*[A-Z]*$"), F.regexp_extract(token, "^[0-9]*([A-Z]*)$", 1)).otherwise("")


def _pairs() -> Column:
    return F.array(*[F.lit(x) for a, b in dims.CONFUSABLE for x in (a + b, b + a)])


def confusable(a: Column, b: Column) -> Column:
    return (a == b) | F.array_contains(_pairs(), F.concat(a, b))


def confusable_letters() -> dict[str, list[str]]:
    """The letters that a digit may stand for."""
    return {str(d): sorted({x for p in dims.CONFUSABLE if str(d) in p for x in p if x.isalpha()}) for d in range(10)}


def _places(x: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)))


def one_substitution(a: Column, b: Column) -> Column:
    """Equal but for one place, where the two characters are confusable."""
    differ = F.filter(_places(a), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    i = F.element_at(differ, 1)
    return (F.length(a) == F.length(b)) & (F.length(a) > 0) & (F.size(differ) == 1) & confusable(F.substring(a, i, F.lit(1)), F.substring(b, i, F.lit(1)))


def one_insertion(short: Column, long: Column) -> Column:
    """Deleting one character, whichever, from the longer text gives the shorter one."""
    return (F.length(long) == F.length(short) + 1) & F.exists(_places(long), lambda i: F.concat(F.substring(long, F.lit(1), i - 1), F.substring(long, i + 1, F.length(long))) == short)


def one_edit(a: Column, b: Column) -> Column:
    return one_substitution(a, b) | one_insertion(a, b) | one_insertion(b, a)


def edit_keys(token: Column, target: bool) -> Column:
    """Keys that a reading (else a target) shares with each text that one changed place, or one character more in the target, makes of it."""
    cut = lambda i, put: F.concat(F.substring(token, F.lit(1), i - 1), F.lit(put), F.substring(token, i + 1, F.length(token)))
    longer = F.transform(_places(token), lambda i: F.concat(F.lit("-"), cut(i, ""))) if target else F.array(F.concat(F.lit("-"), token))
    return F.array_distinct(F.concat(F.transform(_places(token), lambda i: cut(i, "_")), longer))


def correction_kind(a: Column, b: Column) -> Column:
    """How a reading a may stand for token b; null if it can't."""
    sa, la, sb, lb = stem(a), letters(a), stem(b), letters(b)
    same = F.when(one_substitution(sa, sb), "stem-substitution").when(one_insertion(sa, sb), "stem-insertion")
    dropped = F.substring(sa, F.length(sa), F.lit(1))
    recovered = (F.length(lb) == 1) & (sa == F.concat(sb, dropped)) & (F.length(sa) == F.length(sb) + 1) & confusable(dropped, lb)
    return (
        F.when((a == b) | ((la != "") & (lb == "")), F.lit(None))
        .when(la == lb, same)
        .when(la == "", F.when(recovered, "suffix-recovered"))
        .when((sa == sb) & one_substitution(la, lb), "suffix-substitution")
    )


def rebuilt_text(func: Column, loop: Column, suffix: Column) -> Column:
    return F.when(loop == "", func).otherwise(F.concat(F.when(func == "", "?").otherwise(func), F.lit("-"), loop, suffix))


def isa_meaning(func: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in dims.LETTER_MEANINGS.items() for x in kv])
    return F.array_join(F.filter(F.transform(F.split(F.upper(func), ""), lambda c: F.try_element_at(known, c)), lambda x: x.isNotNull()), " + ")


def half_up(x: Column) -> Column:
    """Rounded half towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs with x0, y0, x1, y1."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    common = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    union = area(a["x0"], a["y0"], a["x1"], a["y1"]) + area(b["x0"], b["y0"], b["x1"], b["y1"]) - common
    return F.when((common <= 0) | (union <= 0), 0.0).otherwise(common / union)


def placed(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    """Export's rule: the box has an extent in x or y."""
    return (F.col(x1) > F.col(x0)) | (F.col(y1) > F.col(y0))


def placed_for_crop() -> Column:
    return (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))


def placed_for_locate() -> Column:
    return F.col("x1") > F.col("x0")


LINE_PATTERN = "^\\s*([0-9X/.\"']+)?\\s*-?\\s*([A-Za-z]{1,4})-([0-9X]{2,6})(?:-([A-Za-z0-9]+))?"


def line_parts(x: Column) -> dict[str, Column]:
    """Size, service and specification code of a line number; blanks if it isn't one."""
    return {"size": F.regexp_replace(F.regexp_extract(x, LINE_PATTERN, 1), "[\"']$", '"'), "service": F.upper(F.regexp_extract(x, LINE_PATTERN, 2)), "spec_code": F.regexp_extract(x, LINE_PATTERN, 4)}


def csv_cell(x: Column) -> Column:
    return F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def natural_key(x: Column) -> Column:
    """Orders runs of digits by value, whatever their length: each run, without leading zeros, follows its own length in ten digits, so that a longer number is a larger key; leading zeros come last, to tell equal values apart."""
    def key(p):
        value = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.concat(F.lpad(F.length(value).cast("string"), 10, "0"), value)

    parts = F.regexp_extract_all(x, F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.concat(F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), key(p)).otherwise(F.lower(p))), ""), F.lit("\x00"), x)


def review_state(x: Column) -> Column:
    v = F.lower(trimmed(x))
    return F.when(v.isin(*dims.STATES), v).when(v.isin("yes", "true"), "confirmed").when(v.isin("no", "false"), "uncertain")


def first_filled(columns: list[Column]) -> Column:
    return reduce(lambda a, b: F.when(a != "", a).otherwise(b), columns, F.lit("")) if columns else F.lit("")
