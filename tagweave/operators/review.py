"""Review: facets, search, edits, counts and the export projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalars as S
from ..schema import TAG_TEXTS

SEARCHED = ("text", "description", "isa_function", "loop_group", "line_or_equipment", "panel", "notes")


def page_noise() -> Column:
    """Tags read from the page as a whole, which are rarely instruments; hidden by default."""
    return (F.col("origin") == "page") & (F.col("source") == "auto")


def filtered(tags: DataFrame, loop_group: str | None = None, panel: str | None = None, state: str | None = None, hide_noise: bool = True, search: str = "", page: int | None = None) -> DataFrame:
    out = tags
    for name, value in (("loop_group", loop_group), ("panel", panel), ("state", state), ("page", page)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    if hide_noise:
        out = out.filter(~page_noise())
    needle = search.strip().lower()
    if needle:
        hit = F.lit(False)
        for c in SEARCHED:
            hit = hit | F.contains(F.lower(F.col(c)), F.lit(needle))
        out = out.filter(hit)
    return out


def facet_values(tags: DataFrame, column: str) -> DataFrame:
    """Distinct values that aren't blank, in natural order."""
    v = S.trimmed(F.col(column))
    return tags.select("drawing_id", v.alias("value")).filter("value <> ''").distinct().orderBy("drawing_id", S.natural_key(F.col("value")), "value")


def state_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("drawing_id").agg(F.count("*").alias("n_tags"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in dims.STATES], F.count_if(page_noise()).alias("n_page_noise"))


def edited(tags: DataFrame, edits: DataFrame, reviewer: str, now: str) -> DataFrame:
    """edits (drawing_id, id and any columns of tags, null: as it is), one row per tag; edited tags are stamped."""
    changed = [c for c in edits.columns if c not in ("drawing_id", "id")]
    e = edits.select("drawing_id", "id", *[F.col(c).alias(f"_{c}") for c in changed], F.lit(True).alias("_hit"))
    t = tags.join(e, ["drawing_id", "id"], "left")
    stamp = {"updated_at": now, "updated_by": reviewer}
    return t.select(*[(F.coalesce(f"_{c}", c) if c in changed else F.when(F.col("_hit"), stamp[c]).otherwise(F.col(c)) if c in stamp else F.col(c)).alias(c) for c in tags.columns])


def deleted(rows: DataFrame, ids: DataFrame, on: tuple[str, ...] = ("drawing_id", "id")) -> DataFrame:
    return rows.join(ids.select(*on), [*on], "left_anti")


def bulk_state(tags: DataFrame, state: str, reviewer: str, now: str) -> DataFrame:
    """Every tag, whatever the filter shows."""
    return tags.withColumns({"state": F.lit(state), "updated_at": F.lit(now), "updated_by": F.lit(reviewer)})


def confirmed_only(tags: DataFrame) -> DataFrame:
    return tags.filter("state = 'confirmed'")


def manual_tags(clicks: DataFrame, reviewer: str, now: str, width: float = 90, height: float = 36) -> DataFrame:
    """clicks (drawing_id, tag_seq, page, fx, fy, page_width, page_height): new tags in boxes around the clicks, each edge cut at the page's."""
    cx, cy = F.col("fx") * F.col("page_width"), F.col("fy") * F.col("page_height")
    box = {"x0": F.greatest(F.lit(0.0), cx - width / 2), "y0": F.greatest(F.lit(0.0), cy - height / 2), "x1": F.least(F.col("page_width"), cx + width / 2), "y1": F.least(F.col("page_height"), cy + height / 2)}
    given = {"type": "Manual", "state": "uncertain", "source": "manual", "pattern_name": "Manual", "origin": "bubble", "updated_at": now, "updated_by": reviewer}
    return clicks.select("drawing_id", "tag_seq", F.concat(F.lit("manual-"), "drawing_id", F.lit("-"), F.col("tag_seq").cast("string")).alias("id"), F.lit("NEW-TAG").alias("text"), "page", F.lit(100.0).alias("confidence"), *[v.alias(k) for k, v in box.items()], *[F.lit(given.get(c, "")).alias(c) for c in TAG_TEXTS])


def export_rows(tags: DataFrame) -> DataFrame:
    """The 25 export columns; positions of tags that were never placed are null."""
    at = {
        "Center_X": S.half_up((F.col("x0") + F.col("x1")) / 2), "Center_Y": S.half_up((F.col("y0") + F.col("y1")) / 2),
        "Width": S.half_up(F.col("x1") - F.col("x0")), "Height": S.half_up(F.col("y1") - F.col("y0")),
    }
    return tags.select(*[(F.when(S.placed(), at[h]) if h in at else S.half_up(F.col(c)) if h == "Confidence_%" else F.col(c)).alias(h) for h, c in dims.TAG_HEADERS.items()])


def overlay(tags: DataFrame) -> DataFrame:
    """Boxes and labels to draw on a page."""
    colour = F.when(F.col("state") == "confirmed", "#22c55e").when(F.col("state") == "illegible", "#ef4444").otherwise("#f59e0b")
    return tags.filter(S.placed()).select("drawing_id", "page", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), colour.alias("colour"), F.col("text").alias("label"), F.greatest(F.lit(0.0), F.col("y0") - 4).alias("label_y"))


def overlay_percent(tags: DataFrame) -> DataFrame:
    """Boxes as percentages of their page (page_width, page_height); tags without an area aren't drawn."""
    part = lambda x, of: x / F.col(of) * 100
    at = {"left": part(F.col("x0"), "page_width"), "top": part(F.col("y0"), "page_height"), "width": part(F.col("x1") - F.col("x0"), "page_width"), "height": part(F.col("y1") - F.col("y0"), "page_height")}
    return tags.filter(~((F.col("x1") <= F.col("x0")) & (F.col("y1") <= F.col("y0")))).withColumns(at)


def detail_crop(tags: DataFrame, width: float, height: float, context: float) -> DataFrame:
    """The region (sx, sy, sw, sh) of its page that shows a tag, and the scale: the box widened to the view's shape, ``context`` times as large, moved onto the page."""
    scale = F.least(F.lit(width) / (F.col("x1") - F.col("x0")), F.lit(height) / (F.col("y1") - F.col("y0"))) / context
    sized = tags.filter(S.placed_for_crop()).withColumn("scale", scale).withColumns({"sw": F.lit(width) / F.col("scale"), "sh": F.lit(height) / F.col("scale")})
    onto = lambda low, high, span, page: F.greatest(F.lit(0.0), F.least(F.col(page) - F.col(span), (F.col(low) + F.col(high)) / 2 - F.col(span) / 2))
    return sized.withColumns({"sx": onto("x0", "x1", "sw", "page_width"), "sy": onto("y0", "y1", "sh", "page_height")})


def notices(tags: DataFrame, fixes: DataFrame) -> DataFrame:
    """(drawing_id, unread, corrected): bubbles that couldn't be read and readings that were adjusted, up to two of a tag, of each drawing that has any."""
    lost = tags.filter("type = 'Unreadable bubble'").groupBy("drawing_id").agg(F.count("*").alias("unread"))
    mended = fixes.groupBy("drawing_id").agg(F.count("*").alias("corrected"))
    return lost.join(mended, "drawing_id", "full").select("drawing_id", F.coalesce("unread", F.lit(0)).alias("unread"), F.coalesce("corrected", F.lit(0)).alias("corrected"))


def report(names: DataFrame, column: str, most: int = 10) -> str:
    """The first ten texts and how many more there are; counted only if there are more."""
    shown = [r[0] for r in names.select(column).limit(most + 1).collect()]
    more = names.count() - most if len(shown) > most else 0
    return ", ".join(shown[:most]) + (f" (+{more} more)" if more else "")
