"""Schemas and settings.

A box is four doubles (x0, y0, x1, y1), y growing downwards.  Absent text is the empty
string.  Order matters in several operators, so rows carry an ordinal (word_seq,
tag_seq) and a drawing_id; loop numbers are text, for their leading zeros count.
"""

from __future__ import annotations

from dataclasses import dataclass

BOX = ("x0", "y0", "x1", "y1")
WORDS = "drawing_id string, word_seq long, page int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, origin string"
TAG_TEXTS = ("function_code", "loop_number", "suffix", "description", "type", "state", "source", "pattern_name", "origin", "isa_function", "loop_group", "line_or_equipment", "panel", "size", "fail_position", "notes", "continues_on", "updated_at", "updated_by")
TAGS = "drawing_id string, tag_seq long, id string, text string, page int, confidence double, x0 double, y0 double, x1 double, y1 double, " + ", ".join(f"{c} string" for c in TAG_TEXTS)
SEED = "drawing_id string, row_seq long, tag string, isa_function string, description string, loop_group string, line_or_equipment string, panel string, size string, fail_position string, notes string, state string"
LINES = "id string, line_number string, size string, service string, spec_code string, from_ref string, to_ref string, notes string"
SEED_FIELDS = ("isa_function", "description", "loop_group", "line_or_equipment", "panel", "size", "fail_position", "notes")


@dataclass(frozen=True)
class TagPattern:
    id: str
    name: str
    pattern: str
    enabled: bool = True
    description: str = ""


# The three default patterns; the third is off.
DEFAULT_PATTERNS = (
    TagPattern("isa-instrument", "ISA Instrument Tag", r"(?<![A-Z0-9-])(?<func>[A-Z]{1,5})-?(?<loop>\d{2,5})(?<suffix>[A-Z]{1,2})?(?![A-Z0-9-])"),
    TagPattern("equipment", "Equipment Tag", r"(?<![A-Z0-9-])(?<func>[A-Z]{1,4})-(?<loop>\d{2,4})(?<suffix>[A-Z]{0,2})(?![A-Z0-9-])"),
    TagPattern("line-number", "Pipe Line Number", r'\d{1,2}"?-(?<func>[A-Z]{1,6})-(?<loop>\d{3,6})(?:-(?<suffix>[A-Za-z0-9]{1,4}))?', enabled=False),
)


@dataclass(frozen=True)
class Settings:
    ocr_scale: float = 2.5
    stack_gap_factor: float = 0.8
    patterns: tuple[TagPattern, ...] = DEFAULT_PATTERNS
    detect_bubbles: bool = True
    bubble_min_radius: float = 13
    bubble_max_radius: float = 22
    reviewer: str = ""
    coverage: float = 0.7
    overlap: float = 0.4
    max_stack_height: float = 2.5
    bucket: int = 80
    min_gap: float = -2
    min_x_overlap: float = 0.3


@dataclass(frozen=True)
class ReconcileOptions:
    cluster_radius: float = 900
    weak_support: int = 2
    support_margin: int = 2
    min_subjects: int = 3
    same_page_only: bool = False
    refresh_isa_function: bool = False


@dataclass(frozen=True)
class MergeOptions:
    page: int = 1
    imported_state: str = "confirmed"
    reviewer: str = ""
    overwrite: bool = False
    updated_at: str = ""
    split_text: bool = False


@dataclass(frozen=True)
class CircleOptions:
    """Radii in raster pixels; the other values are those of the detector."""

    min_radius: float = 33
    max_radius: float = 55
    downsample: int | None = None
    edge: float = 60
    votes: float = 0.20
    bucket: int = 4
    apart: float = 1.2
    samples: int = 48
    dark: float = 170
    coverage: float = 0.45
    inner: float = 0.72
    ink: float = 0.25

    @property
    def scale(self) -> int:
        return self.downsample or max(1, min(3, int(self.min_radius // 5)))


@dataclass(frozen=True)
class BubbleView:
    scale: float
    pad: float
    rx: float
    ry: float


BUBBLE_VIEWS = (BubbleView(4, 1.25, 0.82, 0.82), BubbleView(5, 1.6, 1.15, 0.95))
