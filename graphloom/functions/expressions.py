"""Labels, numbers and colours of the model's entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Red, green and blue by node kind and by edge kind (fixed values of this library).
NODE_COLORS = {"Crate": (66, 133, 244), "Module": (52, 168, 83), "File": (154, 160, 166), "Symbol": (251, 188, 4)}
EDGE_COLORS = {"Contains": (128, 128, 128), "Calls": (66, 133, 244), "References": (171, 71, 188), "Imports": (0, 172, 193), "Implements": (255, 112, 67), "DependsOn": (234, 67, 53)}


def qualified_label(signature: Column, name: Column) -> Column:
    """The signature where there is one, else the name."""
    return F.coalesce(signature, name)


def path_segments(path: Column) -> Column:
    return F.split(path, "::")


def last_segment(path: Column) -> Column:
    return F.element_at(path_segments(path), -1)


def format_count(n: Column) -> Column:
    """With a comma between thousands."""
    return F.format_number(n, 0)


def node_label(kind: Column, name: Column, path: Column) -> Column:
    """A file's base name, any other node's name; "?" for what is missing."""
    return F.coalesce(F.when(kind == "File", F.regexp_extract(path, r"([^/\\]*)$", 1)).otherwise(name), F.lit("?"))


def _color(kind: Column, colors: dict[str, tuple[int, int, int]]) -> Column:
    known = F.create_map(*(x for k, c in colors.items() for x in (F.lit(k), F.array(*map(F.lit, c)))))
    return F.coalesce(F.element_at(known, kind), F.array(*(F.lit(128),) * 3))


def node_color(kind: Column) -> Column:
    return _color(kind, NODE_COLORS)


def edge_color(kind: Column) -> Column:
    return _color(kind, EDGE_COLORS)


def lighten(color: Column, by: int) -> Column:
    """Every channel raised, 255 at most."""
    return F.transform(color, lambda c: F.least(c + by, F.lit(255)))


def node_alpha(highlighted: Column, in_focus: Column, pinned: Column, near_hover: Column) -> Column:
    """The least of what the modes leave of a node."""
    return F.least(*(F.when(F.coalesce(on, F.lit(True)), 1.0).otherwise(low) for on, low in ((highlighted, 0.15), (in_focus, 0.12), (pinned, 0.15), (near_hover, 0.20))))


def edge_alpha(weight: Column) -> Column:
    return (60 + F.least(weight, F.lit(5.0)) / 5 * 160) / 255


def edge_width(weight: Column, in_cycle: Column) -> Column:
    """Grows with the logarithm of the weight; cycles are drawn wider; 6 at most."""
    return F.least(F.lit(6.0), 1 + F.log(F.greatest(weight, F.lit(1.0))) + F.when(in_cycle, 1.0).otherwise(0.0))


def visibility_prefix(visibility: Column) -> Column:
    return F.when(visibility == "Public", "pub ").when(visibility == "Crate", "pub(crate) ").when(visibility == "Restricted", "pub(restricted) ").otherwise("")
