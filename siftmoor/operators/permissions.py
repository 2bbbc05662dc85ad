"""Permission requests: per line and category, the first pattern that matches."""

from pyspark.sql import Column, functions as F

from siftmoor.fixed import detectors as fx
from siftmoor.functions.regex import prepare
from siftmoor.functions.text import sql_array, sql_text
from siftmoor.operators.anchors import Anchors
from siftmoor.operators.hits import HIT, PERMISSION
from siftmoor.operators.rulebook import PERMISSION_BASE


def labels() -> list[str]:
    return [f"{emoji} {text}" for _, emoji, text, _ in fx.PERMISSIONS]


def _category_hits(index: int, anchors: Anchors) -> str:
    ready = [prepare(p, "regex") for p in fx.PERMISSIONS[index][3]]
    any_pattern = sql_text("|".join(f"(?:{p.java})" for p in ready))
    matched = ", ".join(f"nullif(regexp_extract(x.s, {sql_text(p.java)}, 0), '')" for p in ready)
    as_hit = (
        f"CAST(struct({PERMISSION}, x.n, {index}, 0, {PERMISSION_BASE - index}, x.n, "
        f"substring(x.s, 1, {fx.PERMISSION_LINE_CHARS}), coalesce({matched}), null, null, null) AS {HIT})")
    may_match = " OR ".join(f"({anchors.may_match(p)})" for p in ready)
    return (
        f"CASE WHEN {may_match} "
        f"THEN transform(filter(code, x -> x.s RLIKE {any_pattern}), x -> {as_hit}) "
        f"ELSE CAST(array() AS array<{HIT}>) END")


def permission_hits(anchors: Anchors) -> Column:
    """``array<hit>`` of a file; needs the columns of ``with_lines``."""
    return F.expr(f"concat({', '.join(_category_hits(i, anchors) for i in range(len(fx.PERMISSIONS)))})")


def permission_labels(hits: Column) -> Column:
    """Sorted distinct labels of the permission hits of a file."""
    names = F.expr(sql_array(labels()))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.get(names, h["k2"]))))
