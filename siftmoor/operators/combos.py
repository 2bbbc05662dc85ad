"""Combinations: several substrings that must all occur somewhere in one text."""

from pyspark.sql import Column, functions as F

from siftmoor.fixed import detectors as fx
from siftmoor.functions.text import sql_text
from siftmoor.operators.anchors import Anchors
from siftmoor.operators.hits import COMBOS, HIT
from siftmoor.operators.rulebook import COMBO_BASE


def combo_hits(anchors: Anchors) -> Column:
    """``array<hit>`` of a file; needs the columns of ``with_lines``."""
    found = []
    for i, (_, required, *_) in enumerate(fx.COMBOS):
        texts = [text.lower() for text in required]
        present = " AND ".join(
            [anchors.any_of([t]) for t in texts] + [f"contains(lowered, {sql_text(t)})" for t in texts])
        found.append(
            f"CASE WHEN {present} THEN CAST(struct({COMBOS}, {i}, 0, 0, {COMBO_BASE - i}, 0, "
            f"{sql_text(fx.COMBO_LINE)}, {sql_text(' + '.join(required))}, null, null, null) AS {HIT}) END")
    return F.expr(f"array_compact(array({', '.join(found)}))")
