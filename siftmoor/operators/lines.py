"""The line relation, and the per-file columns that every detector shares."""

from pyspark.sql import Column, DataFrame, functions as F

from siftmoor.fixed import detectors as fx
from siftmoor.functions.plan import computed_once
from siftmoor.functions.text import fold_case, split_lines, starts_with_any, strip
from siftmoor.operators.anchors import Anchors


def with_lines(file_text: DataFrame, anchors: Anchors | None = None, code: bool = True) -> DataFrame:
    """Adds the columns all detectors read, computed once per file.

    ``lines``; ``code``, the ``array<struct<n, s>>`` of the stripped lines that are
    neither empty nor a comment, with their numbers; ``lowered``, the lower-case
    text; ``folded``, for substring tests without regard to case; ``found``, the
    anchors that occur.  Without anchors, ``lines`` and ``code`` alone; rules do
    without ``code``.
    """
    numbered = F.transform("lines", lambda line, i: F.struct((i + 1).alias("n"), strip(line).alias("s")))
    code_lines = {"code": F.filter(numbered, lambda x: is_code(x["s"]))} if code else {}
    split = {"lines": split_lines(F.col("text"))}
    if anchors is None:
        return computed_once(computed_once(file_text, split), code_lines)
    shared = computed_once(
        computed_once(file_text, {**split, "lowered": F.lower("text")}),
        {**code_lines, "folded": fold_case(F.col("lowered"))})
    return computed_once(shared, {"found": anchors.found()})


def is_code(line: Column) -> Column:
    return (line != "") & ~starts_with_any(line, fx.COMMENTS)


def lines(file_text: DataFrame) -> DataFrame:
    """One row per line; numbers start at 1."""
    numbered = file_text.select("repo_id", "path", "language", F.posexplode(split_lines(F.col("text"))))
    return numbered.select("repo_id", "path", "language", (F.col("pos") + 1).alias("line_number"),
                           F.col("col").alias("line"))
