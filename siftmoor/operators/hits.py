"""Hits: what a detector reports for one file, before rule texts are joined on.

A hit is thin.  It names its rule by ``def_id`` (a row of the rule book), keeps
its place in detector order (``a`` detector, ``k1..k3`` within it) and what varies
from hit to hit.  Names, categories, weights and messages come from the rule
book, which is small and broadcast.
"""

from pyspark.sql import Column, functions as F

HIT = (
    "struct<a:int,k1:int,k2:int,k3:int,def_id:int,line_number:int,line_content:string,"
    "matched_pattern:string,detail:string,detail2:string,confidence:double>"
)
RULES, COMBOS, SYNTAX, ENTROPY, PERMISSION, NETWORK = range(6)


def hit(a, k1, k2, k3, def_id, line_number, line_content, matched_pattern, detail=None, detail2=None,
        confidence=None) -> Column:
    fields = dict(a=a, k1=k1, k2=k2, k3=k3, def_id=def_id, line_number=line_number,
                  line_content=line_content, matched_pattern=matched_pattern, detail=detail,
                  detail2=detail2, confidence=confidence)
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]).cast(HIT)


def no_hits() -> Column:
    return F.array().cast(f"array<{HIT}>")
