"""Rounding for reports."""

from pyspark.sql import Column, functions as F

from siftmoor.functions.text import let


def round_one(x: Column) -> Column:
    """A non-negative double to one decimal, judged by its exact binary value, ties to even.

    Spark rounds the shortest decimal form of a double instead, which differs for
    values such as 0.15 (in binary a little below the tie).
    """
    def rounded(v):
        tenths, tie = v["tenths"], v["tie"]
        # sign of (tie - its exact decimal value): the products are exact, and so are the differences
        whole = F.floor(tie)
        part, target = tie - whole, tenths * 2 + 1 - whole * 20
        above = (part * 16 - target) + part * 4
        up = (x > tie) | ((x == tie) & ((above > 0) | ((above == 0) & (tenths % 2 == 1))))
        return (tenths + up.cast("int")) / F.lit(10.0)

    tenths = F.floor(x * 10)
    return let(F.struct(tenths.alias("tenths"), ((tenths * 2 + 1) / F.lit(20.0)).alias("tie")), rounded)


def human_size(size: Column) -> Column:
    def scaled(unit: str, power: int) -> Column:
        return F.format_string(f"%.1f {unit}", round_one(size / F.lit(float(1024 ** power))))

    return (
        F.when(size < 1024, F.format_string("%d B", size.cast("long")))
        .when(size < 1024 ** 2, scaled("KB", 1))
        .when(size < 1024 ** 3, scaled("MB", 2))
        .otherwise(scaled("GB", 3))
    )
