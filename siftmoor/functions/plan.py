"""Help for plans whose columns are costly to compute."""

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns, each computed once per row.

    The optimizer copies the definition of a plain column into every filter above
    it and into loops over array elements.  The output of a generator is left
    alone, so the columns are made the one row of an inline generator.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))
