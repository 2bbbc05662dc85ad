"""Shannon entropy of a string, as a column."""

from pyspark.sql import Column, functions as F

from siftmoor.functions.text import let


def _characters(text: Column) -> Column:
    return F.array_distinct(F.split(text, ""))


def _shrink(acc: Column, ch: Column, size: Column) -> Column:
    """``acc<rest, bits>`` without a character, and with its part of the entropy of a text of ``size`` characters."""
    def weigh(rest):
        share = (F.octet_length(acc["rest"]) - F.octet_length(rest)) / F.octet_length(ch) / size
        return let(share, lambda s: F.struct(
            rest.alias("rest"), F.when(s > 0, acc["bits"] - s * F.log2(s)).otherwise(acc["bits"]).alias("bits")))

    return let(F.replace(acc["rest"], ch, F.lit("")), weigh)


def _start(text: Column) -> Column:
    return F.struct(text.alias("rest"), F.lit(0.0).alias("bits"))


def _bits(text: Column, characters: Column) -> Column:
    """A character leaves the text when it is counted, so that the text gets shorter with each."""
    return let(F.length(text), lambda size: F.aggregate(
        characters, _start(text), lambda acc, ch: _shrink(acc, ch, size), lambda acc: acc["bits"]))


# Frequent characters of prose and code; which ones they are changes no result.
_FREQUENT = " eainrtos"


def at_most(text: Column) -> Column:
    """A bound from above: the shares of a few characters as they are, all others as if equally frequent."""
    def bound(size):
        frequent = F.expr(f"split('{_FREQUENT}', '')")
        counted = F.aggregate(frequent, _start(text), lambda acc, ch: _shrink(acc, ch, size))
        return let(counted, lambda x: let(F.length(x["rest"]) / size, lambda left: x["bits"] + F.when(
            left > 0, left * F.log2(F.size(_characters(x["rest"])) / left)).otherwise(0.0)))

    return let(F.greatest(F.length(text), F.lit(1)), bound)


def shannon(text: Column) -> Column:
    """Bits per character; 0 for the empty string."""
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(let(_characters(text), lambda cs: _bits(text, cs)))


def shannon_at_least(text: Column, floor: float) -> Column:
    """The entropy, or 0 where a bound rules out reaching ``floor``."""
    exact = let(_characters(text), lambda cs: _bits(text, cs))
    return F.when(at_most(text) < floor - 1e-6, F.lit(0.0)).otherwise(exact)
