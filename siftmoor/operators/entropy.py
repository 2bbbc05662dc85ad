"""Entropy of string candidates, and the obfuscation score of a file."""

from pyspark.sql import Column, DataFrame, functions as F

from siftmoor.fixed import detectors as fx
from siftmoor.functions.entropy import shannon, shannon_at_least
from siftmoor.functions.regex import to_java
from siftmoor.functions.text import let
from siftmoor.operators.hits import ENTROPY, hit
from siftmoor.operators.rulebook import ENTROPY_HIGH_ID, ENTROPY_MED_ID

# the start of a run of token characters long enough for any token candidate (hex tokens included)
_RUN = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{30}"


def strings_of_line(line: Column, may_have_token: Column) -> Column:
    """Candidates of a stripped line: quoted strings, base64 and hex tokens, else a long line itself."""
    none = F.array().cast("array<string>")
    quoted = F.when(
        line.contains('"') | line.contains("'"),
        F.transform(F.regexp_extract_all(line, F.lit(fx.QUOTED), F.lit(0)),
                    lambda s: F.substring(s, F.lit(2), F.length(s) - 2)),
    ).otherwise(none)
    tokens = F.concat(
        F.regexp_extract_all(line, F.lit(to_java(fx.BASE64_TOKEN, "")), F.lit(0)),
        F.regexp_extract_all(line, F.lit(to_java(fx.HEX_TOKEN, "")), F.lit(0)))
    return let(
        F.concat(quoted, F.when(may_have_token & line.rlike(_RUN), tokens).otherwise(none)),
        lambda found: F.when(F.size(found) > 0, found)
        .when(F.length(line) >= fx.WHOLE_LINE_LENGTH, F.array(line))
        .otherwise(none))


def is_scanned(line: Column) -> Column:
    """Of code lines: those long enough and not opening with a further comment prefix."""
    return (F.length(line) >= fx.ENTROPY_MIN_LENGTH) & ~line.startswith(fx.ENTROPY_COMMENT)


def _strings() -> Column:
    """``array<struct<n, i, s, line>>`` of the candidates of a file; needs the columns of ``with_lines``."""
    def of_file(may_have_token):
        def of_line(x):
            line = x["s"]
            return F.transform(strings_of_line(line, may_have_token), lambda text, k: F.struct(
                x["n"].alias("n"), k.alias("i"), text.alias("s"),
                F.substring(line, 1, fx.RULE_LINE_CHARS).alias("line")))

        return F.flatten(F.transform(F.filter("code", lambda x: is_scanned(x["s"])), of_line))

    return let(F.col("text").rlike(_RUN), of_file)


def candidates(shared: DataFrame) -> DataFrame:
    """One row per candidate string with its entropy, from the output of ``with_lines``."""
    found = shared.select("repo_id", "path", F.inline(_strings()))
    return found.select("repo_id", "path", F.col("n").alias("line_number"), F.col("i").alias("candidate"),
                        F.col("s").alias("string"), shannon(F.col("s")).alias("entropy"))


def elevated_strings() -> Column:
    """``array<struct<n, i, line, e>>`` of the candidates at or above the lower threshold."""
    measured = F.transform(
        _strings(),
        lambda x: F.struct(x["n"].alias("n"), x["i"].alias("i"), x["line"].alias("line"),
                           shannon_at_least(x["s"], fx.ENTROPY_HIGH).alias("e")))
    return F.filter(measured, lambda x: x["e"] >= fx.ENTROPY_HIGH)


def confidence(entropy: Column) -> Column:
    scaled = (entropy - 4.0) / 2.0
    return F.when(entropy >= fx.ENTROPY_VERY_HIGH, F.least(F.lit(1.0), scaled)).otherwise(
        F.least(F.lit(0.8), scaled))


def entropy_hits(elevated: Column) -> Column:
    def as_hit(x):
        e = x["e"]
        return hit(
            ENTROPY, x["n"], x["i"], 0,
            F.when(e >= fx.ENTROPY_VERY_HIGH, ENTROPY_HIGH_ID).otherwise(ENTROPY_MED_ID),
            x["n"], x["line"], F.format_string("entropy=%.2f", F.bround(e, 2)),
            F.format_string("%.2f", F.bround(e, 2)), F.format_string("%.1f", F.bround(e, 1)), confidence(e))

    return F.transform(elevated, as_hit)


def score(count: Column, average: Column, total_lines: Column) -> Column:
    """Obfuscation 0-100 from the number and mean entropy of elevated strings and the number of lines."""
    share = F.least(F.lit(40.0), count / F.greatest(total_lines, F.lit(1)) * 400)
    level = F.least(F.lit(40.0), (average - 4.0) * 20)
    extra = F.least(F.lit(20.0), count * 4.0)
    return F.when(count == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), share + level + extra))


def obfuscation_score(elevated: Column, total_lines: Column) -> Column:
    total = F.aggregate(elevated, F.lit(0.0), lambda acc, x: acc + x["e"])
    count = F.size(elevated)
    return score(count, total / F.nullif(count, F.lit(0)), total_lines)
