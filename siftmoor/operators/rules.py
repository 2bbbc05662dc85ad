"""Rule matching: files x rules of their language x lines, first matching line per pattern.

Two plans with the same result:

* ``rule_hits`` has the patterns as a constant of the plan.  A file meets a
  pattern's regular expression only if its text contains one of the pattern's
  anchors (texts that every match contains), and nothing is shuffled.  The pattern
  is searched once in the whole text; the line ends before the first match give
  its line.
* ``matches_by_join`` keeps the patterns as rows of an inverted index: the rarest
  gram (up to GRAM bytes) of each anchor.  Lines are joined on the grams they
  contain, so a line meets only patterns of which it has an anchor's gram; anchors
  and regular expression decide, then the first line per (file, pattern).  It
  serves catalogues too large for a constant: rules stay rows of a table.

A rule for a language and for all languages is in both lists, so a file of that
language gets a hit of each.
"""

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftmoor.fixed import detectors as fx
from siftmoor.functions.regex import prepare, rare_start
from siftmoor.functions.text import fold_case, sql_literal
from siftmoor.operators.anchors import Anchors
from siftmoor.operators.grams import GRAM, gram_filter, gram_length, gram_number, gram_slots, indexed_lines
from siftmoor.operators.hits import HIT, RULES, no_hits
from siftmoor.operators.lines import with_lines
from siftmoor.plans.staging import staged
from siftmoor.sources.catalogue import RulePattern, literal_text

_PREPARED = (
    "rule_ord int, pattern_ord int, pattern string, languages array<string>, parts array<array<string>>, always boolean, "
    "in_text string, java string, anchors array<string>, grams array<bigint>, slots array<bigint>")
_TEXTS = pa.list_(pa.string())
_PREPARED_ARROW = pa.schema([
    ("rule_ord", pa.int32()), ("pattern_ord", pa.int32()), ("pattern", pa.string()), ("languages", _TEXTS), ("parts", pa.list_(_TEXTS)),
    ("always", pa.bool_()), ("in_text", pa.string()), ("java", pa.string()), ("anchors", _TEXTS), ("grams", pa.list_(pa.int64())), ("slots", pa.list_(pa.int64()))])


# SQL for the number of the first matching line of pattern x; null or 0 without one.  The text before the first match
# has as many line ends as there are lines before it; the text is searched once, as its pattern is compiled for each search.
_FIRST_LINE = (
    "CASE WHEN x.always THEN least(size(lines), 1) "
    "WHEN x.in_text IS NULL THEN CAST(array_position(transform(lines, l -> l RLIKE x.java), true) AS INT) "
    "ELSE get(transform(array(split(text, x.in_text, 2)), p -> CASE WHEN size(p) > 1 THEN size(split(p[0], '\\n', -1)) END), 0) END")
_APPLIES = "arrays_overlap(x.languages, array(language, 'all')) AND forall(x.parts, g -> exists(g, t -> contains(folded, t)))"
# The lists a rule is in for a file: 0 is that of the file's language, 1 that for all languages.
_LISTS = (
    "filter(array(CASE WHEN language <> 'all' AND array_contains(y.x.languages, language) THEN 0 END, "
    "CASE WHEN array_contains(y.x.languages, 'all') THEN 1 END), o -> o IS NOT NULL)")
_PATTERN = (
    "struct<rule_ord:int,pattern_ord:int,pattern:string,languages:array<string>,parts:array<array<string>>,"
    "always:boolean,in_text:string,java:string>")


def rule_hits(patterns: list[RulePattern], anchors: Anchors) -> Column:
    """``array<hit>`` of a file; needs the columns of ``with_lines``.

    The anchors that occur in the file lead to the patterns that may match, so the work of a file grows with these and
    not with the catalogue.
    """
    if not patterns:
        return no_hits()
    by_anchor, without = defaultdict(list), []
    for i, p in enumerate(patterns):
        for anchor in sorted({rare_start(a) for a in p.prepared.anchors}):
            by_anchor[anchor].append(i)
        if not p.prepared.anchors:
            without.append(i)
    table = sql_literal([
        {"rule_ord": p.rule.rule_ord, "pattern_ord": p.pattern_ord, "pattern": p.pattern, "languages": p.rule.languages, "parts": p.prepared.parts,
         "always": p.prepared.always, "in_text": p.prepared.in_text, "java": p.prepared.java} for p in patterns], f"array<{_PATTERN}>")
    found = f"flatten(transform(found, a -> coalesce(try_element_at({sql_literal(by_anchor, 'map<string,array<int>>')}, a), array())))"
    ids = f"array_distinct(concat({sql_literal(without, 'array<int>')}, {found}))"
    may_match = f"filter(transform({ids}, i -> get({table}, i)), x -> {_APPLIES})"
    matches = f"filter(transform({may_match}, x -> named_struct('x', x, 'n', {_FIRST_LINE})), y -> y.n > 0)"
    as_hit = (
        f"CAST(struct({RULES}, o, y.x.rule_ord, y.x.pattern_ord, y.x.rule_ord, y.n, "
        f"substring(get(lines, y.n - 1), 1, {fx.RULE_LINE_CHARS}), y.x.pattern, null, null, null) AS {HIT})")
    return F.expr(f"coalesce(flatten(transform({matches}, y -> transform({_LISTS}, o -> {as_hit}))), CAST(array() AS array<{HIT}>))")


def prepared_patterns(rules: DataFrame, literal_mode: str = "strict") -> DataFrame:
    """The usable patterns of a catalogue table as rows, made ready in tasks: the fields of ``rule_hits``' patterns, ``anchors``,
    the grams by which they are indexed, and the grams' places in the filter."""
    ready, usable = prepare.__wrapped__, literal_text

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                p = ready(usable(row["pattern"], row["type"], literal_mode), row["type"])
                if p is not None:
                    grams = sorted({gram_number(rare_start(text, GRAM)[:GRAM].encode()) for text in p.anchors})
                    rows.append({"rule_ord": row["rule_ord"], "pattern_ord": row["pattern_ord"], "pattern": row["pattern"], "languages": row["languages"],
                                 "parts": [list(g) for g in p.parts], "always": p.always, "in_text": p.in_text, "java": p.java, "anchors": list(p.anchors),
                                 "grams": grams, "slots": gram_slots(grams)})
            yield pa.RecordBatch.from_pylist(rows, schema=_PREPARED_ARROW)

    each = rules.select("rule_ord", "languages", F.posexplode("match_patterns").alias("pattern_ord", "m"))
    return each.select("rule_ord", "pattern_ord", "languages", "m.pattern", "m.type").mapInArrow(made, _PREPARED)


def matches_by_join(file_text: DataFrame, rules: DataFrame, literal_mode: str = "strict") -> DataFrame:
    """(repo_id, path, hit) by joins with a catalogue table (the schema of ``rules_table``) of any size.

    Patterns never leave their rows: the index is joined on grams, and patterns without anchors, which must be tried on
    every file they apply to, on the language.  Spark broadcasts either where its size allows.
    """
    patterns = staged(prepared_patterns(rules, literal_mode), "patterns")
    index = patterns.withColumn("gram", F.explode("grams"))
    lengths = [r.n for r in index.select(gram_length(F.col("gram")).alias("n")).distinct().collect()]       # GRAM at most
    filled = gram_filter(patterns.select(F.explode("slots").alias("slot")))
    per_line = indexed_lines(file_text, filled, sorted(lengths)).withColumn("folded", fold_case(F.lower("line")))
    matches = F.expr("arrays_overlap(languages, array(language, 'all')) AND exists(anchors, a -> contains(folded, a)) AND line RLIKE java")
    met = per_line.join(index.select("gram", "rule_ord", "pattern_ord", "pattern", "java", "anchors", "languages"), "gram").where(matches)
    found = met.select("repo_id", "path", "language", "languages", "rule_ord", "pattern_ord", "pattern", "line_number",
                       F.substring("line", 1, fx.RULE_LINE_CHARS).alias("line"))
    plain = patterns.where(F.size("anchors") == 0).select(F.struct("*").alias("x"), F.explode(F.array_distinct("languages")).alias("list"))
    lists = F.expr("explode(array_distinct(array(language, 'all')))").alias("list")
    tried = with_lines(file_text, code=False).select("*", lists).join(plain, "list").withColumn("n", F.expr(_FIRST_LINE)).where("n > 0")
    found = found.unionByName(tried.select(
        "repo_id", "path", "language", "x.languages", "x.rule_ord", "x.pattern_ord", "x.pattern", F.col("n").alias("line_number"),
        F.substring(F.get("lines", F.col("n") - 1), 1, fx.RULE_LINE_CHARS).alias("line")))
    ords = F.filter(F.array(F.when(F.array_contains("languages", F.col("language")) & (F.col("language") != "all"), 0),
                            F.when(F.array_contains("languages", F.lit("all")), 1)), lambda o: o.isNotNull())
    first = found.withColumn("list_ord", F.explode(ords)).groupBy("repo_id", "path", "list_ord", "rule_ord", "pattern_ord", "pattern").agg(
        F.min_by(F.struct("line_number", "line"), "line_number").alias("m"))
    none = F.lit(None)
    return first.select("repo_id", "path", F.struct(
        F.lit(RULES), "list_ord", "rule_ord", "pattern_ord", "rule_ord", "m.line_number", "m.line", "pattern",
        none, none, none).cast(HIT).alias("hit"))
