"""Findings: hits with their rule texts, merged per line and category, and ranked.

All of it works per file, so one shuffle by (repo_id, path) serves the merge,
the ranking and the file score.  What is shuffled are thin hits, never texts.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftmoor.operators.rulebook import fill

FILE = ["repo_id", "path"]
SEQ = ["a", "k1", "k2", "k3"]
FINDING_COLUMNS = [
    "repo_id", "path", "rule_id", "name", "category", "subcategory", "severity", "weight", "description",
    "user_message", "file_path", "line_number", "line_content", "matched_pattern", "mitre_attack", "confidence",
    "context_multiplier", "effective_weight",
]


def effective_weight(weight: Column, confidence: Column, multiplier: Column) -> Column:
    return weight * confidence * multiplier


def weigh(hits: DataFrame, book: DataFrame) -> DataFrame:
    """Hits with rule id, category, severity and effective weight.

    A small rule book is marked for broadcast by ``rule_book``.
    """
    thin = book.select("def_id", "rule_id", "category", "severity", "weight",
                       F.col("confidence").alias("book_confidence"), "context_multiplier")
    confidence = F.coalesce("confidence", "book_confidence")
    weight = effective_weight(F.col("weight"), confidence, F.col("context_multiplier"))
    joined = hits.join(thin, "def_id", "left")
    return joined.select(
        *[c for c in hits.columns if c != "confidence"], "rule_id", "category", "severity", "weight",
        "context_multiplier", confidence.alias("confidence"), weight.alias("effective_weight"))


def line_key() -> Column:
    """All combinations of a file share one key, so at most one of them stays."""
    return F.when(F.col("rule_id").startswith("COMBO-"), -1).otherwise(F.col("line_number"))


def rank(weighed: DataFrame) -> DataFrame:
    """Adds ``kept`` (survives the merge), ``key_seq`` and ``occurrence``.

    The heaviest finding of a (line, category) stays, the earliest one on a tie.
    ``key_seq`` is the place where the (line, category) first occurred; it orders
    findings that are otherwise equal.  ``occurrence`` counts the kept findings of
    a rule in the file from the heaviest on.
    """
    return rank_in_place(weighed.repartition(*FILE))


def rank_in_place(weighed: DataFrame) -> DataFrame:
    """``rank`` of hits of which those of one file already share a partition."""
    key = Window.partitionBy(*FILE, line_key(), "category").orderBy(F.desc("effective_weight"), *SEQ)
    whole = key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = weighed.withColumns({
        "place": F.row_number().over(key), "key_seq": F.min(F.struct(*SEQ)).over(whole)})
    kept = (F.col("place") == 1) & F.col("rule_id").isNotNull()
    rule = Window.partitionBy(*FILE, kept, "rule_id").orderBy(F.desc("effective_weight"), "line_number", "key_seq")
    return placed.withColumns({"kept": kept, "occurrence": F.row_number().over(rule)})


def with_texts(weighed: DataFrame, book: DataFrame) -> DataFrame:
    """The full finding columns of weighed hits."""
    texts = book.select("def_id", "name", "subcategory", "description", "user_message", "mitre_attack")
    filled = {c: fill(F.col(c), F.col("detail"), F.col("detail2")) for c in ("name", "description", "user_message")}
    return weighed.join(texts, "def_id").withColumns({**filled, "file_path": F.col("path")})


def raw_findings(analysis: DataFrame, book: DataFrame) -> DataFrame:
    """Every hit of every detector as a finding, before the merge; ``a, k1, k2, k3`` give detector order."""
    hits = analysis.select(*FILE, F.inline("hits"))
    return with_texts(weigh(hits, book), book).select(*FINDING_COLUMNS, *SEQ)


def shared(rows: DataFrame) -> DataFrame:
    """Rows of one file brought together, for several results to read.

    The columns travel as one value, which the optimizer cannot cut to what a single
    result needs; so all results of a plan have the same shuffle in them, which runs
    once, and everything below it as well.
    """
    columns = F.struct(*[c for c in rows.columns if c not in FILE])
    packed = rows.select(*FILE, F.array(columns).alias("packed")).repartition(*FILE)
    return packed.select(*FILE, F.inline("packed"))


def findings(analysis: DataFrame, book: DataFrame) -> DataFrame:
    """Merged findings.  Order within a file: line_number, effective_weight descending, key_seq."""
    hits = analysis.select(*FILE, F.inline("hits"))
    return kept_findings(rank(weigh(hits, book)), book)


def kept_findings(ranked: DataFrame, book: DataFrame) -> DataFrame:
    """The findings among ranked hits."""
    return with_texts(ranked.where("kept"), book).select(*FINDING_COLUMNS, "key_seq", "occurrence")
