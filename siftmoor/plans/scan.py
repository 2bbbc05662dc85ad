"""Whole scans: texts in; findings, file scores and repository verdicts out."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from siftmoor.functions.plan import computed_once
from siftmoor.operators.anchors import Anchors
from siftmoor.operators.combos import combo_hits
from siftmoor.operators.entropy import elevated_strings, entropy_hits, obfuscation_score
from siftmoor.operators.hits import no_hits
from siftmoor.operators.lines import with_lines
from siftmoor.operators.merge import FILE, kept_findings, rank_in_place, shared, weigh
from siftmoor.operators.network import network_hits, network_indicators, network_items
from siftmoor.operators.permissions import permission_hits, permission_labels
from siftmoor.operators.risk import file_and_hit_rows, repo_results, scored_files
from siftmoor.operators.rulebook import rule_book
from siftmoor.operators.rules import matches_by_join, rule_hits
from siftmoor.operators.syntax import syntax_facts, syntax_hits
from siftmoor.plans.staging import staged
from siftmoor.sources.catalogue import Rule, default_rules, rule_patterns, rules_table


def analyze(file_text: DataFrame, rules: list[Rule] | DataFrame | None = None, deep: bool = False,
            literal_mode: str = "strict", plan: str = "literal") -> DataFrame:
    """One row per file with all its hits.

    ``file_text(repo_id, path, language, file_size, text, scan_error)`` is read once:
    every detector works on the file's own row, so no text is ever shuffled.
    ``deep`` adds the Python syntax detector.  ``plan="join"`` joins rule patterns as
    rows, with the same hits; choose it for catalogues of thousands of patterns.
    Rules may be a table for it (see ``rules_table``), which is never collected.
    """
    if plan not in ("literal", "join"):
        raise ValueError(f"no such plan: {plan}")
    catalogue = default_rules() if rules is None else rules
    in_plan = plan == "literal"
    if in_plan and isinstance(catalogue, DataFrame):
        raise ValueError("a table of rules needs plan=\"join\"; rules_from_table makes a list of a small one")
    patterns = rule_patterns(catalogue, literal_mode) if in_plan else []
    table = catalogue if in_plan or isinstance(catalogue, DataFrame) else rules_table(file_text.sparkSession, catalogue)
    anchors = Anchors(patterns if in_plan else [])
    if deep:
        file_text = file_text.withColumn("facts", syntax_facts(F.col("language"), F.col("text")))
    keep = [*FILE, "language", "file_size", "scan_error"]
    detected = computed_once(with_lines(file_text, anchors), {
        "line_count": F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")),
        "rule_hits": rule_hits(patterns, anchors) if in_plan else no_hits(),
        "combo_hits": combo_hits(anchors),
        "syntax_hits": syntax_hits(F.col("facts")) if deep else no_hits(),
        "elevated": F.coalesce(elevated_strings(), F.array().cast(
            "array<struct<n:int,i:int,line:string,e:double>>")),
        "permission_hits": permission_hits(anchors),
        "network_items": network_items(anchors),
    })
    analysis = detected.select(
        *keep, "line_count",
        obfuscation_score(F.col("elevated"), F.col("line_count")).alias("obfuscation_score"),
        permission_labels(F.col("permission_hits")).alias("permissions_detected"),
        network_indicators(F.col("network_items")).alias("network_indicators"),
        F.concat("rule_hits", "combo_hits", "syntax_hits", entropy_hits(F.col("elevated")),
                 "permission_hits", network_hits(F.col("network_items"))).alias("hits"),
    )
    return analysis if in_plan else _add_hits(analysis, matches_by_join(file_text, table, literal_mode))


def _add_hits(analysis: DataFrame, matches: DataFrame) -> DataFrame:
    """Adds hits that were found by a join (at most one per file and pattern) to the files' own."""
    per_file = matches.groupBy(*FILE).agg(F.array_sort(F.collect_list("hit")).alias("joined"))
    both = analysis.join(per_file, FILE, "left")
    return both.withColumn("hits", F.concat(F.coalesce("joined", no_hits()), "hits")).drop("joined")


@dataclass(frozen=True)
class Scan:
    analysis: DataFrame
    findings: DataFrame
    files: DataFrame
    repos: DataFrame

    def whole(self) -> DataFrame:
        """All results as one relation: ``result`` says which of ``finding``, ``file`` and ``repo`` a row has.

        Its plan reads the texts once, with or without a shared folder.
        """
        parts = [
            table.select(F.lit(name).alias("result"), "repo_id", F.col("path") if "path" in table.columns else F.lit(None).cast("string").alias("path"),
                         F.struct(*[c for c in table.columns if c not in FILE]).alias(name))
            for name, table in (("finding", self.findings), ("file", self.files), ("repo", self.repos))]
        both = parts[0].unionByName(parts[1], allowMissingColumns=True)
        return both.unionByName(parts[2], allowMissingColumns=True)


def scan(file_text: DataFrame, rules: list[Rule] | DataFrame | None = None, deep: bool = False,
         repos: DataFrame | None = None, literal_mode: str = "strict", stage: bool = True, plan: str = "literal") -> Scan:
    """All results of a scan.

    The hits (small next to the texts) are shuffled once by file, and findings, file
    scores and verdicts all start from there.  With ``stage`` the hits are also
    written once to the shared folder of ``spark.checkpoint.dir``, so that results
    that run as separate jobs read them; without, or where no folder is set, each
    job scans the texts once, and ``Scan.whole`` gives all results in one job.
    """
    spark = file_text.sparkSession
    catalogue = default_rules() if rules is None else rules
    book = rule_book(spark, catalogue)
    analysis = analyze(file_text, catalogue, deep, literal_mode, plan)
    if stage:
        analysis = staged(analysis, "analysis")
    ranked = rank_in_place(shared(weigh(file_and_hit_rows(analysis), book)))
    files = scored_files(ranked)
    if stage:
        files = staged(files, "files")
    return Scan(analysis, kept_findings(ranked, book), files, repo_results(files, repos))


def write_scan(result: Scan, target: str) -> None:
    """Writes ``findings``, ``files`` and ``repos`` as parquet tables below ``target``."""
    for name in ("findings", "files", "repos"):
        getattr(result, name).write.mode("errorifexists").parquet(f"{target}/{name}")


def write_whole(result: Scan, target: str) -> None:
    """Writes all results in one job, with a folder below ``target`` for each kind."""
    result.whole().write.mode("errorifexists").partitionBy("result").parquet(target)
