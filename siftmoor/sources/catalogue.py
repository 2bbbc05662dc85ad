"""Rule catalogues: the default one, a directory of rule files, or a table.

A catalogue is control data.  It is read on the driver, because its patterns
become literals of the plan.
"""

import json
import re
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftmoor.fixed.rules import RULES
from siftmoor.functions.regex import Prepared, prepare

RULE_SCHEMA = (
    "rule_ord int, rule_id string, name string, category string, subcategory string, severity string, "
    "weight int, languages array<string>, description string, user_message string, mitre_attack string, "
    "false_positive_note string, match_patterns array<struct<pattern:string,type:string>>"
)


@dataclass(frozen=True)
class Rule:
    rule_ord: int
    rule_id: str
    name: str
    category: str
    subcategory: str
    severity: str
    weight: int
    languages: tuple[str, ...]
    description: str
    user_message: str
    mitre_attack: str
    false_positive_note: str
    match_patterns: tuple[tuple[str, str], ...]   # (pattern, type)


@dataclass(frozen=True)
class RulePattern:
    rule: Rule
    pattern_ord: int
    pattern: str
    type: str
    prepared: Prepared


def default_rules() -> list[Rule]:
    rules, header, patterns = [], None, []

    def close():
        if header:
            rule_id, name, group, grade, languages, mitre = [part.strip() for part in header.split(" | ")]
            category, subcategory = group.split("/")
            severity, weight = grade.split()
            rules.append(Rule(
                len(rules), rule_id, name, category, subcategory, severity, int(weight),
                tuple(languages.split(",")), f"{name} ({category}, {subcategory})",
                f"{severity.upper()}: {name}; review this line", mitre, "", tuple(patterns)))

    for line in RULES.splitlines():
        if line.startswith("  "):
            kind, pattern = line.strip().split(" ", 1)
            patterns.append((pattern, {"re": "regex", "lit": "literal"}[kind]))
        elif line and not line.startswith("#"):
            close()
            header, patterns = line, []
    close()
    return rules


def _from_records(records, start: int) -> list[Rule]:
    rules = []
    for record in records:
        patterns = tuple((m.get("pattern", ""), m.get("type", "literal")) for m in record.get("match_patterns", []))
        if not patterns:
            continue
        rules.append(Rule(
            start + len(rules),
            record.get("id", "UNKNOWN"), record.get("name", "Unknown Pattern"),
            record.get("category", "unknown"), record.get("subcategory", "unknown"),
            record.get("severity", "info"), int(record.get("weight", 0)),
            tuple(record.get("languages", ["all"])), record.get("description", ""),
            record.get("user_message", ""), record.get("mitre_attack", ""),
            record.get("false_positive_note", ""), patterns))
    return rules


def _parse(path: Path):
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError(f"PyYAML is needed to read {path.name}; JSON rule files need nothing extra") from error
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise ValueError(str(error)) from error


def read_rules(directory: str) -> list[Rule]:
    """Rules of all ``.yaml``, ``.yml`` and ``.json`` files by file name; unusable files are skipped."""
    rules: list[Rule] = []
    root = Path(directory)
    if not root.is_dir():
        return rules
    for path in sorted(root.iterdir(), key=lambda p: p.name):
        if path.suffix not in (".yaml", ".yml", ".json"):
            continue
        try:
            data = _parse(path)
        except (OSError, ValueError):
            continue
        if isinstance(data, dict) and "patterns" in data:
            rules.extend(_from_records(data["patterns"], len(rules)))
    return rules


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Rules of a table with the rule schema (the control table of a deployment, read to the driver)."""
    return [
        Rule(**{**row.asDict(recursive=False), "languages": tuple(row.languages),
                "match_patterns": tuple((m.pattern, m.type) for m in row.match_patterns)})
        for row in table.select(*[f.name for f in fields(Rule)]).orderBy("rule_ord").collect()
    ]


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [tuple(list(v) if isinstance(v, tuple) else v for v in r.__dict__.values()) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def literal_text(pattern: str, kind: str, literal_mode: str) -> str:
    """The pattern as it is meant: ``unescape`` reads a literal's backslash escapes as the plain character."""
    return re.sub(r"\\(.)", r"\1", pattern) if kind != "regex" and literal_mode == "unescape" else pattern


def rule_patterns(rules: list[Rule], literal_mode: str = "strict") -> list[RulePattern]:
    """Usable patterns in catalogue order; patterns that do not compile are left out.

    ``literal_mode="unescape"`` reads a literal's backslash escapes (``\\.``) as the
    plain character, so that literals written like regular expressions match.
    """
    usable = []
    for rule in rules:
        for pattern_ord, (pattern, kind) in enumerate(rule.match_patterns):
            ready = prepare(literal_text(pattern, kind, literal_mode), kind)
            if ready:
                usable.append(RulePattern(rule, pattern_ord, pattern, kind, ready))
    return usable


def unusable_patterns(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule_ord, pattern_ord, pattern) of the patterns that ``rule_patterns`` leaves out."""
    rows = [(rule.rule_ord, i, pattern) for rule in rules
            for i, (pattern, kind) in enumerate(rule.match_patterns) if prepare(pattern, kind) is None]
    return spark.createDataFrame(rows, "rule_ord int, pattern_ord int, pattern string")


def rules_for_language(table: DataFrame, language: str) -> DataFrame:
    """Rules of one language, then the rules for all languages, each in catalogue order."""
    own = table.where(F.array_contains("languages", language)).withColumn("list_ord", F.lit(0))
    every = table.where(F.array_contains("languages", "all")).withColumn("list_ord", F.lit(1))
    return own.unionByName(every).orderBy("list_ord", "rule_ord")


def rules_by_category(table: DataFrame, category: str) -> DataFrame:
    return table.where(F.col("category") == category).orderBy("rule_ord")


def categories(table: DataFrame) -> DataFrame:
    return table.select("category").distinct().orderBy("category")


def languages(table: DataFrame) -> DataFrame:
    return table.select(F.explode("languages").alias("language")).distinct().orderBy("language")
