"""Reports: nested rows, JSON output and the top-k views."""

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftmoor.functions.numbers import round_one
from siftmoor.functions.text import shorten_path
from siftmoor.operators.merge import FILE

TOP_FILES, TOP_FINDINGS, PREVIEW = 15, 4, 5

FINDING_FIELDS = ["rule_id", "name", "category", "subcategory", "severity", "weight", "description", "user_message",
                  "file_path", "line_number", "line_content", "matched_pattern", "mitre_attack", "confidence",
                  "context_multiplier"]


def file_records(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One record per file with its findings, ordered by line, weight and place.

    A file is one row already, so its findings make a bounded list.
    """
    order = F.struct("line_number", (-F.col("effective_weight")).alias("w"), "key_seq", *[
        f for f in FINDING_FIELDS if f != "line_number"])
    lists = findings.groupBy(*FILE).agg(F.sort_array(F.collect_list(order)).alias("sorted"))
    joined = files.join(lists, FILE, "left")
    ordered = F.transform("sorted", lambda x: F.struct(*[x[f].alias(f) for f in FINDING_FIELDS]))
    empty = F.array().cast(joined.select(ordered.alias("x")).schema["x"].dataType)
    return joined.select(
        "repo_id", F.col("path").alias("file_path"), F.col("path").alias("relative_path"), "language", "file_size",
        "risk_score", F.coalesce(ordered, empty).alias("findings"), "permissions_detected", "network_indicators",
        "obfuscation_score", "scan_error", "finding_count", "critical_count", "high_count", "severity_label",
        "top_finding_id")


def repo_records(repos: DataFrame, timestamp: Column | None = None, duration: Column | None = None,
                 url: Column | None = None, name: Column | None = None) -> DataFrame:
    """One record per repository: metadata, summary and file types.

    Skipped files are always reported as 0; ``admission.skipped`` has them with their reasons.
    """
    moment = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return repos.select(
        "repo_id",
        F.struct(
            (moment if timestamp is None else timestamp).alias("timestamp"),
            (F.col("repo_id") if url is None else url).alias("target_url"),
            (F.col("repo_id") if name is None else name).alias("target_name"),
            F.round(F.lit(0.0) if duration is None else duration, 2).alias("duration_seconds")).alias("metadata"),
        F.struct(
            round_one(F.col("overall_risk_score")).alias("overall_risk_score"), "risk_level", "verdict",
            F.col("summary_message").alias("verdict_message"), F.col("total_files_scanned").alias("files_scanned"),
            F.lit(0).alias("files_skipped"), "total_findings", "critical_findings", "high_findings",
            "all_permissions").alias("summary"),
        "file_type_breakdown")


def nested_rows(repos: DataFrame, files: DataFrame, findings: DataFrame, **metadata) -> DataFrame:
    """The nested report as rows: one with the summary of each repository, then one per file with its findings.

    Sorted by ``repo_id, place, relative_path`` they read as the nested record; no repository is held in one row, so it may
    have any number of files.  ``result`` is null in summary rows, the other records are null in file rows.
    """
    records = file_records(files, findings)
    fields = [c for c in records.columns if c not in ("repo_id", "relative_path")]
    results = records.select("repo_id", F.lit(1).alias("place"), "relative_path", F.struct(*fields).alias("result"))
    summaries = repo_records(repos, **metadata).withColumn("place", F.lit(0))
    return summaries.unionByName(results, allowMissingColumns=True)


def write_json(repos: DataFrame, files: DataFrame, findings: DataFrame, target: str, **metadata) -> None:
    """JSON lines below ``target``: ``summary`` (a record per repository), ``results`` (a record per file).

    Both are written by one job below a folder of its own beside ``target``, which gets its name only when all of it is
    there: a job that fails leaves no report, and none that is there already is touched.
    """
    spark = repos.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    storage = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if storage.exists(path):
        raise FileExistsError(target)
    keep = {"ignoreNullFields": "false"}
    records = [("summary", repo_records(repos, **metadata)), ("results", file_records(files, findings))]
    lines = [rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*rows.columns), keep).alias("value")) for kind, rows in records]
    staged = f"{target.rstrip('/')}.staged-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    try:
        lines[0].unionByName(lines[1]).write.partitionBy("kind").text(staged)
        for kind, _ in records:
            at, made = (spark._jvm.org.apache.hadoop.fs.Path(folder, name) for name in (kind, f"kind={kind}"))
            if not (storage.rename(made, at) if storage.exists(made) else storage.mkdirs(at)):
                raise OSError(f"cannot write {at}")
        if storage.exists(path) or not storage.rename(folder, path):
            raise FileExistsError(target)
    finally:
        storage.delete(folder, True)


def top_files(files: DataFrame, k: int = TOP_FILES) -> DataFrame:
    """The k riskiest files per repository, and how many more risky ones there are.

    Each task keeps at most k files per repository before the shuffle.
    """
    risky = files.where(F.col("risk_score") > 0)
    order = Window.partitionBy("repo_id").orderBy(F.desc("risk_score"), "path")
    top = risky.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    counts = risky.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    return top.join(counts, "repo_id").select(
        "repo_id", "place", "path", shorten_path(F.col("path")).alias("shown_path"),
        F.upper("severity_label").alias("severity"), "risk_score",
        F.greatest(F.col("n") - k, F.lit(0)).alias("more_files"))


def top_findings(findings: DataFrame, k: int = TOP_FINDINGS) -> DataFrame:
    """The k heaviest findings per file, and how many more there are."""
    by_weight = Window.partitionBy(*FILE).orderBy(F.desc("effective_weight"), "line_number", "key_seq")
    whole = by_weight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = findings.withColumn("place", F.row_number().over(by_weight)).withColumn(
        "n", F.count(F.lit(1)).over(whole))
    return ranked.where(F.col("place") <= k).select(
        *FILE, "place", "rule_id", "name", "severity", "effective_weight",
        F.greatest(F.col("n") - k, F.lit(0)).alias("more_findings"))


def all_findings(findings: DataFrame) -> DataFrame:
    """Findings from the heaviest on."""
    return findings.orderBy(F.desc("effective_weight"), "repo_id", "path", "line_number", "key_seq")


def indicator_preview(indicators: DataFrame, k: int = PREVIEW) -> DataFrame:
    """The first k of ``repo_indicators`` per repository, and whether there are more."""
    order = Window.partitionBy("repo_id").orderBy("indicator")
    first = indicators.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return first.groupBy("repo_id").agg(
        F.slice(F.sort_array(F.collect_list("indicator")), 1, k).alias("preview"),
        (F.count(F.lit(1)) > k).alias("and_more"))
