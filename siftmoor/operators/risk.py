"""Scores: files, repositories, verdicts."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftmoor.fixed import detectors as fx
from siftmoor.operators.hits import HIT
from siftmoor.operators.merge import FILE, SEQ, rank, weigh

FILE_FIELDS = ["language", "file_size", "line_count", "scan_error", "obfuscation_score",
               "permissions_detected", "network_indicators"]
SALTS = 1024        # a repository is spread over this many groups before its rows meet


def frequency_factor(occurrence: Column) -> Column:
    """1 for a rule's first finding in a file; further ones count less and less."""
    return F.when(occurrence == 1, F.lit(1.0)).otherwise(F.log2(2.0 / occurrence + 1.0))


def risk_level(score: Column) -> Column:
    level = F.lit("safe")
    for name, floor in reversed(fx.LEVEL_FLOORS):
        level = F.when(score >= floor, name).otherwise(level)
    return level


def verdict(score: Column) -> Column:
    key = F.when(score > 10, "low").otherwise("safe")
    for name, floor in reversed(fx.VERDICT_FLOORS):
        key = F.when(score >= floor, name).otherwise(key)
    return key


def verdict_message(key: Column, critical: Column, permissions: Column) -> Column:
    message, advice = F.lit(None), F.lit(None)
    for name, (text, recommendation) in fx.VERDICTS.items():
        message = F.when(key == name, text).otherwise(message)
        advice = F.when(key == name, recommendation).otherwise(advice)
    return F.concat_ws(
        " ", message,
        F.when(critical > 0, F.format_string("Found %d CRITICAL security issues.", critical)),
        F.when(F.size(permissions) > 0, F.format_string(
            "Script requests access to: %s.", F.array_join(F.slice(permissions, 1, 3), ", "))),
        F.concat(F.lit("\nRecommendation: "), advice))


def file_and_hit_rows(analysis: DataFrame) -> DataFrame:
    """One row per file with its own columns (``file``) and one row per hit.

    A file's own columns travel once, as a row next to the rows of its hits, so hits
    and files need no join.
    """
    own = F.struct(*FILE_FIELDS)
    file_row = F.struct(own.alias("file"), F.lit(None).cast(HIT).alias("hit"))
    no_file = F.when(F.lit(False), own)
    hit_rows = F.transform("hits", lambda hit: F.struct(no_file.alias("file"), hit.alias("hit")))
    return analysis.select(*FILE, F.inline_outer(F.concat(F.array(file_row), hit_rows))).select(*FILE, "file", "hit.*")


def file_results(analysis: DataFrame, book: DataFrame) -> DataFrame:
    """One row per file: score, counts, top finding and the file's own columns."""
    rows = file_and_hit_rows(analysis).select(*FILE, "file", *SEQ, "def_id", "line_number", "confidence")
    return scored_files(rank(weigh(rows, book)))


def scored_files(ranked: DataFrame) -> DataFrame:
    """``file_results`` of ranked hits and file rows."""
    counted = F.col("effective_weight") * frequency_factor(F.col("occurrence"))
    scored = ranked.groupBy(*FILE).agg(
        F.coalesce(F.sum(F.when(F.col("kept"), counted)), F.lit(0.0)).alias("points"),
        F.count_if("kept").alias("finding_count"),
        F.count_if(F.col("kept") & (F.col("severity") == "critical")).alias("critical_count"),
        F.count_if(F.col("kept") & (F.col("severity") == "high")).alias("high_count"),
        F.min_by(F.when(F.col("kept"), F.col("rule_id")), F.when(F.col("kept"), F.struct(
            (-F.col("effective_weight")).alias("w"), "line_number", "key_seq"))).alias("top_finding_id"),
        F.first("file", ignorenulls=True).alias("file"),
    )
    score = F.least(F.lit(100.0), F.col("points") + 0.15 * F.col("file.obfuscation_score"))
    return scored.select(
        *FILE, "file.*", score.alias("risk_score"), risk_level(score).alias("severity_label"),
        "finding_count", "critical_count", "high_count", "top_finding_id")


def _combine_top(scores: Column) -> Column:
    """Weighted mean of the highest scores of risky files, given highest first."""
    weights = F.array(*[F.lit(w) for w in fx.TOP_FILE_WEIGHTS])
    used = F.slice(weights, 1, F.greatest(F.size(scores), F.lit(1)))
    total = F.aggregate(F.zip_with(scores, used, lambda s, w: s * w), F.lit(0.0),
                        lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    share = F.aggregate(used, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(scores) == 0, F.lit(0.0)).when(
        F.size(scores) < len(fx.TOP_FILE_WEIGHTS), total / share).otherwise(total)


def _top_scores(lists: Column) -> Column:
    return F.slice(F.sort_array(F.flatten(lists), asc=False), 1, len(fx.TOP_FILE_WEIGHTS))


def repo_results(files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """One row per repository, in one pass over the files.

    A repository may hold any share of all files.  Its files are first reduced in
    ``SALTS`` groups to counts and at most five scores each; the final step then
    meets a bounded number of small rows per repository.

    ``repos(repo_id, error)``, if given, adds repositories without scannable files
    and those that could not be read.
    """
    salted = files.select(
        "repo_id", F.pmod(F.xxhash64("path"), F.lit(SALTS)).alias("salt"),
        F.coalesce("language", F.lit("unknown")).alias("language"), "risk_score",
        "obfuscation_score", "finding_count", "critical_count", "high_count", "permissions_detected")
    order = Window.partitionBy("repo_id", "salt").orderBy(F.desc("risk_score"))
    risky = F.col("risk_score") > 0
    partial = (
        salted.withColumn("place", F.row_number().over(order))
        .groupBy("repo_id", "salt", "language")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum("finding_count").alias("n_findings"),
            F.sum("critical_count").alias("n_critical"),
            F.sum("high_count").alias("n_high"),
            F.count_if(risky & (F.col("critical_count") > 0)).alias("critical_files"),
            F.count_if(risky & (F.col("obfuscation_score") > 60)).alias("obfuscated_files"),
            F.collect_list(F.when(risky & (F.col("place") <= len(fx.TOP_FILE_WEIGHTS)),
                                  F.col("risk_score"))).alias("scores"),
            F.collect_set("permissions_detected").alias("permissions"),     # sets of <= 13 labels
        )
    )
    sums = ["n_files", "n_findings", "n_critical", "n_high", "critical_files", "obfuscated_files"]

    def reduce(rows: DataFrame, *keys) -> DataFrame:
        return rows.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in sums],
            _top_scores(F.collect_list("scores")).alias("scores"),
            F.collect_set(F.array_distinct(F.flatten("permissions"))).alias("permissions"))

    by_language = reduce(partial, "repo_id", "language")
    totals = by_language.groupBy("repo_id").agg(
        *[F.sum(c).alias(c) for c in sums],
        _top_scores(F.collect_list("scores")).alias("scores"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("permissions"))))).alias("all_permissions"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n_files")))).alias("file_type_breakdown"))
    spread = F.when(F.col("critical_files") > 1,
                    F.least(F.lit(15.0), (F.col("critical_files") - 1) * 5.0)).otherwise(0.0)
    hidden = F.when(F.col("obfuscated_files") > 2, 10.0).otherwise(0.0)
    score = F.when(F.size("scores") == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), _combine_top(F.col("scores")) + (spread + hidden)))
    scored = totals.withColumn("overall_risk_score", score).withColumn(
        "verdict", verdict(F.col("overall_risk_score")))
    result = scored.select(
        "repo_id", F.col("n_files").alias("total_files_scanned"), "overall_risk_score", "verdict",
        risk_level(F.col("overall_risk_score")).alias("risk_level"),
        verdict_message(F.col("verdict"), F.col("n_critical"), F.col("all_permissions")).alias("summary_message"),
        F.col("n_findings").alias("total_findings"), F.col("n_critical").alias("critical_findings"),
        F.col("n_high").alias("high_findings"), "all_permissions", "file_type_breakdown")
    return result if repos is None else with_all_repos(result, repos)


def with_all_repos(results: DataFrame, repos: DataFrame) -> DataFrame:
    """All results, and the repositories of ``repos(repo_id, error)`` that have none; an error replaces a result.

    A repository that is listed several times counts once, with an error if any row has one.
    """
    listed = repos.groupBy("repo_id").agg(F.max("error").alias("error"))
    joined = listed.join(results, "repo_id", "full")
    failed, empty = F.col("error").isNotNull(), F.col("verdict").isNull()
    joined = (
        joined.withColumn("summary_message", F.when(failed, F.concat(F.lit("Scan failed: "), "error"))
                          .when(empty, fx.EMPTY_MESSAGE).otherwise(F.col("summary_message")))
        .withColumn("overall_risk_score", F.when(failed | empty, 0.0).otherwise(F.col("overall_risk_score")))
        .withColumn("all_permissions", F.when(failed | empty, F.array().cast("array<string>"))
                    .otherwise(F.col("all_permissions")))
        .withColumn("file_type_breakdown", F.when(failed | empty, F.create_map().cast("map<string,bigint>"))
                    .otherwise(F.col("file_type_breakdown")))
        .withColumn("risk_level", F.when(failed | empty, "safe").otherwise(F.col("risk_level")))
    )
    for c in ("total_files_scanned", "total_findings", "critical_findings", "high_findings"):
        joined = joined.withColumn(c, F.when(failed | empty, F.lit(0)).otherwise(F.col(c)))
    return joined.withColumn("verdict", F.when(failed, "critical").when(empty, "safe").otherwise(
        F.col("verdict"))).select(*results.columns)


def repo_indicators(files: DataFrame) -> DataFrame:
    """Distinct network indicators per repository, as rows: a large repository may have any number."""
    return files.select("repo_id", F.explode("network_indicators").alias("indicator")).distinct()


def file_types(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"))
