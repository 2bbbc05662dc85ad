"""Hand-derived results of whole scans."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks import registry
from siftmoor.operators import report, risk
from siftmoor.operators.merge import findings
from siftmoor.operators.rulebook import rule_book
from siftmoor.plans.scan import analyze, scan, write_whole
from siftmoor.sources.catalogue import default_rules, rules_table

FILES = [
    ("F1", "a.sh", "shell", "echo hi\n"),
    ("F2", "b.py", "python", "import pickle\n"),
    ("F3", "c.py", "python", "exec(base64.b64decode(x))\n"),
    ("F4a", "a.py", "python", 'h = "8.8.8.8"\n'),
    ("F4b", "a.py", "python", 'h = "10.0.0.1"'),
    ("F4c", "a.py", "python", 'h = "1.2.3.04"'),
    ("F4d", "a.py", "python", 'h = "224.0.0.1"'),
    ("F5", "a.py", "python", 'x = "abcdefghijklmnopqrstuvwx"\n'),
    ("F6a", "a.py", "python", 'a="8.8.8.8"\nb="8.8.4.4"\n'),
    ("F6b", "a.py", "python", 'a="8.8.8.8"\nb="8.8.4.4"\nc="9.9.9.9"'),
    ("F6c", "a.js", "javascript", "navigator.geolocation\n" * 3),
    ("F7a", "a.sh", "shell", "echo hi\n"),
    ("F7a", "b.py", "python", 'h = "8.8.8.8"\n'),
    ("F7a", "c.js", "javascript", "navigator.geolocation\n"),
    ("F7b", "a.sh", "shell", "echo hi\n"),
    ("F7b", "b.sh", "shell", "echo hi\n"),
    ("F9", "a.py", "python", 'u = "http://evil.example.xyz:4444/a"\n'),
    ("F10", "a.js", "javascript", "navigator.clipboard.readText(); navigator.geolocation.get()\n"),
    ("F11", "a.py", "python", "import socket, subprocess\nos.dup2(1)\nx = base64\nexec = 1\n"),
    ("unread", "a.py", "python", None),
    ("blank", "a.sh", "shell", ""),
]


@pytest.fixture(scope="module")
def plain(file_text):
    return scan(file_text(FILES))


@pytest.fixture(scope="module")
def files(plain):
    return {(r.repo_id, r.path): r for r in plain.files.collect()}


@pytest.fixture(scope="module")
def found(plain):
    rows = {}
    order = ["repo_id", "path", "line_number", F.desc("effective_weight"), "key_seq"]
    for r in plain.findings.orderBy(*order).collect():
        rows.setdefault((r.repo_id, r.path), []).append(r)
    return rows


@pytest.fixture(scope="module")
def repos(plain):
    return {r.repo_id: r for r in plain.repos.collect()}


def test_always_true_rule_hits_every_shell_file(files, found, repos):
    (only,) = found["F1", "a.sh"]
    assert (only.rule_id, only.line_number, only.category, only.weight) == ("SH-DEST-004", 1, "impact", 85)
    assert files["F1", "a.sh"].risk_score == 85 and files["F1", "a.sh"].severity_label == "critical"
    assert (repos["F1"].verdict, repos["F1"].risk_level) == ("high", "critical")
    assert ("blank", "a.sh") not in found            # no line, no finding


@pytest.mark.parametrize("key, score", [
    (("F2", "b.py"), 55), (("F3", "c.py"), 100), (("F4a", "a.py"), 45), (("F4b", "a.py"), 0), (("F4c", "a.py"), 45),
    (("F4d", "a.py"), 45), (("F5", "a.py"), 20.054138), (("F6a", "a.py"), 90), (("F6b", "a.py"), 100),
    (("F6c", "a.js"), 27.369656), (("F9", "a.py"), 65), (("F10", "a.js"), 10), (("F11", "a.py"), 100),
    (("unread", "a.py"), 0), (("blank", "a.sh"), 0),
])
def test_file_scores(files, key, score):
    assert files[key].risk_score == pytest.approx(score, abs=1e-6)


def test_private_address_is_an_indicator_only(files, found):
    assert files["F4b", "a.py"].network_indicators == ["IP: 10.0.0.1"]
    assert ("F4b", "a.py") not in found


def test_entropy_finding(files, found):
    (only,) = found["F5", "a.py"]
    assert only.rule_id == "ENTROPY-MED" and only.matched_pattern == "entropy=4.58"
    assert only.confidence == pytest.approx(0.292481, abs=1e-6)
    assert only.effective_weight == pytest.approx(11.69925, abs=1e-6)
    assert only.description == "String entropy 4.58 is elevated — could be encoded data"
    assert "(entropy: 4.6)" in only.user_message
    assert files["F5", "a.py"].obfuscation_score == pytest.approx(55.69925, abs=1e-5)


def test_one_finding_per_line_and_category(files, found):
    (only,) = found["F9", "a.py"]
    assert only.rule_id == "NET-SUSP-PORT" and only.name == "Suspicious Port (4444)"
    assert files["F9", "a.py"].network_indicators == ["Domain: evil.example.xyz", "Port: 4444"]


def test_permissions_list_all_but_one_finding_stays(files, found, repos):
    (only,) = found["F10", "a.js"]
    assert only.rule_id == "PERM-CLIPBOARD"
    assert files["F10", "a.js"].permissions_detected == ["📋 Clipboard Access", "📍 Location/GPS Access"]
    assert repos["F10"].verdict == "safe"            # 10 is not above 10
    assert "📋 Clipboard Access, 📍 Location/GPS Access." in repos["F10"].summary_message


def test_at_most_one_combination(found):
    assert [(f.rule_id, f.line_number) for f in found["F11", "a.py"]] == [("COMBO-REVERSESH", 0), ("PY-DUP-001", 2)]
    assert found["F11", "a.py"][0].effective_weight == pytest.approx(124.95)


def test_repository_scores(repos):
    assert repos["F7a"].overall_risk_score == pytest.approx(58.4375)
    assert (repos["F7a"].verdict, repos["F7a"].risk_level) == ("moderate", "high")
    assert repos["F7a"].file_type_breakdown == {"javascript": 1, "python": 1, "shell": 1}
    assert repos["F7b"].overall_risk_score == pytest.approx(90) and repos["F7b"].verdict == "critical"
    assert repos["unread"].total_files_scanned == 1 and repos["unread"].verdict == "safe"


def test_unreadable_file_keeps_its_error(files):
    assert files["unread", "a.py"].scan_error == "Cannot read file"


def test_deep_scan_adds_syntax(file_text):
    result = scan(file_text([f for f in FILES if f[0] in ("F2", "F3", "F11")]), deep=True, stage=False)
    rows = result.findings.orderBy("repo_id", "line_number", F.desc("effective_weight"), "key_seq").collect()
    assert [(r.repo_id, r.rule_id, round(r.effective_weight, 3)) for r in rows] == [
        ("F11", "COMBO-REVERSESH", 124.95), ("F11", "AST-IMP-SUBPROCESS", 54.0), ("F11", "PY-DUP-001", 95.0),
        ("F2", "PY-IMP-003", 55.0),
        ("F3", "COMBO-ENCODEDEX", 117.3), ("F3", "AST-OBF-CHAIN", 135.375), ("F3", "PY-EXEC-002", 85.0)]


def test_repositories_without_files_and_with_errors(spark, plain):
    repos = spark.createDataFrame([("F1", None), ("empty", None), ("broken", "no such branch")],
                                  "repo_id string, error string")
    rows = {r.repo_id: r for r in risk.repo_results(plain.files, repos).collect()}
    assert set(rows) == {r.repo_id for r in plain.repos.collect()} | {"empty", "broken"}
    assert rows["empty"].verdict == "safe" and rows["empty"].total_files_scanned == 0
    assert rows["empty"].summary_message == "No scannable source code files found."
    assert rows["broken"].verdict == "critical" and rows["broken"].overall_risk_score == 0
    assert rows["broken"].summary_message == "Scan failed: no such branch"


def test_results_do_not_depend_on_partitioning(spark, file_text, files):
    book = rule_book(spark, default_rules())
    again = risk.file_results(analyze(file_text(FILES).repartition(7, "text")), book).collect()
    assert {(r.repo_id, r.path): r.risk_score for r in again} == {k: r.risk_score for k, r in files.items()}


def test_one_repository_over_many_salts(file_text):
    """Top five, counts and bonuses over more files than one salt group holds."""
    texts = ['h = "8.8.8.8"', "import pickle", "x = 1"]
    result = scan(file_text([("big", f"{i}.py", "python", texts[i % 3]) for i in range(300)]
                            + [("big", f"{i}.sh", "shell", "echo hi") for i in range(3)]), stage=False)
    (repo,) = result.repos.collect()
    top = 85 * (0.40 + 0.25 + 0.15) + 55 * (0.12 + 0.08)
    assert repo.overall_risk_score == pytest.approx(top + 10)
    assert repo.total_files_scanned == 303 and repo.critical_findings == 3
    assert repo.file_type_breakdown == {"python": 300, "shell": 3}


def test_report_records(plain):
    rows = report.nested_rows(plain.repos, plain.files, plain.findings).orderBy("repo_id", "place", "relative_path").collect()
    f11, first = [r for r in rows if r.repo_id == "F11"][:2]
    assert f11.summary.overall_risk_score == 100.0 and f11.summary.files_skipped == 0 and f11.result is None
    assert [f.rule_id for f in first.result.findings] == ["COMBO-REVERSESH", "PY-DUP-001"]
    assert first.result.top_finding_id == "COMBO-REVERSESH"
    assert next(r for r in rows if r.repo_id == "unread" and r.place == 1).result.findings == []


def test_report_of_a_large_repository(spark, file_text):
    table = file_text([("big", "x.py", "python", "eval(a)")])
    many = spark.range(10_001).select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"))
    result = scan(table.drop("path").crossJoin(many).select(table.columns))
    rows = report.nested_rows(result.repos, result.files, result.findings)
    assert rows.where("place = 1").count() == 10_001 and rows.where("place = 0").count() == 1


def test_repositories_without_files_are_added(spark, plain):
    listed = spark.createDataFrame([("gone", None), ("gone", "no such archive"), ("bare", None), ("bare", None)], "repo_id string, error string")
    found = {r.repo_id: r for r in risk.with_all_repos(plain.repos, listed).collect()}
    assert set(found) == {r.repo_id for r in plain.repos.collect()} | {"gone", "bare"}
    assert found["gone"].verdict == "critical" and found["gone"].summary_message == "Scan failed: no such archive"
    assert found["bare"].verdict == "safe" and found["F11"].overall_risk_score == 100.0


def test_json_report(spark, plain, tmp_path):
    target = str(tmp_path / "report")
    report.write_json(plain.repos, plain.files, plain.findings, target, timestamp=F.lit("2020-01-01T00:00:00"))
    summary = spark.read.json(f"{target}/summary").where("repo_id = 'F7b'").first()
    assert summary.summary.verdict == "critical" and summary.metadata.timestamp == "2020-01-01T00:00:00"
    results = spark.read.json(f"{target}/results")
    assert results.count() == len(FILES)
    assert results.where("repo_id = 'F9'").first().findings[0].rule_id == "NET-SUSP-PORT"


def test_a_failed_job_leaves_no_report(spark, plain, tmp_path):
    broken = plain.files.withColumn("language", F.when(F.col("repo_id") == "F9", F.raise_error(F.lit("lost"))).otherwise(F.col("language")))
    with pytest.raises(Exception, match="lost"):
        report.write_json(plain.repos, broken, plain.findings, str(tmp_path / "report"))
    assert list(tmp_path.iterdir()) == []
    none = [rows.limit(0) for rows in (plain.repos, plain.files, plain.findings)]
    report.write_json(*none, str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none" / "results")).count() == 0
    with pytest.raises(FileExistsError):
        report.write_json(plain.repos, plain.files, plain.findings, str(tmp_path / "none"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none"]


def test_top_views(plain):
    top = report.top_files(plain.files, k=2).where("repo_id = 'F7a'").orderBy("place").collect()
    assert [(r.path, r.more_files, r.severity) for r in top] == [("a.sh", 1, "CRITICAL"), ("b.py", 1, "MODERATE")]
    heavy = report.top_findings(plain.findings, k=1).where("repo_id = 'F11'").collect()
    assert [(r.rule_id, r.more_findings) for r in heavy] == [("COMBO-REVERSESH", 1)]


def test_merge_keys_are_unique(spark, file_text, plain):
    keys = plain.findings.withColumn("k", F.when(F.col("rule_id").startswith("COMBO-"), -1).otherwise(F.col("line_number")))
    assert keys.groupBy("repo_id", "path", "k", "category").count().where("count > 1").count() == 0
    assert plain.files.where("risk_score < 0 or risk_score > 100").count() == 0


def test_findings_of_unstaged_plan(spark, file_text, found):
    book = rule_book(spark, default_rules())
    rows = findings(analyze(file_text(FILES)), book).collect()
    assert len(rows) == sum(map(len, found.values()))


@pytest.mark.parametrize("as_table", [False, True])
def test_large_catalogues_are_joined(spark, file_text, files, as_table):
    """Patterns as rows give the same results, also if the catalogue comes as a table."""
    rules = rules_table(spark, default_rules()) if as_table else default_rules()
    with pytest.raises(ValueError):
        scan(file_text(FILES), rules_table(spark, default_rules()))
    joined = scan(file_text(FILES), rules, stage=False, plan="join").files.collect()
    columns = ["risk_score", "finding_count", "top_finding_id"]
    assert {(r.repo_id, r.path): [r[c] for c in columns] for r in joined} == {
        key: [r[c] for c in columns] for key, r in files.items()}


@pytest.mark.parametrize("plan", ["literal", "join"])
def test_whole_scan_reads_the_texts_once(spark, file_text, tmp_path, plan):
    """Findings, file scores and verdicts in one job, from one pass over the texts."""
    file_text(FILES).write.parquet(str(tmp_path / "in"))
    result = scan(spark.read.parquet(str(tmp_path / "in")), stage=False, plan=plan)
    rows = result.whole()
    collected = rows.collect()
    plan_text = rows._jdf.queryExecution().executedPlan().toString()
    final = plan_text.split("== Initial Plan ==")[0]
    # The join itself has two passes: the unanchored patterns and the index.
    assert final.count("FileScan parquet [repo_id") == (1 if plan == "literal" else 3)
    assert Counter(r.result for r in collected) == {
        "finding": result.findings.count(), "file": result.files.count(), "repo": result.repos.count()}
    assert {(r.repo_id, r.path): r.file.risk_score for r in collected if r.result == "file"} == {
        (r.repo_id, r.path): r.risk_score for r in result.files.collect()}


def test_whole_scan_is_written_in_one_job(spark, file_text, tmp_path):
    write_whole(scan(file_text(FILES), stage=False), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.result for r in back.select("result").distinct().collect()} == {"finding", "file", "repo"}
    assert back.where("result = 'repo'").select("repo_id", "repo.verdict").count() == len({f[0] for f in FILES})
    with pytest.raises(Exception):
        write_whole(scan(file_text(FILES), stage=False), str(tmp_path / "out"))


def test_report_queries_read_the_texts_once(spark):
    """Reports that join files with findings start from staged hits, so no plan reads the texts for each side."""
    for name in ("findings_in_order", "nested_report", "nested_report_rows"):
        files = registry.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not [f for f in files if "documents" in f], name
