"""The registered queries: each operator over whole tables, with its oracle SQL.

``query`` registers a Spark function under its own name; the SQL, if any, is the
last SELECT over the named CTE chain.
"""

from pyspark.sql import DataFrame, functions as F

from checks import corpus, oracle as o
from siftmoor.fixed import detectors as fx
from siftmoor.functions import urls
from siftmoor.functions.plan import computed_once
from siftmoor.functions.numbers import human_size
from siftmoor.operators import admission, entropy, network, networks, report, risk, syntax
from siftmoor.operators.anchors import Anchors
from siftmoor.operators.combos import combo_hits
from siftmoor.operators.lines import lines, with_lines
from siftmoor.operators.merge import findings, raw_findings
from siftmoor.operators.permissions import permission_hits, permission_labels
from siftmoor.operators.rulebook import rule_book
from siftmoor.operators.rules import matches_by_join, rule_hits
from siftmoor.plans.scan import analyze, scan
from siftmoor.sources import files as sources
from siftmoor.sources.catalogue import categories, default_rules, languages, rule_patterns, rules_by_category, rules_for_language, rules_table

QUERIES, ORACLE = {}, {}


def query(ctes=None, select: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if select is not None:
            ORACLE[function.__name__] = o.sql(ctes, select) if ctes else select
        return function

    return register


def six(column: str) -> F.Column:
    return F.round(column, 6).alias(column)


def _book(spark):
    return rule_book(spark, default_rules())


def _detected(table: DataFrame, **columns) -> DataFrame:
    """The files with the results of single detectors; each is a function of the anchors."""
    anchors = Anchors(rule_patterns(default_rules()))
    return computed_once(with_lines(table, anchors), {name: make(anchors) for name, make in columns.items()})


def _detector_findings(detected: DataFrame) -> DataFrame:
    """The findings of one detector, before any merge."""
    return raw_findings(detected, _book(detected.sparkSession))


def _files(spark, sf_dir, source=corpus.seeded, **options) -> DataFrame:
    return risk.file_results(analyze(source(spark, sf_dir), **options), _book(spark))


def _findings(spark, sf_dir, source=corpus.seeded, **options) -> DataFrame:
    return findings(analyze(source(spark, sf_dir), **options), _book(spark))


# --- lines and texts ---------------------------------------------------------------------------
@query(o.DOCUMENTS + o.LINES, "SELECT repo_id, path, n AS line_number, length(line) AS chars, md5(line) AS digest FROM lines")
def document_lines(spark, sf_dir):
    return lines(corpus.documents(spark, sf_dir)).select(
        "repo_id", "path", "line_number", F.length("line").alias("chars"), F.md5("line").alias("digest"))


@query(o.DOCUMENTS + o.LINES, "SELECT repo_id, path, n AS line_number, md5(s) AS digest FROM code")
def code_lines(spark, sf_dir):
    shared = with_lines(corpus.documents(spark, sf_dir))
    return shared.select("repo_id", "path", F.inline("code")).select(
        "repo_id", "path", F.col("n").alias("line_number"), F.md5("s").alias("digest"))


@query(select="SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN format('{:.1f} KB', b / 1024) "
              "ELSE format('{:.1f} MB', b / 1048576) END AS human FROM "
              "(SELECT doc_id, strlen(text) * (1 + doc_id % 40) AS b FROM documents)")
def human_sizes(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.octet_length("text") * (F.col("doc_id") % 40 + 1)
    return table.select("doc_id", human_size(size).alias("human"))


# --- admission ---------------------------------------------------------------------------------
_NAME_LANGUAGE = (
    "CASE " + " ".join(f"WHEN name = {o.q(k)} THEN '{v}'" for k, v in o.ff.FILENAME_LANGUAGE.items())
    + " " + " ".join(f"WHEN ext = '{k}' THEN '{v}'" for k, v in o.ff.EXTENSION_LANGUAGE.items())
    + " WHEN shebang = '' THEN NULL"
    + " " + " ".join("WHEN " + o.any_of("contains(shebang, {0})", words) + f" THEN '{v}'"
                     for words, v in o.ff.SHEBANG_LANGUAGE) + " END")
PAGE_FILES = [
    "page_paths AS (SELECT page_id, replace([" + ", ".join(map(o.q, o.PATHS))
    + f"][1 + page_id % {len(o.PATHS)}], '{{}}', CAST(page_id AS VARCHAR)) AS path, CASE WHEN page_id % 31 = 30 THEN '' "
    "ELSE CASE WHEN page_id % 7 = 3 THEN '#!/usr/bin/env fish' || chr(10) ELSE '' END || html END AS content FROM pages)",
    "named AS (SELECT *, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name, "
    "strlen(content) AS size_bytes, CASE WHEN starts_with(content, '#!') THEN lower(string_split(content, chr(10))[1]) "
    "ELSE '' END AS shebang, list_transform(regexp_extract_all(left(hex(encode(content)), 16384), '..'), "
    "lambda x: regexp_matches(x, '^(09|0A|0D|[2-6].|7[0-9A-E])$')) AS plain FROM page_paths)",
    "extended AS (SELECT *, lower(regexp_extract(name, '^\\.*[^.].*(\\.[^.]*)$', 1)) AS ext FROM named)",
    f"judged AS (SELECT *, {_NAME_LANGUAGE} AS language FROM extended)",
    "reasons AS (SELECT *, CASE WHEN len(list_filter(parts[1:-2], lambda d: d IN ("
    + ", ".join(map(o.q, o.ff.SKIP_DIRECTORIES)) + ") OR ends_with(d, '.egg-info'))) > 0 THEN 'skipped directory' "
    "WHEN name IN (" + ", ".join(map(o.q, o.ff.SKIP_FILES)) + ") THEN 'excluded file' "
    "WHEN starts_with(name, '.') AND name NOT IN (" + ", ".join(map(o.q, o.ff.FILENAME_LANGUAGE)) + ") THEN 'hidden file' "
    "WHEN size_bytes > 1000000 THEN 'file too large (' || format('{:.1f}', size_bytes / 1e6) || 'MB)' "
    "WHEN size_bytes = 0 THEN 'empty file' "
    "WHEN len(list_filter(plain, lambda x: NOT x)) / len(plain) > 0.3 THEN 'binary file' "
    "WHEN language IS NULL THEN 'unsupported file type' END AS skip_reason FROM judged)",
]


@query(PAGE_FILES, "SELECT CAST(page_id AS VARCHAR) AS repo_id, path, size_bytes, language, skip_reason FROM reasons")
def page_admission(spark, sf_dir):
    return admission.judged(corpus.page_files(spark, sf_dir)).select(
        "repo_id", "path", "size_bytes", "language", "skip_reason")


@query(PAGE_FILES, "SELECT CAST(page_id AS VARCHAR) AS repo_id, path, language, length(content) AS file_size, "
                   "md5(content) AS digest FROM reasons WHERE skip_reason IS NULL")
def admitted_pages(spark, sf_dir):
    return admission.admitted(corpus.page_files(spark, sf_dir)).select(
        "repo_id", "path", "language", "file_size", F.md5("text").alias("digest"))


@query(PAGE_FILES, "SELECT skip_reason, count(*) AS files FROM reasons WHERE skip_reason IS NOT NULL GROUP BY ALL")
def skipped_pages(spark, sf_dir):
    return admission.skipped(corpus.page_files(spark, sf_dir)).groupBy("skip_reason").agg(
        F.count(F.lit(1)).alias("files"))


# --- rules -------------------------------------------------------------------------------------
@query(o.SEEDED + o.RULE_HITS[:3], "SELECT repo_id, path, count(DISTINCT rule_ord) AS rules, count(*) AS patterns "
       "FROM file_text f JOIN rule_languages rl ON rl.language = f.language OR rl.language = 'all' "
       "JOIN patterns USING (rule_ord) GROUP BY ALL")
def applicable_rules(spark, sf_dir):
    table = rules_table(spark, default_rules())
    by_list = table.select("rule_ord", F.size("match_patterns").alias("n"), F.explode("languages").alias("list"))
    lists = corpus.seeded(spark, sf_dir).select(
        "repo_id", "path", F.explode(F.array("language", F.lit("all"))).alias("list"))
    return lists.join(F.broadcast(by_list), "list").groupBy("repo_id", "path").agg(    # a row per rule and language
        F.count_distinct("rule_ord").alias("rules"), F.sum("n").alias("patterns"))


_RULE_SELECT = ("SELECT repo_id, path, k1, k2, k3, rule_id, category, severity, weight, line_number, line_content, "
                "matched_pattern FROM rule_hits")


def _by_rule(hits: DataFrame, spark) -> DataFrame:
    book = F.broadcast(_book(spark).select("def_id", "rule_id", "category", "severity", "weight"))
    return hits.join(book, "def_id").select(
        "repo_id", "path", "k1", "k2", "k3", "rule_id", "category", "severity", "weight", "line_number",
        "line_content", "matched_pattern")


def _rule_matches(spark, table) -> DataFrame:
    patterns = rule_patterns(default_rules())
    anchors = Anchors(patterns)
    found = computed_once(with_lines(table, anchors, code=False), {"hits": rule_hits(patterns, anchors)})
    return _by_rule(found.select("repo_id", "path", F.inline("hits")), spark)


@query(o.SEEDED + o.LINES + o.RULE_HITS, _RULE_SELECT)
def rule_matches(spark, sf_dir):
    return _rule_matches(spark, corpus.seeded(spark, sf_dir))


@query(o.SEEDED + o.LINES + o.RULE_HITS, _RULE_SELECT)
def rule_matches_by_join(spark, sf_dir):
    joined = matches_by_join(corpus.seeded(spark, sf_dir), rules_table(spark, default_rules()))
    return _by_rule(joined.select("repo_id", "path", "hit.*"), spark)


@query(o.PAGES + o.LINES + o.RULE_HITS, _RULE_SELECT)
def page_rule_matches(spark, sf_dir):
    return _rule_matches(spark, corpus.pages(spark, sf_dir))


@query(o.SEEDED + o.LINES + o.RULE_HITS, "SELECT rule_id, type, count(*) AS matches, count(DISTINCT path) AS files "
       "FROM rule_hits JOIN patterns p ON p.rule_ord = k2 AND p.pattern_ord = k3 GROUP BY ALL")
def matches_per_rule(spark, sf_dir):
    patterns = rules_table(spark, default_rules()).select("rule_ord", F.posexplode("match_patterns"))
    types = F.broadcast(patterns.select(F.col("rule_ord").alias("k2"), F.col("pos").alias("k3"), "col.type"))
    return _rule_matches(spark, corpus.seeded(spark, sf_dir)).join(types, ["k2", "k3"]).groupBy("rule_id", "type").agg(
        F.count(F.lit(1)).alias("matches"), F.count_distinct("path").alias("files"))


@query(o.SEEDED + o.COMBO_HITS, "SELECT repo_id, path, rule_id, name, weight, confidence, multiplier AS "
       "context_multiplier, line_number, line_content, matched_pattern FROM combo_hits")
def combinations(spark, sf_dir):
    return _detector_findings(_detected(corpus.seeded(spark, sf_dir), hits=combo_hits)).select(
        "repo_id", "path", "rule_id", "name", "weight", "confidence", "context_multiplier", "line_number",
        "line_content", "matched_pattern")


# --- entropy -----------------------------------------------------------------------------------
@query(o.SEEDED + o.LINES + o.CANDIDATES, "SELECT repo_id, path, n AS line_number, i AS candidate, length(string) AS chars, "
       "md5(string) AS digest, round(e, 6) AS entropy FROM measured")
def entropy_candidates(spark, sf_dir):
    return entropy.candidates(with_lines(corpus.seeded(spark, sf_dir))).select(
        "repo_id", "path", "line_number", "candidate", F.length("string").alias("chars"),
        F.md5("string").alias("digest"), six("entropy"))


@query(o.SEEDED + o.LINES + o.ENTROPY_HITS, "SELECT repo_id, path, line_number, rule_id, severity, weight, "
       "round(confidence, 6) AS confidence, matched_pattern, line_content FROM entropy_hits")
def entropy_findings(spark, sf_dir):
    shared = with_lines(corpus.seeded(spark, sf_dir))
    hits = entropy.entropy_hits(entropy.elevated_strings())
    return _detector_findings(computed_once(shared, {"hits": hits})).select(
        "repo_id", "path", "line_number", "rule_id", "severity", "weight", six("confidence"), "matched_pattern",
        "line_content")


@query(o.SEEDED + o.LINES + o.ENTROPY_HITS, "SELECT f.repo_id, f.path, round(coalesce(score, 0), 6) AS obfuscation_score "
       "FROM file_text f LEFT JOIN obfuscation USING (repo_id, path)")
def obfuscation_scores(spark, sf_dir):
    found = computed_once(with_lines(corpus.seeded(spark, sf_dir)), {"elevated": entropy.elevated_strings()})
    score = entropy.obfuscation_score(F.col("elevated"), F.size("lines"))
    return found.select("repo_id", "path", F.round(score, 6).alias("obfuscation_score"))


# --- permissions -------------------------------------------------------------------------------
@query(o.SEEDED + o.LINES + o.PERMISSION_HITS, "SELECT repo_id, path, line_number, rule_id, name, severity, weight, "
       "line_content, matched_pattern FROM permission_hits")
def permission_requests(spark, sf_dir):
    return _detector_findings(_detected(corpus.seeded(spark, sf_dir), hits=permission_hits)).select(
        "repo_id", "path", "line_number", "rule_id", "name", "severity", "weight", "line_content", "matched_pattern")


@query(o.SEEDED + o.LINES + o.PERMISSION_HITS, "SELECT repo_id, path, string_agg(label, '; ' ORDER BY label) AS permissions "
       "FROM (SELECT DISTINCT repo_id, path, label FROM permission_found JOIN permissions USING (i)) GROUP BY ALL")
def permissions_per_file(spark, sf_dir):
    found = _detected(corpus.seeded(spark, sf_dir), hits=permission_hits).where(F.size("hits") > 0)
    return found.select("repo_id", "path", F.array_join(permission_labels(F.col("hits")), "; ").alias("permissions"))


# --- network -----------------------------------------------------------------------------------
def _items(spark, sf_dir, source, kind: int) -> DataFrame:
    found = _detected(source(spark, sf_dir), items=network.network_items)
    return found.select("repo_id", "path", F.inline("items")).where(F.col("kind") == kind)


def _indicators(spark, sf_dir) -> DataFrame:
    found = _detected(corpus.seeded(spark, sf_dir), items=network.network_items)
    return found.select("repo_id", "path", network.network_indicators(F.col("items")).alias("network_indicators"))


@query(o.DOCUMENTS + o.LINES + o.NETWORK, "SELECT repo_id, path, n AS line_number, i AS place, ip, public FROM ip_public")
def addresses(spark, sf_dir):
    return _items(spark, sf_dir, corpus.documents, 0).select(
        "repo_id", "path", F.col("n").alias("line_number"), F.col("i").alias("place"), F.col("value").alias("ip"),
        F.col("bad").alias("public"))


_EVENT_IP = ("concat_ws('.', {0}, CAST(user_id % 256 AS VARCHAR), CAST(event_id % 256 AS VARCHAR), CAST(event_id % 11 AS VARCHAR))")
_FIRST_OCTETS = ["10", "172", "192", "169", "8", "198", "203", "300", "01"]
_NUMBER = "list_sum(list_transform(string_split({0}, '.'), lambda x, i: x::BIGINT * CAST(pow(256, 4 - i) AS BIGINT)))::BIGINT"
_VALID = "regexp_full_match({0}, '(0|[1-9][0-9]*)([.](0|[1-9][0-9]*)){{3}}') AND list_max(list_transform(string_split({0}, '.'), lambda x: x::BIGINT)) < 256"
ADDRESS_NETWORKS = [
    "seen AS (SELECT ip FROM ip_public UNION ALL SELECT " + _EVENT_IP.format("[" + ", ".join(map(o.q, _FIRST_OCTETS)) + f"][1 + event_id % {len(_FIRST_OCTETS)}]") + " FROM events)",
    "counted AS (SELECT ip, count(*) AS n FROM seen GROUP BY ip)",
    o.values("fixed_networks", "cidr, label", [(c, "private") for c in fx.PRIVATE_RANGES] + [(c, "public") for c in fx.PRIVATE_HOLES]),
    "cidrs AS (SELECT * FROM fixed_networks UNION ALL SELECT '172.' || n_nationkey || '.0.0/' || (9 + n_nationkey % 24), n_name FROM nation "
    "UNION ALL SELECT '10.' || s_suppkey % 256 || '.' || s_suppkey % 3, s_name FROM supplier UNION ALL SELECT '10.' || s_suppkey % 256 || '.0.0/16', s_name FROM supplier)",
    "bounds AS (SELECT label, split_part(cidr, '/', 2)::INT AS bits, " + _NUMBER.format("split_part(cidr, '/', 1)") + " AS n FROM cidrs WHERE cidr LIKE '%/%')",
    "ranges AS (SELECT (n >> (32 - bits)) << (32 - bits) AS lo, bits, min(label) AS label FROM bounds GROUP BY ALL)",
    "numbers AS (SELECT ip, " + _NUMBER.format("ip") + " AS x FROM counted WHERE " + _VALID.format("ip") + ")",
    "held AS (SELECT ip, arg_max(lo, bits) AS lo, max(bits) AS bits, arg_max(label, bits) AS label FROM numbers JOIN ranges "
    "ON x >= lo AND x < lo + (1::BIGINT << (32 - bits)) GROUP BY ip)",
]


@query(o.SEEDED + o.LINES + o.NETWORK + ADDRESS_NETWORKS,
       "SELECT ip, n, (lo >> 24) || '.' || (lo >> 16) % 256 || '.' || (lo >> 8) % 256 || '.' || lo % 256 || '/' || bits AS network, label "
       "FROM counted LEFT JOIN held USING (ip)")
def address_networks(spark, sf_dir):
    """Addresses in texts and of events, with the longest of the networks that hold them."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    first = F.get(F.array(*[F.lit(x) for x in _FIRST_OCTETS]), (F.col("event_id") % len(_FIRST_OCTETS)).cast("int"))
    of_events = read("events").select(F.concat_ws(".", first, *[(F.col(c) % n).cast("string") for c, n in (("user_id", 256), ("event_id", 256), ("event_id", 11))]).alias("ip"))
    seen = _items(spark, sf_dir, corpus.seeded, 0).select(F.col("value").alias("ip")).unionByName(of_events)
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, F.Column) else F.lit(p) for p in parts])
    nation, key = F.col("n_nationkey"), F.col("s_suppkey") % 256
    table = (
        networks.default_networks(spark)
        .union(read("nation").select(text("172.", nation, ".0.0/", nation % 24 + 9), "n_name"))
        .union(read("supplier").select(text("10.", key, ".", F.col("s_suppkey") % 3), "s_name"))       # no networks
        .union(read("supplier").select(text("10.", key, ".0.0/16"), "s_name")))
    return networks.networks_of(seen.groupBy("ip").agg(F.count("*").alias("n")), table)


@query(["hosts AS (SELECT lower(split_part(split_part(split_part(url, '://', 2), '/', 1), ':', 1)) AS host, page_id FROM pages)",
        "labels AS (SELECT *, string_split(host, '.') AS p FROM hosts)",
        o.values("fixed_safe", "domain", [(d,) for d in fx.SAFE_DOMAINS]),
        "safe AS (SELECT domain FROM fixed_safe UNION SELECT host FROM labels WHERE page_id % 9 = 0)"],
       "SELECT host, count(*) AS pages FROM labels WHERE host NOT IN (SELECT domain FROM safe) AND NOT "
       "(len(p) >= 2 AND array_to_string(p[-2:], '.') IN (SELECT domain FROM safe)) AND NOT regexp_matches(host, '^[0-9]+([.][0-9]+){3}') GROUP BY host")
def unsafe_page_hosts(spark, sf_dir):
    """Hosts of pages that no safe domain covers; the table of safe domains grows with the pages."""
    hosts = spark.read.parquet(f"{sf_dir}/pages.parquet").select(network.domain(F.col("url")).alias("host"), "page_id")
    more = hosts.where("page_id % 9 = 0").select(F.col("host").alias("domain"))
    safe = spark.createDataFrame([(d,) for d in fx.SAFE_DOMAINS], "domain string").union(more)
    return networks.unsafe_hosts(hosts, safe).groupBy("host").agg(F.count("*").alias("pages"))


@query(o.SEEDED + o.LINES + o.NETWORK, "SELECT repo_id, path, n AS line_number, port, note FROM port_found JOIN ports USING (i)")
def suspicious_ports(spark, sf_dir):
    notes = F.expr("map(" + ", ".join(f"'{port}', '{note}'" for port, note in fx.PORTS) + ")")
    return _items(spark, sf_dir, corpus.seeded, 1).select(
        "repo_id", "path", F.col("n").alias("line_number"), F.col("value").alias("port"),
        F.element_at(notes, F.col("value")).alias("note"))


@query(o.PAGES + o.LINES + o.NETWORK, "SELECT repo_id, path, n AS line_number, i AS place, domain, bad FROM domain_verdicts")
def page_domains(spark, sf_dir):
    return _items(spark, sf_dir, corpus.pages, 2).select(
        "repo_id", "path", F.col("n").alias("line_number"), F.col("i").alias("place"), F.col("value").alias("domain"), "bad")


_TLD = o.any_of("ends_with(domain, {0})", fx.RISKY_TLDS)
_DDNS = o.any_of("ends_with(domain, {0})", fx.DYNAMIC_DNS)


@query([o.SAFE, "hosts AS (SELECT page_id, " + o.DOMAIN.format(
           "regexp_replace(url, '(example)\\.(com|net|org)', ['github.com', 'x.tk', 'h.duckdns.org', 'example.com', "
           "'w3.org'][1 + page_id % 5])") + " AS domain FROM pages)"],
       f"SELECT page_id, domain, {o.suspicious('domain')} AS suspicious, CASE WHEN {_TLD} THEN 'tld' "
       f"WHEN {_DDNS} THEN 'dynamic dns' ELSE 'unknown' END AS reason FROM hosts")
def domain_verdicts(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ends = F.get(F.expr("array('github.com', 'x.tk', 'h.duckdns.org', 'example.com', 'w3.org')"),
                 (F.col("page_id") % 5).cast("int"))
    url = F.regexp_replace("url", F.lit(r"example\.(com|net|org)"), ends)
    hosts = table.select("page_id", network.domain(url).alias("domain"))
    return hosts.select("page_id", "domain", network.is_suspicious(F.col("domain")).alias("suspicious"),
                        network.suspicion(F.col("domain")).alias("reason"))


@query(o.SEEDED + o.LINES + o.NETWORK, "SELECT repo_id, path, string_agg(indicator, '; ' ORDER BY indicator) AS indicators "
       "FROM indicators GROUP BY ALL")
def indicators_per_file(spark, sf_dir):
    found = _indicators(spark, sf_dir).where(F.size("network_indicators") > 0)
    return found.select("repo_id", "path", F.array_join("network_indicators", "; ").alias("indicators"))


# --- Python syntax -----------------------------------------------------------------------------
@query(o.PROGRAMS + o.SYNTAX[:2], "SELECT repo_id, path, seq, kind, name, base, lineno, inner_name FROM facts")
def syntax_facts(spark, sf_dir):
    return syntax.facts_table(corpus.programs(spark, sf_dir))


@query(o.PROGRAMS + o.LINES + o.SYNTAX, "SELECT repo_id, path, k1, k2, rule_id, name, category, severity, weight, "
       "confidence, line_number, line_content, matched_pattern FROM syntax_hits")
def syntax_findings(spark, sf_dir):
    table = corpus.programs(spark, sf_dir)
    facts = table.withColumn("facts", syntax.syntax_facts(F.col("language"), F.col("text")))
    hits = syntax.syntax_hits(F.col("facts"))
    return _detector_findings(computed_once(with_lines(facts), {"hits": hits})).select(
        "repo_id", "path", "k1", "k2", "rule_id", "name", "category", "severity", "weight", "confidence",
        "line_number", "line_content", "matched_pattern")


# --- merge -------------------------------------------------------------------------------------
_FINDING = ("SELECT repo_id, path, rule_id, name, category, severity, weight, line_number, line_content, matched_pattern, "
            "round(confidence, 6) AS confidence, round(eff, 6) AS effective_weight, occurrence FROM findings")
_FINDING_COLUMNS = ["repo_id", "path", "rule_id", "name", "category", "severity", "weight", "line_number",
                    "line_content", "matched_pattern"]


def _finding_view(found: DataFrame) -> DataFrame:
    return found.select(*_FINDING_COLUMNS, six("confidence"), six("effective_weight"), "occurrence")


@query(o.SEEDED + o.SCAN, "SELECT repo_id, path, a, k1, k2, k3, rule_id, name, line_number, round(eff, 6) AS effective_weight FROM hits")
def all_hits(spark, sf_dir):
    return raw_findings(analyze(corpus.seeded(spark, sf_dir)), _book(spark)).select(
        "repo_id", "path", "a", "k1", "k2", "k3", "rule_id", "name", "line_number", six("effective_weight"))


@query(o.SEEDED + o.SCAN, _FINDING)
def merged_findings(spark, sf_dir):
    return _finding_view(_findings(spark, sf_dir))


@query(o.PROGRAMS + o.DEEP_SCAN, _FINDING)
def deep_findings(spark, sf_dir):
    return _finding_view(_findings(spark, sf_dir, corpus.programs, deep=True))


@query(o.SEEDED + o.SCAN, "SELECT repo_id, path, string_agg(rule_id, ' ' ORDER BY rank_in_file) AS rules_in_order "
       "FROM findings GROUP BY ALL")
def findings_in_order(spark, sf_dir):
    result = scan(corpus.seeded(spark, sf_dir))
    records = report.file_records(result.files, result.findings).where("finding_count > 0")
    rules = F.array_join(F.transform("findings", lambda f: f["rule_id"]), " ")
    return records.select("repo_id", F.col("relative_path").alias("path"), rules.alias("rules_in_order"))


@query(o.SEEDED + o.SCAN, "SELECT repo_id, path, rule_id, line_number, occurrence, round(CASE WHEN occurrence = 1 THEN 1 "
       "ELSE log2(2.0 / occurrence + 1.0) END, 6) AS factor FROM findings")
def occurrence_factors(spark, sf_dir):
    factor = risk.frequency_factor(F.col("occurrence"))
    return _findings(spark, sf_dir).select(
        "repo_id", "path", "rule_id", "line_number", "occurrence", F.round(factor, 6).alias("factor"))


# --- scores ------------------------------------------------------------------------------------
_FILE = (f"SELECT repo_id, path, language, file_size, round(risk_score, 6) AS risk_score, {o.level('risk_score')} AS "
         "severity_label, finding_count, critical_count, high_count, top_finding_id, "
         "round(obfuscation_score, 6) AS obfuscation_score FROM files")


def _file_view(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "path", "language", "file_size", six("risk_score"), "severity_label",
                        "finding_count", "critical_count", "high_count", "top_finding_id", six("obfuscation_score"))


@query(o.SEEDED + o.SCAN, _FILE)
def file_risk(spark, sf_dir):
    return _file_view(_files(spark, sf_dir))


@query(o.PROGRAMS + o.DEEP_SCAN, _FILE)
def deep_file_risk(spark, sf_dir):
    return _file_view(_files(spark, sf_dir, corpus.programs, deep=True))


@query(o.CONVERSATIONS + o.SCAN, _FILE)
def conversation_risk(spark, sf_dir):
    return _file_view(_files(spark, sf_dir, corpus.conversations))


@query(o.PAGES + o.SCAN, _FILE)
def page_risk(spark, sf_dir):
    return _file_view(_files(spark, sf_dir, corpus.pages))


_REPO = ("SELECT repo_id, total_files_scanned, round(score, 6) AS overall_risk_score, verdict, risk_level, total_findings, "
         "critical_findings, high_findings FROM repos")
_REPO_COLUMNS = ["repo_id", "total_files_scanned", "verdict", "risk_level", "total_findings", "critical_findings",
                 "high_findings"]


def _repo_view(repos: DataFrame) -> DataFrame:
    return repos.select(*_REPO_COLUMNS, six("overall_risk_score"))


@query(o.SEEDED + o.SCAN, _REPO)
def repo_risk(spark, sf_dir):
    return _repo_view(risk.repo_results(_files(spark, sf_dir)))


@query(o.PAGES + o.SCAN, _REPO)
def site_risk(spark, sf_dir):
    return _repo_view(risk.repo_results(_files(spark, sf_dir, corpus.pages)))


@query(o.DOCUMENTS + o.SCAN, _REPO)
def document_repo_risk(spark, sf_dir):
    return _repo_view(risk.repo_results(_files(spark, sf_dir, corpus.documents)))


@query(o.SEEDED + o.SCAN, "SELECT repo_id, verdict, summary_message FROM repo_messages")
def verdict_messages(spark, sf_dir):
    return risk.repo_results(_files(spark, sf_dir)).select("repo_id", "verdict", "summary_message")


@query(o.SEEDED + o.SCAN, "SELECT repo_id, array_to_string(labels, '; ') AS permissions FROM repos")
def permissions_per_repo(spark, sf_dir):
    return risk.repo_results(_files(spark, sf_dir)).select(
        "repo_id", F.array_join("all_permissions", "; ").alias("permissions"))


@query(o.SEEDED + o.SCAN, "SELECT DISTINCT repo_id, indicator FROM indicators")
def indicators_per_repo(spark, sf_dir):
    return risk.repo_indicators(_indicators(spark, sf_dir))


@query(o.SEEDED + o.SCAN, "SELECT repo_id, language, files FROM file_types")
def file_types(spark, sf_dir):
    return risk.file_types(corpus.seeded(spark, sf_dir))


@query(o.SEEDED + o.SCAN + [
           "listed AS (SELECT DISTINCT repo_id, NULL AS error FROM file_text UNION ALL SELECT DISTINCT 'conversation/' "
           "|| conv_id, CASE WHEN conv_id % 2 = 0 THEN 'turn count ' || count(*) OVER (PARTITION BY conv_id) END "
           "FROM conversations)"],
       "SELECT repo_id, coalesce(total_files_scanned, 0) AS total_files_scanned, round(CASE WHEN error IS NULL THEN "
       "coalesce(score, 0) ELSE 0 END, 6) AS overall_risk_score, CASE WHEN error IS NOT NULL THEN 'critical' "
       "ELSE coalesce(verdict, 'safe') END AS verdict, CASE WHEN error IS NOT NULL THEN 'Scan failed: ' || error "
       f"WHEN verdict IS NULL THEN {o.q(fx.EMPTY_MESSAGE)} END AS note FROM listed LEFT JOIN repos USING (repo_id)")
def repos_without_files(spark, sf_dir):
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    none = talks.select(
        F.concat(F.lit("conversation/"), F.col("conv_id").cast("string")).alias("repo_id"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("turn count "), F.col("n").cast("string"))).alias("error"))
    scanned = corpus.seeded(spark, sf_dir).select("repo_id").distinct().withColumn("error", F.lit(None).cast("string"))
    repos = risk.repo_results(_files(spark, sf_dir), scanned.unionByName(none))
    return repos.select("repo_id", "total_files_scanned", six("overall_risk_score"), "verdict", F.when(
        F.col("repo_id").startswith("conversation/"), F.col("summary_message")).alias("note"))


# --- whole scans -------------------------------------------------------------------------------
def _whole_sql(findings: str = "findings", files: str = "files", repos: str = "repos") -> str:
    return (
        "SELECT 'finding' AS result, repo_id, path, rule_id AS name, line_number::BIGINT AS number, round(eff, 6) AS value, "
        f"matched_pattern AS text FROM {findings} UNION ALL SELECT 'file', repo_id, path, {o.level('risk_score')}, finding_count::BIGINT, "
        f"round(risk_score, 6), top_finding_id FROM {files} UNION ALL "
        f"SELECT 'repo', repo_id, NULL, verdict, total_findings::BIGINT, round(score, 6), risk_level FROM {repos}")


def _whole(spark, sf_dir, source, **options) -> DataFrame:
    """Findings, files and repositories of one scan, as one relation."""
    rows = scan(source(spark, sf_dir), stage=False, **options).whole()
    return rows.select(
        "result", "repo_id", "path", F.coalesce("finding.rule_id", "file.severity_label", "repo.verdict").alias("name"),
        F.coalesce("finding.line_number", "file.finding_count", "repo.total_findings").cast("long").alias("number"),
        F.round(F.coalesce("finding.effective_weight", "file.risk_score", "repo.overall_risk_score"), 6).alias("value"),
        F.when(F.col("result") == "finding", F.col("finding.matched_pattern")).when(
            F.col("result") == "file", F.col("file.top_finding_id")).otherwise(F.col("repo.risk_level")).alias("text"))


@query(o.SEEDED + o.SCAN, _whole_sql())
def whole_scan(spark, sf_dir):
    return _whole(spark, sf_dir, corpus.seeded)


@query(o.PROGRAMS + o.DEEP_SCAN, _whole_sql())
def whole_deep_scan(spark, sf_dir):
    return _whole(spark, sf_dir, corpus.programs, deep=True)


@query(o.SEEDED + o.SCAN, _whole_sql())
def whole_scan_by_join(spark, sf_dir):
    return _whole(spark, sf_dir, corpus.seeded, plan="join")


@query(o.BRANCHES + o.SCAN, _whole_sql())
def branch_scan(spark, sf_dir):
    return _whole(spark, sf_dir, corpus.branches)


@query(o.BRANCHES + o.SCAN, "SELECT repo_id, place, CASE WHEN length(path) > 40 THEN '...' || right(path, 37) ELSE path END AS shown_path, "
       "round(risk_score, 6) AS risk_score FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY risk_score DESC, path) "
       "AS place FROM (SELECT * REPLACE (round(risk_score, 9) AS risk_score) FROM files) WHERE risk_score > 0) WHERE place <= 15")
def branch_riskiest_files(spark, sf_dir):
    files = _files(spark, sf_dir, corpus.branches).withColumn("risk_score", F.round("risk_score", 9))
    return report.top_files(files).select("repo_id", "place", "shown_path", six("risk_score"))


@query(o.BRANCHES + o.SCAN, "SELECT repo_id, array_to_string(labels, '; ') AS permissions FROM repos")
def branch_permissions(spark, sf_dir):
    return risk.repo_results(_files(spark, sf_dir, corpus.branches)).select("repo_id", F.array_join("all_permissions", "; ").alias("permissions"))


@query(o.BRANCHES + o.SCAN, "SELECT repo_id, path, rule_id, line_number, occurrence, round(CASE WHEN occurrence = 1 THEN 1 "
       "ELSE log2(2.0 / occurrence + 1.0) END, 6) AS factor FROM findings")
def branch_occurrence_factors(spark, sf_dir):
    factor = risk.frequency_factor(F.col("occurrence"))
    return _findings(spark, sf_dir, corpus.branches).select(
        "repo_id", "path", "rule_id", "line_number", "occurrence", F.round(factor, 6).alias("factor"))


# --- listings ----------------------------------------------------------------------------------
@query(o.BENCHMARK_RULES, "SELECT 'category' AS listing, category AS name, item_id AS rule_ord, 0 AS list_ord FROM rules UNION ALL "
       "SELECT DISTINCT 'categories', category, NULL, NULL FROM rules UNION ALL "
       "SELECT DISTINCT 'languages', unnest(languages), NULL, NULL FROM rules UNION ALL "
       "SELECT 'language', l.language, item_id, 0 FROM rules JOIN (SELECT unnest(" + str(list(corpus.LANGUAGES)) + ") AS language) l "
       "ON list_contains(languages, l.language) UNION ALL "
       "SELECT 'language', l.language, item_id, 1 FROM rules JOIN (SELECT unnest(" + str(list(corpus.LANGUAGES)) + ") AS language) l "
       "ON list_contains(languages, 'all')")
def rule_listings(spark, sf_dir):
    table, none = corpus.benchmark_rules(spark, sf_dir), F.lit(None).cast("int")
    rows = [rules_by_category(table, c).select(F.lit("category").alias("listing"), F.col("category").alias("name"), "rule_ord", F.lit(0).alias("list_ord"))
            for c in corpus.RULE_CATEGORIES]
    rows += [rules_for_language(table, x).select(F.lit("language").alias("listing"), F.lit(x).alias("name"), "rule_ord", "list_ord") for x in corpus.LANGUAGES]
    rows.append(categories(table).select(F.lit("categories").alias("listing"), F.col("category").alias("name"), none.alias("rule_ord"), none.alias("list_ord")))
    rows.append(languages(table).select(F.lit("languages").alias("listing"), F.col("language").alias("name"), none.alias("rule_ord"), none.alias("list_ord")))
    listing = rows[0]
    for more in rows[1:]:
        listing = listing.unionByName(more)
    return listing


# --- report views ------------------------------------------------------------------------------
@query(o.SEEDED + o.SCAN, "SELECT repo_id, place, path, CASE WHEN length(path) > 40 THEN '...' || right(path, 37) ELSE path "
       f"END AS shown_path, upper({o.level('risk_score')}) AS severity, round(risk_score, 6) AS risk_score, "
       "greatest(n - 15, 0) AS more_files FROM (SELECT *, count(*) OVER (PARTITION BY repo_id) AS n FROM "
       "(SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY risk_score DESC, path) AS place FROM (SELECT * REPLACE "
       "(round(risk_score, 9) AS risk_score) FROM files) WHERE risk_score > 0)) WHERE place <= 15")
def riskiest_files(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("risk_score", F.round("risk_score", 9))    # same ties on both sides
    return report.top_files(files).withColumn("risk_score", F.round("risk_score", 6))


@query(o.SEEDED + o.SCAN, "SELECT repo_id, path, rank_by_weight AS place, rule_id, name, severity, round(eff, 6) AS "
       "effective_weight, greatest(count(*) OVER (PARTITION BY repo_id, path) - 4, 0) AS more_findings FROM findings "
       "QUALIFY rank_by_weight <= 4")
def heaviest_findings(spark, sf_dir):
    return report.top_findings(_findings(spark, sf_dir)).withColumn(
        "effective_weight", F.round("effective_weight", 6))


@query(o.SEEDED + o.SCAN, "SELECT repo_id, array_to_string(list_sort(list(indicator))[1:5], '; ') AS preview, "
       "count(*) > 5 AS and_more FROM (SELECT DISTINCT repo_id, indicator FROM indicators) GROUP BY repo_id")
def indicator_preview(spark, sf_dir):
    shown = report.indicator_preview(risk.repo_indicators(_indicators(spark, sf_dir)))
    return shown.withColumn("preview", F.array_join("preview", "; "))


@query(o.SEEDED + o.SCAN, "SELECT repo_id, format('{:.1f}', score)::DOUBLE AS score, verdict, risk_level, total_files_scanned AS files_scanned, "
       "0 AS files_skipped, total_findings, (SELECT string_agg(language || '=' || files, ',' ORDER BY language) "
       "FROM file_types t WHERE t.repo_id = r.repo_id) AS types FROM repos r")
def report_summary(spark, sf_dir):
    records = report.repo_records(risk.repo_results(_files(spark, sf_dir)))
    types = F.array_join(F.transform(F.array_sort(F.map_entries("file_type_breakdown")),
                                     lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return records.select(
        "repo_id", F.col("summary.overall_risk_score").alias("score"), "summary.verdict", "summary.risk_level",
        "summary.files_scanned", "summary.files_skipped", "summary.total_findings", types.alias("types"))


@query(o.SEEDED + o.SCAN, "SELECT repo_id, count(*) AS files, sum(finding_count) AS findings, "
       "string_agg(path || ':' || coalesce(top_finding_id, '-'), ' ' ORDER BY path) AS tops FROM files GROUP BY repo_id")
def nested_report(spark, sf_dir):
    result = scan(corpus.seeded(spark, sf_dir))
    rows = report.nested_rows(result.repos, result.files, result.findings).where("place = 1")
    top = F.struct("relative_path", F.concat("relative_path", F.lit(":"), F.coalesce("result.top_finding_id", F.lit("-"))).alias("text"))
    return rows.groupBy("repo_id").agg(F.count("*").alias("files"), F.sum(F.size("result.findings")).alias("findings"),
                                       F.array_join(F.sort_array(F.collect_list(top))["text"], " ").alias("tops"))


@query(o.SEEDED + o.SCAN, "SELECT repo_id, 0 AS place, NULL AS relative_path, format('{:.1f}', score)::DOUBLE AS score, verdict AS name, "
       "total_files_scanned::BIGINT AS files, total_findings::BIGINT AS findings, critical_findings::BIGINT AS critical, high_findings::BIGINT AS high, "
       "array_to_string(labels, '; ') AS permissions, summary_message AS message FROM repos JOIN repo_messages USING (repo_id, verdict) "
       f"UNION ALL SELECT repo_id, 1, path, round(risk_score, 6), {o.level('risk_score')}, 1, finding_count, critical_count, high_count, NULL, NULL FROM files")
def nested_report_rows(spark, sf_dir):
    """Summary and file rows of the nested report."""
    result = scan(corpus.seeded(spark, sf_dir))
    rows, file = report.nested_rows(result.repos, result.files, result.findings), F.col("place") == 1
    both = lambda summary, record: F.when(file, F.col(f"result.{record}")).otherwise(F.col(f"summary.{summary}"))
    return rows.select(
        "repo_id", "place", "relative_path", F.round(both("overall_risk_score", "risk_score"), 6).alias("score"), both("verdict", "severity_label").alias("name"),
        F.when(file, 1).otherwise(F.col("summary.files_scanned")).cast("long").alias("files"),
        F.when(file, F.size("result.findings")).otherwise(F.col("summary.total_findings")).cast("long").alias("findings"),
        both("critical_findings", "critical_count").cast("long").alias("critical"), both("high_findings", "high_count").cast("long").alias("high"),
        F.array_join("summary.all_permissions", "; ").alias("permissions"), F.col("summary.verdict_message").alias("message"))


@query(o.SEEDED + o.SCAN, "SELECT repo_id, path, rule_id, line_number, round(eff, 6) AS effective_weight FROM findings")
def all_findings(spark, sf_dir):
    return report.all_findings(_findings(spark, sf_dir)).select("repo_id", "path", "rule_id", "line_number", six("effective_weight"))


# --- repository URLs ---------------------------------------------------------------------------
REPO_URLS = [
    "urls AS (SELECT page_id, replace(replace([" + ", ".join(map(o.q, o.URLS)) + f"][1 + page_id % {len(o.URLS)}], '{{o}}', "
    "regexp_extract(url, '^https?://([^./]+)\\.', 1)), '{r}', 'r' || page_id) AS url FROM pages)",
    "trimmed AS (SELECT *, trim(url) AS t, rtrim(trim(url), '/') AS u FROM urls)",
    "pieces AS (SELECT *, regexp_extract(u, '^git@github\\.com:(.+?)/(.+?)(?:\\.git)?$', ['owner', 'repo']) AS ssh, "
    "lower(regexp_replace(regexp_replace(regexp_extract(u, '^[a-zA-Z]+://([^/?#]*)', 1), '^.*@', ''), ':.*$', '')) AS host, "
    "list_filter(string_split(regexp_replace(regexp_replace(u, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', ''), '/'), "
    "lambda x: x <> '') AS p FROM trimmed)",
    "parsed AS (SELECT *, host IN ('github.com', 'www.github.com') AND len(p) >= 2 AS web, CASE WHEN ssh.owner <> '' "
    "THEN ssh.owner WHEN web THEN p[1] END AS owner, CASE WHEN ssh.owner <> '' THEN ssh.repo WHEN web "
    "THEN replace(p[2], '.git', '') END AS repo, CASE WHEN ssh.owner = '' AND web AND len(p) >= 4 AND p[3] = 'tree' "
    "THEN p[4] END AS branch FROM pieces)",
    "checked AS (SELECT *, CASE WHEN url = '' THEN 'URL cannot be empty' WHEN starts_with(t, 'git@') THEN "
    f"CASE WHEN regexp_matches(t, '^git@github\\.com:.+/.+') THEN '' ELSE {o.q(urls.BAD_SSH)} END "
    f"WHEN NOT (starts_with(t, 'http://') OR starts_with(t, 'https://')) THEN {o.q(urls.BAD_SCHEME)} "
    f"WHEN host NOT IN ('github.com', 'www.github.com') THEN {o.q(urls.BAD_HOST)} "
    f"WHEN owner IS NULL OR repo IS NULL THEN {o.q(urls.NO_REPO)} "
    "WHEN NOT regexp_matches(repo, '^[A-Za-z0-9_.-]+$') THEN 'Invalid repository name: ''' || repo || '''' ELSE '' END "
    "AS error FROM parsed)",
]


@query(REPO_URLS, "SELECT page_id, owner, repo, branch FROM parsed")
def parsed_urls(spark, sf_dir):
    table = corpus.repo_urls(spark, sf_dir)
    return table.select("page_id", urls.parse_repo_url(F.col("url")).alias("u")).select("page_id", "u.*")


@query(REPO_URLS, "SELECT page_id, error = '' AS valid, error FROM checked")
def checked_urls(spark, sf_dir):
    table = corpus.repo_urls(spark, sf_dir)
    return table.select("page_id", urls.validate_repo_url(F.col("url")).alias("u")).select("page_id", "u.*")


@query(REPO_URLS, "SELECT page_id, coalesce(owner || '/' || repo, url) AS display_name, 'https://github.com/' || owner || '/' "
       "|| repo || '.git' AS clone_url, 'https://api.github.com/repos/' || owner || '/' || repo || '/zipball/' || "
       "coalesce(branch, 'main') AS zip_url, 'https://api.github.com/repos/' || owner || '/' || repo AS api_url FROM parsed")
def built_urls(spark, sf_dir):
    parsed = corpus.repo_urls(spark, sf_dir).withColumn("u", urls.parse_repo_url(F.col("url")))
    owner, repo = F.col("u.owner"), F.col("u.repo")

    def if_known(built):
        return F.when(owner.isNotNull() & repo.isNotNull(), built)

    return parsed.select(
        "page_id", urls.display_name(F.col("url")).alias("display_name"),
        if_known(urls.clone_url(owner, repo)).alias("clone_url"),
        if_known(urls.zip_url(owner, repo, F.col("u.branch"))).alias("zip_url"),
        if_known(urls.api_url(owner, repo)).alias("api_url"))


# --- files of trees and archives ----------------------------------------------------------------
_WRITTEN = ("SELECT concat_ws('/', coalesce(lang, 'none'), (doc_id // 20) % 20, doc_id || '.py') AS path, octet_length(encode(text)) AS size_bytes, "
            "CASE WHEN octet_length(encode(text)) <= 1000000 THEN md5(text) END AS digest FROM documents WHERE text IS NOT NULL")


def _read_back(files: DataFrame) -> DataFrame:
    return files.select("path", "size_bytes", F.md5("content").alias("digest"))


@query(select=_WRITTEN)
def archive_scan(spark, sf_dir):
    return _read_back(sources.archive_files(sources.archive_names(corpus.written(spark, sf_dir, packed=True))))


@query(select=_WRITTEN)
def tree_scan(spark, sf_dir):
    return _read_back(sources.tree_files(corpus.written(spark, sf_dir, packed=False)))
