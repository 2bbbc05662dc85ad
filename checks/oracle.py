"""DuckDB SQL for the registered queries, written as chains of CTEs.

The SQL follows the operators' definitions step by step (lines, matches, merge,
scores) with joins and windows of its own; it shares with the Spark code only
the fixed values.
"""

import ipaddress

from checks.corpus import BRANCHES as BRANCH_SNIPPETS, DEEP_PATH, LANGUAGES, PATHS, RULE_CATEGORIES, SNIPPETS, URLS
from siftmoor.fixed import detectors as fx
from siftmoor.fixed import files as ff
from siftmoor.operators.rulebook import combo_rule_id
from siftmoor.sources.catalogue import default_rules


def q(text: str) -> str:
    """A string literal; control characters and unusual spaces as chr()."""
    parts, plain = [], ""
    for ch in text:
        if ch != " " and (ch.isspace() or ord(ch) < 32):
            parts += ["'" + plain.replace("'", "''") + "'", f"chr({ord(ch)})"]
            plain = ""
        else:
            plain += ch
    parts.append("'" + plain.replace("'", "''") + "'")
    parts = [p for p in parts if p != "''"] or ["''"]
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def any_of(template: str, options) -> str:
    return "(" + " OR ".join(template.format(q(o)) for o in options) + ")"


WS = q("".join(chr(c) for c in range(0x3001) if chr(c).isspace()))
SHELF = "lang || '/' || CAST((doc_id // 20) % 20 AS VARCHAR)"
LANG = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(LANGUAGES)) + " END"
UNIX = "replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
SNIPPET_ROWS = values("snippets", "slot, snippet", SNIPPETS.items())

# --- file_text of each corpus ------------------------------------------------------------------
DOCUMENTS = [f"file_text AS (SELECT {SHELF} AS repo_id, CAST(doc_id AS VARCHAR) AS path, {LANG} AS language, "
             f"{UNIX.format('text')} AS text FROM documents)"]
SEEDED = [SNIPPET_ROWS,
          f"file_text AS (SELECT {SHELF} AS repo_id, CAST(doc_id AS VARCHAR) AS path, {LANG} AS language, "
          f"{UNIX.format('text || chr(10) || snippet')} AS text FROM documents JOIN snippets ON doc_id % 60 = slot)"]
_COMMENTED = "'# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) || snippet"
PROGRAMS = [SNIPPET_ROWS,
            f"file_text AS (SELECT {SHELF} AS repo_id, CAST(doc_id AS VARCHAR) AS path, 'python' AS language, "
            f"{UNIX.format(_COMMENTED)} AS text FROM documents JOIN snippets ON doc_id % 60 = slot)"]
_BRANCH = "split_part(text, chr(10), 1) || chr(10) || snippet"
BRANCHES = [values("snippets", "slot, snippet", BRANCH_SNIPPETS.items()),
            f"file_text AS (SELECT {SHELF} AS repo_id, '{DEEP_PATH}' || doc_id || '.py' AS path, 'python' AS language, "
            f"{UNIX.format(_BRANCH)} AS text FROM documents JOIN snippets ON doc_id % {len(BRANCH_SNIPPETS)} = slot)"]
BENCHMARK_RULES = [
    f"languages_of AS (SELECT *, CASE item_id % 5 {' '.join(f'WHEN {i} THEN {q(x)}' for i, x in enumerate(LANGUAGES))} END AS own FROM benchmark)",
    "rules AS (SELECT item_id, [" + ", ".join(map(q, RULE_CATEGORIES)) + f"][1 + length(text) % {len(RULE_CATEGORIES)}] AS category, "
    "CASE WHEN item_id % 7 = 0 THEN ['all'] WHEN item_id % 7 = 1 THEN [own, 'all'] ELSE [own] END AS languages FROM languages_of)",
]
CONVERSATIONS = ["file_text AS (SELECT CAST(conv_id AS VARCHAR) AS repo_id, CAST(turn AS VARCHAR) AS path, "
                 f"'shell' AS language, {UNIX.format('text')} AS text FROM conversations)"]
_PAGE = "'url = ' || url || chr(10) || html"
PAGES = ["file_text AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo_id, "
         f"CAST(page_id AS VARCHAR) AS path, {LANG.replace('doc_id', 'page_id')} AS language, "
         f"{UNIX.format(_PAGE)} AS text FROM pages)"]

# --- lines -------------------------------------------------------------------------------------
LINES = [
    "parts AS (SELECT repo_id, path, language, string_split(CASE WHEN text LIKE '%' || chr(10) "
    "THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM file_text WHERE text <> '')",
    "lines AS (SELECT repo_id, path, language, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM parts)",
    "code AS (SELECT * FROM (SELECT repo_id, path, language, n, "
    f"trim(line, {WS}) AS s FROM lines) WHERE s <> '' AND NOT "
    + any_of("starts_with(s, {0})", fx.COMMENTS) + ")",
]

# --- rules -------------------------------------------------------------------------------------
RULES = default_rules()
_PATTERNS = [(rule, k, pattern, kind) for rule in RULES for k, (pattern, kind) in enumerate(rule.match_patterns)]
RULE_ROWS = values("rules", "rule_ord, rule_id, name, category, severity, weight", [
    (r.rule_ord, r.rule_id, r.name, r.category, r.severity, r.weight) for r in RULES])
PATTERN_ROWS = values("patterns", "pid, rule_ord, pattern_ord, pattern, type", [
    (pid, r.rule_ord, k, pattern, kind) for pid, (r, k, pattern, kind) in enumerate(_PATTERNS)])
RULE_LANGUAGE_ROWS = values("rule_languages", "rule_ord, language", [
    (r.rule_ord, name) for r in RULES for name in r.languages])


def _matches(pattern: str, kind: str) -> str:
    if kind == "regex":
        return f"regexp_matches(line, {q('(?i)' + pattern)})"
    return f"contains(lower(line), {q(pattern.lower())})"


def _rule_hits() -> list[str]:
    parts = []
    for language in LANGUAGES:
        tests = ", ".join(
            f"CASE WHEN {_matches(pattern, kind)} THEN {pid} END"
            for pid, (rule, _, pattern, kind) in enumerate(_PATTERNS)
            if language in rule.languages or "all" in rule.languages)
        parts.append(f"SELECT repo_id, path, language, n, line, unnest(list_filter([{tests}], lambda x: x IS NOT NULL)) "
                     f"AS pid FROM lines WHERE language = '{language}'")
    return [
        RULE_ROWS, PATTERN_ROWS, RULE_LANGUAGE_ROWS,
        "matched AS (" + " UNION ALL ".join(parts) + ")",
        "first_match AS (SELECT repo_id, path, language, pid, min(n) AS n, arg_min(line, n) AS line "
        "FROM matched GROUP BY ALL)",
        "rule_hits AS (SELECT f.repo_id, f.path, 0 AS a, CASE WHEN EXISTS (SELECT 1 FROM rule_languages rl WHERE "
        "rl.rule_ord = r.rule_ord AND rl.language = f.language) THEN 0 ELSE 1 END AS k1, r.rule_ord AS k2, "
        "p.pattern_ord AS k3, r.rule_id, r.category, r.severity, r.weight, 1.0::DOUBLE AS confidence, "
        "1.0::DOUBLE AS multiplier, f.n AS line_number, left(f.line, 200) AS line_content, "
        "p.pattern AS matched_pattern, r.name FROM first_match f JOIN patterns p USING (pid) "
        "JOIN rules r ON r.rule_ord = p.rule_ord)",
    ]


RULE_HITS = _rule_hits()

# --- combos ------------------------------------------------------------------------------------
COMBO_HITS = [
    values("combos", "i, rule_id, name, weight, required", [
        (i, combo_rule_id(name), f"⚡ Combo: {name}", weight, " + ".join(required))
        for i, (name, required, weight, _, _) in enumerate(fx.COMBOS)]),
    "combo_hits AS (SELECT repo_id, path, 1 AS a, i AS k1, 0 AS k2, 0 AS k3, rule_id, 'combination' AS category, "
    "'critical' AS severity, weight, 0.85::DOUBLE AS confidence, 1.5::DOUBLE AS multiplier, 0 AS line_number, "
    f"{q(fx.COMBO_LINE)} AS line_content, required AS matched_pattern, name FROM file_text, combos WHERE "
    "len(list_filter(string_split(required, ' + '), lambda r: NOT contains(lower(text), lower(r)))) = 0)",
]

# --- entropy -----------------------------------------------------------------------------------
CANDIDATES = [
    "scanned AS (SELECT *, list_concat(list_transform(regexp_extract_all(s, "
    f"{q(fx.QUOTED)}), lambda x: substr(x, 2, length(x) - 2)), regexp_extract_all(s, {q(fx.BASE64_TOKEN)}), "
    f"regexp_extract_all(s, {q(fx.HEX_TOKEN)})) AS found FROM code "
    f"WHERE length(s) >= {fx.ENTROPY_MIN_LENGTH} AND NOT starts_with(s, {q(fx.ENTROPY_COMMENT)}))",
    "candidate_lists AS (SELECT repo_id, path, n, s, CASE WHEN len(found) > 0 THEN found "
    f"WHEN length(s) >= {fx.WHOLE_LINE_LENGTH} THEN [s] ELSE [] END AS found FROM scanned)",
    "candidates AS (SELECT repo_id, path, n, s, unnest(found) AS string, generate_subscripts(found, 1) - 1 AS i "
    "FROM candidate_lists)",
    "measured AS (SELECT *, list_aggregate(string_split(string, ''), 'entropy') AS e FROM candidates)",
]
ENTROPY_HITS = CANDIDATES + [
    "entropy_hits AS (SELECT repo_id, path, 3 AS a, n AS k1, i AS k2, 0 AS k3, "
    "CASE WHEN e >= 5.5 THEN 'ENTROPY-HIGH' ELSE 'ENTROPY-MED' END AS rule_id, 'obfuscation' AS category, "
    "CASE WHEN e >= 5.5 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN e >= 5.5 THEN 70 ELSE 40 END AS weight, "
    "CASE WHEN e >= 5.5 THEN least(1.0, (e - 4.0) / 2.0) ELSE least(0.8, (e - 4.0) / 2.0) END AS confidence, "
    "1.0::DOUBLE AS multiplier, n AS line_number, left(s, 200) AS line_content, "
    "format('entropy={:.2f}', e) AS matched_pattern, "
    "CASE WHEN e >= 5.5 THEN 'Very High Entropy String' ELSE 'High Entropy String' END AS name "
    "FROM measured WHERE e >= 4.5)",
    "line_counts AS (SELECT repo_id, path, count(*) AS line_count FROM lines GROUP BY ALL)",
    "high_strings AS (SELECT repo_id, path, count(*) AS c, avg(e) AS m FROM measured WHERE e >= 4.5 GROUP BY ALL)",
    "obfuscation AS (SELECT repo_id, path, least(100.0, least(40, c / greatest(line_count, 1) * 400) "
    "+ least(40, (m - 4.0) * 20) + least(20, c * 4)) AS score FROM high_strings JOIN line_counts USING (repo_id, path))",
]

# --- permissions -------------------------------------------------------------------------------
def _permission_hits() -> list[str]:
    tests = ", ".join(
        "coalesce(" + ", ".join(f"nullif(regexp_extract(s, {q('(?i)' + p)}), '')" for p in patterns) + ")"
        for *_, patterns in fx.PERMISSIONS)
    return [
        values("permissions", "i, category, label", [
            (i, c, f"{emoji} {label}") for i, (c, emoji, label, _) in enumerate(fx.PERMISSIONS)]),
        f"permission_texts AS (SELECT repo_id, path, n, s, [{tests}] AS t FROM code)",
        "permission_found AS (SELECT * FROM (SELECT repo_id, path, n, s, unnest(t) AS text, "
        "generate_subscripts(t, 1) - 1 AS i FROM permission_texts) WHERE text IS NOT NULL)",
        "permission_hits AS (SELECT repo_id, path, 4 AS a, n AS k1, i AS k2, 0 AS k3, 'PERM-' || upper(category) "
        "AS rule_id, 'permission' AS category, 'info' AS severity, 10 AS weight, 1.0::DOUBLE AS confidence, "
        "1.0::DOUBLE AS multiplier, n AS line_number, left(s, 100) AS line_content, text AS matched_pattern, "
        "'Permission Requested: ' || substr(label, strpos(label, ' ') + 1) AS name "
        "FROM permission_found JOIN permissions USING (i))",
    ]


PERMISSION_HITS = _permission_hits()

# --- network -----------------------------------------------------------------------------------
_NETS = [(int(n[0]), int(n[-1]), 1) for n in map(ipaddress.ip_network, fx.PRIVATE_RANGES)]
_HOLES = [(int(n[0]), int(n[-1]), 0) for n in map(ipaddress.ip_network, fx.PRIVATE_HOLES)]
DOMAIN = "lower(string_split(string_split(string_split({0}, '://')[2], '/')[1], ':')[1])"
SAFE = values("safe", "domain", [(d,) for d in fx.SAFE_DOMAINS])


def suspicious(domain: str) -> str:
    last_two = f"string_split({domain}, '.')[-2] || '.' || string_split({domain}, '.')[-1]"
    return (f"NOT regexp_matches({domain}, {q('^' + fx.IPV4)}) AND {domain} NOT IN (SELECT domain FROM safe) AND "
            f"NOT (len(string_split({domain}, '.')) >= 2 AND {last_two} IN (SELECT domain FROM safe))")


def _network() -> list[str]:
    contexts = any_of("contains(lower(s), {0})", fx.PORT_CONTEXT)
    ports = ", ".join(f"CASE WHEN regexp_matches(s, '\\b{port}\\b') THEN {i} END" for i, (port, _) in enumerate(fx.PORTS))
    return [
        SAFE, values("nets", "lo, hi, private", _NETS + _HOLES),
        values("ports", "i, port, note", [(i, str(p), note) for i, (p, note) in enumerate(fx.PORTS)]),
        f"ip_lists AS (SELECT repo_id, path, n, s, regexp_extract_all(s, {q(fx.IPV4)}) AS l FROM code)",
        "ips AS (SELECT repo_id, path, n, s, unnest(l) AS ip, generate_subscripts(l, 1) - 1 AS i FROM ip_lists)",
        "ip_numbers AS (SELECT *, string_split(ip, '.')[1]::BIGINT * 16777216 + string_split(ip, '.')[2]::BIGINT * 65536 "
        "+ string_split(ip, '.')[3]::BIGINT * 256 + string_split(ip, '.')[4]::BIGINT AS number, "
        "regexp_matches(ip, '(^|\\.)0[0-9]') AS odd FROM ips)",
        "ip_public AS (SELECT *, odd OR NOT EXISTS (SELECT 1 FROM nets WHERE private = 1 AND number BETWEEN lo AND hi) "
        "OR EXISTS (SELECT 1 FROM nets WHERE private = 0 AND number BETWEEN lo AND hi) AS public FROM ip_numbers)",
        f"port_lists AS (SELECT repo_id, path, n, s, list_filter([{ports}], lambda x: x IS NOT NULL) AS l FROM code "
        f"WHERE {contexts})",
        "port_found AS (SELECT repo_id, path, n, s, unnest(l) AS i FROM port_lists)",
        f"url_lists AS (SELECT repo_id, path, n, s, regexp_extract_all(s, {q('(?i)' + fx.URL)}) AS l FROM code)",
        "urls AS (SELECT repo_id, path, n, s, unnest(l) AS url, generate_subscripts(l, 1) - 1 AS i FROM url_lists)",
        f"domains AS (SELECT *, {DOMAIN.format('url')} AS domain FROM urls)",
        f"domain_verdicts AS (SELECT *, {suspicious('domain')} AS bad FROM domains)",
        "network_hits AS ("
        "SELECT repo_id, path, 5 AS a, n AS k1, 0 AS k2, i AS k3, 'NET-PUBLIC-IP' AS rule_id, 'network' AS category, "
        "'medium' AS severity, 45 AS weight, 1.0::DOUBLE AS confidence, 1.0::DOUBLE AS multiplier, n AS line_number, "
        "left(s, 150) AS line_content, ip AS matched_pattern, 'Hardcoded Public IP' AS name FROM ip_public WHERE public "
        "UNION ALL SELECT repo_id, path, 5, n, 1, i, 'NET-SUSP-PORT', 'network', 'high', 65, 1.0, 1.0, n, left(s, 150), "
        "port, 'Suspicious Port (' || port || ')' FROM port_found JOIN ports USING (i) "
        "UNION ALL SELECT repo_id, path, 5, n, 2, i, 'NET-SUSP-DOMAIN', 'network', 'medium', 50, 1.0, 1.0, n, "
        "left(s, 150), domain, 'Suspicious Domain' FROM domain_verdicts WHERE bad)",
        "indicators AS (SELECT repo_id, path, 'IP: ' || ip AS indicator FROM ips "
        "UNION SELECT repo_id, path, 'Port: ' || port FROM port_found JOIN ports USING (i) "
        "UNION SELECT repo_id, path, 'Domain: ' || domain FROM domains)",
    ]


NETWORK = _network()

# --- Python syntax: the facts of each snippet, in visiting order --------------------------------
FACTS = {
    0: [("import", "pickle", 1, "")],
    5: [("call", "exec", 1, "base64.b64decode"), ("call", "base64.b64decode", 1, "")],
    10: [("import", "socket", 1, ""), ("import", "subprocess", 1, ""), ("call", "os.dup2", 2, "s.fileno"),
         ("call", "s.fileno", 2, "")],
    25: [("call", "requests.post", 1, ""), ("call", "open", 1, ""), ("call", "f", 2, "")],
    30: [("from", "pynput.keyboard", 1, ""), ("call", "keyboard.send", 2, "")],
    35: [("call", "cv2.VideoCapture", 1, ""), ("import", "pyaudio", 2, ""), ("import", "pyaudio", 3, "")],
    45: [("call", "subprocess.call", 1, ""), ("call", "os.system", 2, ""), ("call", "getattr", 3, "")],
    50: [("call", "eval", 1, "compile"), ("call", "compile", 1, ""), ("call", "codecs.decode", 2, ""),
         ("call", "eval", 3, "zlib.decompress"), ("call", "zlib.decompress", 3, "")],
    55: [("call", "connect", 1, "")],
    2: [("call", "eval", 1, "atob"), ("call", "atob", 1, "")],
    12: [("call", "execSync", 1, ""), ("call", "require", 1, "")],
    17: [("call", "fetch", 1, "")],
    22: [("call", "addEventListener", 1, "")],
    27: [("call", "navigator.mediaDevices.getUserMedia", 1, "")],
    32: [("call", "navigator.clipboard.readText", 1, ""), ("call", "navigator.geolocation.getCurrentPosition", 1, "")],
    23: [("call", "Assembly.GetType", 1, "")],
}
SYNTAX = [
    values("snippet_facts", "slot, seq, kind, name, line, inner_name", [
        (slot, seq, *fact) for slot, facts in FACTS.items() for seq, fact in enumerate(facts)]),
    f"facts AS (SELECT {SHELF} AS repo_id, CAST(doc_id AS VARCHAR) AS path, seq, kind, name, "
    "CASE WHEN kind = 'call' THEN string_split(name, '.')[-1] ELSE string_split(name, '.')[1] END AS base, "
    "length(text) - length(replace(text, chr(10), '')) + 1 + line AS lineno, nullif(inner_name, '') AS inner_name "
    "FROM documents JOIN snippet_facts ON doc_id % 60 = slot)",
    values("risky_imports", "base, severity, weight", [(m, s, w) for m, (s, w, _, _) in fx.RISKY_IMPORTS.items()]),
    values("risky_calls", "base, severity, weight", [(m, s, w) for m, (s, w, _, _) in fx.RISKY_CALLS.items()]),
    "syntax_raw AS ("
    "SELECT repo_id, path, seq, 0 AS part, lineno, 'AST-IMP-' || upper(base) AS rule_id, 'execution' AS category, severity, "
    "weight, 0.9::DOUBLE AS confidence, 1.0::DOUBLE AS multiplier, CASE WHEN kind = 'import' THEN 'import ' || base "
    "ELSE 'from ' || base || ' import ...' END AS matched_pattern, 'Dangerous Import: ' || base AS name "
    "FROM facts JOIN risky_imports USING (base) WHERE kind <> 'call' "
    "UNION ALL SELECT repo_id, path, seq, 0, lineno, 'AST-CALL-' || upper(base), 'execution', severity, weight, 0.95, "
    "1.0, name || '()', 'Dangerous Call: ' || name || '()' FROM facts JOIN risky_calls USING (base) WHERE kind = 'call' "
    "UNION ALL SELECT repo_id, path, seq, 1, lineno, 'AST-EXEC-OSSYSTEM', 'execution', 'high', 75, 0.95, 1.0, "
    "name || '()', 'System Command: ' || name || '()' FROM facts WHERE kind = 'call' AND name IN ('os.system', 'os.popen') "
    "UNION ALL SELECT repo_id, path, seq, 2, lineno, 'AST-OBF-CHAIN', 'obfuscation', 'critical', 95, 0.95, 1.5, "
    "base || '(' || inner_name || '(...))', 'Obfuscation Chain: ' || base || '(' || inner_name || '(...))' FROM facts "
    "WHERE kind = 'call' AND base IN ('exec', 'eval') AND "
    "regexp_matches(lower(inner_name), 'decode|decompress|loads|fromhex'))",
    "syntax_hits AS (SELECT r.repo_id, r.path, 2 AS a, seq AS k1, part AS k2, 0 AS k3, rule_id, category, severity, "
    "weight, confidence, multiplier, lineno AS line_number, left(line, 200) AS line_content, matched_pattern, name "
    "FROM syntax_raw r JOIN lines l ON l.repo_id = r.repo_id AND l.path = r.path AND l.n = r.lineno)",
]

# --- merge and scores --------------------------------------------------------------------------
def merged(detectors: list[str]) -> list[str]:
    union = " UNION ALL ".join(f"SELECT * FROM {d}" for d in detectors)
    return [
        f"hits AS (SELECT *, weight * confidence * multiplier AS eff FROM ({union}))",
        "keyed AS (SELECT *, CASE WHEN starts_with(rule_id, 'COMBO-') THEN -1 ELSE line_number END AS line_key, "
        "row_number() OVER (PARTITION BY repo_id, path ORDER BY a, k1, k2, k3) AS seq FROM hits)",
        "placed AS (SELECT *, min(seq) OVER (PARTITION BY repo_id, path, line_key, category) AS key_seq, "
        "row_number() OVER (PARTITION BY repo_id, path, line_key, category ORDER BY eff DESC, seq) AS place FROM keyed)",
        "findings AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, rule_id ORDER BY eff DESC, line_number, "
        "key_seq) AS occurrence, row_number() OVER (PARTITION BY repo_id, path ORDER BY line_number, eff DESC, key_seq) "
        "AS rank_in_file, row_number() OVER (PARTITION BY repo_id, path ORDER BY eff DESC, line_number, key_seq) "
        "AS rank_by_weight FROM placed WHERE place = 1)",
        "file_points AS (SELECT repo_id, path, sum(eff * CASE WHEN occurrence = 1 THEN 1.0 ELSE "
        "log2(2.0 / occurrence + 1.0) END) AS points, count(*) AS finding_count, "
        "count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count, "
        "arg_min(rule_id, rank_by_weight) AS top_finding_id FROM findings GROUP BY ALL)",
        "files AS (SELECT f.repo_id, f.path, language, length(text) AS file_size, coalesce(o.score, 0) AS obfuscation_score, "
        "least(100.0, coalesce(points, 0) + 0.15 * coalesce(o.score, 0)) AS risk_score, "
        "coalesce(finding_count, 0) AS finding_count, coalesce(critical_count, 0) AS critical_count, "
        "coalesce(high_count, 0) AS high_count, top_finding_id FROM file_text f "
        "LEFT JOIN file_points USING (repo_id, path) LEFT JOIN obfuscation o USING (repo_id, path))",
    ]


def level(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {floor} THEN '{n}'" for n, floor in fx.LEVEL_FLOORS) + " ELSE 'safe' END"


def verdict(score: str) -> str:
    return ("CASE " + " ".join(f"WHEN {score} >= {floor} THEN '{n}'" for n, floor in fx.VERDICT_FLOORS)
            + f" WHEN {score} > 10 THEN 'low' ELSE 'safe' END")


REPOS = [
    values("top_weights", "place, w", list(enumerate(fx.TOP_FILE_WEIGHTS, start=1))),
    values("verdicts", "verdict, message, advice", [(k, m, r) for k, (m, r) in fx.VERDICTS.items()]),
    "risky AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY risk_score DESC, path) AS place "
    "FROM files WHERE risk_score > 0)",
    "base_scores AS (SELECT repo_id, sum(risk_score * w) / CASE WHEN count(*) < 5 THEN sum(w) ELSE 1 END AS base "
    "FROM risky JOIN top_weights USING (place) GROUP BY repo_id)",
    "bonuses AS (SELECT repo_id, CASE WHEN count(*) FILTER (critical_count > 0) > 1 "
    "THEN least(15.0, (count(*) FILTER (critical_count > 0) - 1) * 5.0) ELSE 0 END "
    "+ CASE WHEN count(*) FILTER (obfuscation_score > 60) > 2 THEN 10 ELSE 0 END AS bonus FROM risky GROUP BY repo_id)",
    "totals AS (SELECT repo_id, count(*) AS total_files_scanned, sum(finding_count) AS total_findings, "
    "sum(critical_count) AS critical_findings, sum(high_count) AS high_findings FROM files GROUP BY repo_id)",
    "repo_scores AS (SELECT t.*, CASE WHEN base IS NULL THEN 0 ELSE least(100.0, base + bonus) END AS score FROM totals t "
    "LEFT JOIN base_scores USING (repo_id) LEFT JOIN bonuses USING (repo_id))",
    "repo_permissions AS (SELECT repo_id, list_sort(list(DISTINCT label)) AS labels FROM permission_found "
    "JOIN permissions USING (i) GROUP BY repo_id)",
    "file_types AS (SELECT repo_id, language, count(*) AS files FROM files GROUP BY ALL)",
    f"repos AS (SELECT s.*, {verdict('score')} AS verdict, {level('score')} AS risk_level, "
    "coalesce(labels, []) AS labels FROM repo_scores s LEFT JOIN repo_permissions USING (repo_id))",
    "repo_messages AS (SELECT r.repo_id, r.verdict, concat_ws(' ', message, CASE WHEN critical_findings > 0 THEN "
    "'Found ' || critical_findings::BIGINT || ' CRITICAL security issues.' END, CASE WHEN len(labels) > 0 THEN "
    "'Script requests access to: ' || array_to_string(labels[1:3], ', ') || '.' END, "
    "chr(10) || 'Recommendation: ' || advice) AS summary_message FROM repos r JOIN verdicts USING (verdict))",
]

DETECT = LINES + RULE_HITS + COMBO_HITS + ENTROPY_HITS + PERMISSION_HITS + NETWORK
ALL_HITS = ["rule_hits", "combo_hits", "entropy_hits", "permission_hits", "network_hits"]
SCAN = DETECT + merged(ALL_HITS) + REPOS
DEEP_SCAN = DETECT + SYNTAX + merged(ALL_HITS + ["syntax_hits"]) + REPOS


def sql(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
