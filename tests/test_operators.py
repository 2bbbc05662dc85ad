"""Single operators against plain Python on small fixtures."""

import io
import json
import math
import random
import re
import zipfile
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from siftmoor.fixed import detectors as fx
from siftmoor.functions import urls
from siftmoor.functions.entropy import at_most as entropy_bound, shannon, shannon_at_least
from siftmoor.functions.numbers import human_size, round_one
from siftmoor.functions.regex import prepare, rare_start, to_java
from siftmoor.functions.text import WHITESPACE, fold_case, shorten_path, split_lines, sql_text, strip, unix_newlines
from siftmoor.operators import syntax
from siftmoor.operators import admission, grams, network, networks
from siftmoor.operators.anchors import Anchors, one_by_one
from siftmoor.operators.lines import with_lines
from siftmoor.operators.rules import matches_by_join, rule_hits
from siftmoor.operators.syntax import facts_of
from siftmoor.plans.scan import scan
from siftmoor.sources import files as sources
from siftmoor.sources.catalogue import (unusable_patterns, 
    categories, default_rules, languages, read_rules, rule_patterns, rules_by_category, rules_for_language,
    rules_from_table, rules_table)


def column(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in frame.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


# --- text ----------------------------------------------------------------------------------------
def test_lines_follow_readlines(spark):
    texts = ["", "a", "a\n", "a\n\nb", "a\r\nb\rc\n", "\n", "x\x0by z\x85w"]
    expected = [re.sub("\r\n?", "\n", t).removesuffix("\n").split("\n") if t else [] for t in texts]
    assert column(spark, texts, lambda v: split_lines(unix_newlines(v))) == expected


def test_strip_follows_python(spark):
    values = [f"{a}x y{b}" for a in WHITESPACE for b in " 　"] + ["​x"]
    assert column(spark, values, strip) == [v.strip() for v in values]


def test_rounding_follows_python(spark):
    values = [k / 20 for k in range(0, 2001)] + [k / 1024 for k in range(0, 9000, 7)] + [k * 50_000 / 1e6 for k in range(20, 99)]
    assert column(spark, values, round_one, "double") == [round(v, 1) for v in values]


def test_sizes_and_paths(spark):
    sizes = [0, 1023, 1024, 1536, 1024 ** 2, 5 * 1024 ** 3]
    assert column(spark, sizes, human_size, "bigint") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 GB"]
    assert column(spark, ["a" * 40, "b" * 41], shorten_path) == ["a" * 40, "..." + "b" * 37]


# --- regular expressions ---------------------------------------------------------------------------
PATTERNS = [r"a\s+b", r"\bIEX\b", r"[^\s\"']+x", r"\w+!", r"x.y", r"key(down|up)['\"]", r"end$", r"^start", r"\d+",
            r"[\w.-]+@", r"so\S*t", r"ki", r"(?P<q>['\"])a(?P=q)", r"[[&&x]z"]
LINES = ["a b", "a\tb", "a\x1cb", "a\xa0b", "a\x85b", "a b", "iex", "éIEX", "IEX é", "café!", "x\ry", "x\x85y", "xéy",
         "keyDOWN'", "the end", "end ", "start", "１２", "ſocket", "soİt", "Ki", "kı", "'a'", '"a\'', "é.b@c", "&z",
         "[z", "xz", "á b", "²!", ""]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_java_patterns_match_like_python(spark, pattern):
    expected = [bool(re.search(pattern, line, re.IGNORECASE)) for line in LINES]
    assert column(spark, LINES, lambda v: v.rlike(to_java(pattern))) == expected


def test_every_rule_pattern_agrees_with_python(spark):
    """All patterns over lines made from the patterns' own texts, and anchors never rule out a match."""
    patterns = rule_patterns(default_rules())
    lines = sorted({re.sub(r"\\s[+*]", " ", re.sub(r"\\([^sdwbx])", r"\1", p.pattern)).replace(".*", " ")
                    for p in patterns} | {p.pattern for p in patterns} | {"nothing here", ""})
    frame = spark.createDataFrame([(line,) for line in lines], "line string")
    folded = fold_case(F.lower("line"))
    tests = [F.col("line").rlike(p.prepared.java) for p in patterns]
    guards = [F.lit(True) if not p.prepared.anchors else
              F.exists(F.array(*[F.lit(a) for a in p.prepared.anchors]), lambda a: folded.contains(a)) for p in patterns]
    for start in range(0, len(patterns), 60):
        part = slice(start, start + 60)
        rows = frame.select("line", F.array(*tests[part]).alias("m"), F.array(*guards[part]).alias("g")).collect()
        for row in rows:
            for p, matched, guarded in zip(patterns[part], row.m, row.g):
                source = p.pattern if p.type == "regex" else re.escape(p.pattern)
                assert matched == bool(re.search(source, row.line, re.IGNORECASE)), (p.pattern, row.line)
                assert guarded or not matched


def test_patterns_that_java_writes_differently(spark):
    patterns = [r"function\(\){", r"a{,3}b|aaa", r"f(?#note)unction", r"b[\W]c", r"b[^\W]c", r"b[^\Wx]c", r"[\S]x", r"[^\S]x", r"[\s\S]x", r"\Bc",
                r"c\B", r"\B", r"x{2}", r"x{1,2}y", r"x{2,}", r"{}", r"x{,}y", r"[{]", r"a{b}", r"\U00000041\x42", r"[\b]", r"\{,2}"]
    lines = ["", "function(){", "aaab", "b", "aaa", "b\u200dc", "b c", "bxc", "byc", "b_c", " x", "xx", "xxy", "xxx y", "y", "{}", "a{b}", "ABC", "c", "cc", "\b", "{", "- -", "\u00e9c"]
    assert [prepare(p, "regex") for p in (r"(x)?(?(1)y|aaa)", r"(a(x)?(?(2)y|z))", r"(?a)x", r"(?a:\w)")] == [None] * 4
    assert prepare(r"[(?a]x", "regex") is not None
    rule = replace(default_rules()[0], match_patterns=(("x", "regex"), ("(x)?(?(1)y|z)", "regex"), ("(", "regex"), ("(", "literal")))
    assert [tuple(r)[1:] for r in unusable_patterns(spark, [rule]).orderBy("pattern_ord").collect()] == [(1, "(x)?(?(1)y|z)"), (2, "(")]
    frame = spark.createDataFrame([(line,) for line in lines], "line string")
    for row in frame.select("line", *[F.col("line").rlike(prepare(p, "regex").java).alias(f"m{i}") for i, p in enumerate(patterns)]).collect():
        for i, p in enumerate(patterns):
            assert row[f"m{i}"] == bool(re.search(p, row.line, re.IGNORECASE)), (p, row.line)


def test_pattern_properties():
    assert prepare("(", "regex") is None
    assert prepare(":|", "regex").always and not prepare("^$", "regex").always
    assert prepare(r"import\s+mss", "regex").anchors == ("import",)
    assert prepare(r"\b(4444|5555)\b", "regex").anchors == ("4444", "5555")
    assert prepare(r"[^)]*x", "regex").in_text and prepare("a.*b", "regex").in_text
    assert [prepare(p, "regex").in_text for p in (r"a\nb", r"\Ax", r"x\Z", r"(?s)a.b", r"(?s:a.b)", "x?", "^$", r"(?:x|\n)y")] == [None] * 8


def test_first_line_by_position(spark):
    """A search of the whole text finds the line that a search of each line finds first."""
    rng = random.Random(3)
    odd = [r"[^x]y", r"[^x\s]y", r"x\sy", r"x\s*y", r"[\s]y", r"x\Wy", r"x[\W]y", r"x\Dy", r"[^\S]y", r"[^\W]y", r"[\S]y", r"^y", r"x$", r"^x\b.*y$", r"x(?!y)", r"(?<!x)y",
           r"x[\x00-\x20]y", r"[!-~]y", r"(x)\1", r"x.y", r"\by\b", r"\Bx", r"x[^]y]x", r"x[]\s]y", r"[&\s]x", r"x\Sy", "(?i)xY", r"x{2,}y?", r"(?=x)\w+y"]
    catalogue = [p for p in rule_patterns(default_rules()) if p.prepared.in_text]
    assert len(catalogue) >= 298
    pieces = ["x", "y", " ", "\t", "xx", "xy", "é", "😀", "\u2028", "\x85", "-", "1", "_", "&", "]", ""]
    texts = ["\n".join("".join(rng.choice(pieces) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 7))) + rng.choice(["", "\n", "\n\n"]) for _ in range(400)]
    hints = [re.sub(r"\\[sSwWdDbB]?|[\[\](){}?+*^$]", rng.choice([" ", "", "\n"]), p.pattern) for p in catalogue]
    texts += ["\n".join(["é😀", a, "x", b]) for a, b in zip(hints, hints[1:])] + hints
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    sources = [(p, prepare(p, "regex").in_text) for p in odd] + [(p.pattern if p.type == "regex" else re.escape(p.pattern), p.prepared.in_text) for p in catalogue]
    for start in range(0, len(sources), 60):
        part = sources[start:start + 60]
        numbers = [F.expr(f"CASE WHEN text RLIKE {sql_text(q)} THEN size(split(get(split(text, {sql_text(q)}, 2), 0), '\\n', -1)) END") for _, q in part]
        for row in frame.select("text", F.array(*numbers).alias("n")).collect():
            lines = row.text.split("\n")
            lines = lines[:-1] if lines[-1] == "" else lines
            for (source, _), n in zip(part, row.n):
                assert n == next((i + 1 for i, line in enumerate(lines) if re.search(source, line, re.IGNORECASE)), None), (source, row.text)
    assert prepare(r"\b(44|5x)\b", "regex").in_text.startswith("(?m)(?iudU)(?=[45])") and "(?=[" not in prepare(r"\b[^a]x", "regex").in_text
    assert "socket".endswith(rare_start("socket"))


def test_lines_that_hold_indexed_grams(spark, file_text, monkeypatch):
    """Every (line, gram) once; grams do not run over line ends or from file to file."""
    monkeypatch.setattr(grams, "SLICE_BYTES", 40)
    rng = random.Random(8)
    keys = ["abcd", "bcde", "ab", "x", "cab", "ékm"[1:], "zzzz"]
    texts = ["", "ab", "a\nbcd", "abcd" * 30, "ABCD\nſx\n\n", "\n\nab\n", None, "\u212am"] + [
        "".join(rng.choice("abcde\nX é😀") for _ in range(rng.randrange(60))) for _ in range(200)]
    numbers = [grams.gram_number(k.encode()) for k in keys]
    filled = grams.gram_filter(spark.createDataFrame([(s,) for s in grams.gram_slots(numbers)], "slot long"))
    table = file_text([("r", str(i), "go", t) for i, t in enumerate(texts)]).repartition(3)
    rows = [(r.path, r.line_number, r.line, r.gram) for r in grams.indexed_lines(table, filled, [1, 2, 3, 4]).where(F.col("gram").isin(numbers)).collect()]
    want = {(str(i), n + 1, line, grams.gram_number(k.encode())) for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n"))
            for k in keys if k in line.lower().replace("ſ", "s")}
    assert len(rows) == len(set(rows)) and set(rows) == want


# --- catalogue ------------------------------------------------------------------------------------
def test_catalogue_counts(spark):
    rules = default_rules()
    kinds = Counter(kind for r in rules for _, kind in r.match_patterns)
    assert (len(rules), kinds["regex"], kinds["literal"]) == (132, 178, 122)
    by_language = Counter(name for r in rules for name in r.languages)
    assert by_language == {"python": 57, "shell": 33, "powershell": 26, "javascript": 23, "all": 18}
    table = rules_table(spark, rules)
    assert rules_from_table(table) == rules
    assert rules_for_language(table, "go").count() == 18
    assert rules_by_category(table, "impact").count() > 0
    assert [r.language for r in languages(table).collect()] == ["all", "javascript", "powershell", "python", "shell"]
    assert categories(table).first().category == "collection"


def test_rule_files(tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"patterns": [
        {"id": "B", "match_patterns": [{"pattern": "x.y"}]}, {"id": "none"}]}))
    (tmp_path / "a.json").write_text(json.dumps({"patterns": [{"match_patterns": [{"pattern": "(", "type": "regex"}]}]}))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text("{}")
    rules = read_rules(str(tmp_path))
    assert [(r.rule_id, r.severity, r.weight, r.languages) for r in rules] == [
        ("UNKNOWN", "info", 0, ("all",)), ("B", "info", 0, ("all",))]
    assert [p.pattern for p in rule_patterns(rules)] == ["x.y"]
    assert read_rules(str(tmp_path / "missing")) == []


def test_yaml_rule_files(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yml").write_text('patterns:\n  - id: "Y"\n    weight: 5\n    match_patterns:\n      - pattern: "a\\\\.b"\n')
    (rule,) = read_rules(str(tmp_path))
    assert rule.match_patterns == (("a\\.b", "literal"),)


def test_dead_literals_and_unescape_mode(file_text):
    texts = file_text([("r", "a", "config", "x pool.minexmr.com"), ("r", "b", "config", r"x pool\.minexmr\.com")])
    strict = scan(texts, stage=False).findings.collect()
    assert [(r.path, r.rule_id) for r in strict] == [("b", "MINE-POOL-001")]
    loose = scan(texts, literal_mode="unescape", stage=False).findings.collect()
    assert [(r.path, r.rule_id) for r in loose] == [("a", "MINE-POOL-001")]


@pytest.mark.parametrize("languages", [None, ("python", "all"), ("all",), ("go", "python")])
def test_both_rule_plans_agree(spark, file_text, languages):
    texts = file_text([
        ("r", "a", "shell", "x\nnc -e /bin/sh\ncurl a | sh\ncurl b | bash"), ("r", "b", "python", "IMPORT  Pickle"),
        ("r", "c", "javascript", 'a = "ſocket"\nprocess.env.X'), ("r", "d", "config", "0x" + "a" * 40), ("r", "e", "go", "")])
    rules = default_rules()
    rules = rules if languages is None else [replace(r, languages=languages) for r in rules]
    patterns = rule_patterns(rules)
    anchors = Anchors(patterns)
    by_plan = with_lines(texts, anchors).select("repo_id", "path", F.inline(rule_hits(patterns, anchors)))
    by_join = matches_by_join(texts, rules_table(spark, rules)).select("repo_id", "path", "hit.*")
    rows, joined = (sorted(map(str, table.collect())) for table in (by_plan, by_join))
    assert rows == joined and len(rows) >= (1 if languages else 6)


# --- entropy, network, syntax ---------------------------------------------------------------------
def test_entropy(spark):
    values = ["", "a", "ab" * 20, "abcdefghijklmnopqrstuvwx", "é漢字é" * 9, "".join(map(chr, range(33, 120))), "x" * 999 + "y"]

    def expected(text):
        return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values()) if text else 0.0

    assert column(spark, values, shannon) == pytest.approx([expected(v) for v in values])
    assert column(spark, values, lambda v: shannon_at_least(v, 4.5)) == pytest.approx(
        [expected(v) if len(set(v)) >= 23 else 0 for v in values])


def test_entropy_bound_is_never_below_the_entropy(spark):
    rng = random.Random(4)
    prose = "a long line of common prose, in which no letter is as frequent as in a key; it has Many Kinds of characters (34) all the same."
    values = ["", " ", "é", "aaaa", prose, prose * 9, "漢字 eain" * 5] + ["".join(rng.choices(prose + "é漢😀xyzXYZ09", k=rng.randrange(1, 300))) for _ in range(200)]
    bounds, exact = column(spark, values, entropy_bound), column(spark, values, shannon)
    assert all(b >= e - 1e-9 for b, e in zip(bounds, exact))
    assert column(spark, [prose * 9], lambda v: shannon_at_least(v, 4.5)) == [0.0]      # 30 kinds of characters, yet ruled out
    assert len(set(prose)) > 2**4.5


def test_anchors_are_found_in_one_pass(spark, file_text):
    """The anchors of a file are those that occur in it, overlapping ones and beginnings of others too; few are looked for one by one."""
    anchors = Anchors(rule_patterns(default_rules()))
    rng = random.Random(9)
    for language in ("python", "shell", "go"):
        wanted = sorted(anchors.everywhere | anchors.by_language.get(language, set()))
        texts = ["", "\n", "ＡＢ😀"] + ["".join(rng.choice(wanted + [" ", "\n", "é", "x"])[: rng.choice([99, 99, 3])] for _ in range(rng.randrange(9))) for _ in range(300)]
        table = file_text([("r", str(i), language, t) for i, t in enumerate(texts)] + [("r", "null", language, None)])
        for row in with_lines(table, anchors).select("text", "folded", "found").collect():
            assert sorted(row.found) == [a for a in wanted if row.text is not None and a in row.folded]
        assert len(one_by_one(wanted)) < 0.3 * len(wanted)


def test_private_addresses(spark):
    import ipaddress

    values = ["8.8.8.8", "10.1.2.3", "172.15.255.255", "172.16.0.0", "172.32.0.0", "192.0.0.9", "192.0.0.8", "100.64.0.1",
              "224.0.0.1", "255.255.255.255", "198.19.0.1", "203.0.113.9", "0.0.0.0", "127.0.0.1", "169.254.9.9", "01.2.3.4",
              "10.0.0.01"]

    def expected(text):
        try:
            return ipaddress.ip_address(text).is_private
        except ValueError:
            return False

    assert column(spark, values, network.is_private) == [expected(v) for v in values]


def test_domains(spark):
    hosts = ["github.com", "api.github.com", "github.com.evil.org", "npm.pkg.github.com", "x.tk", "a.duckdns.org", "localhost",
             "1.2.3.4", "pypi.org", ""]
    assert column(spark, hosts, network.is_suspicious) == [
        False, False, True, False, True, True, True, False, False, True]
    assert column(spark, ["x.tk", "a.duckdns.org", "b.org"], network.suspicion) == ["tld", "dynamic dns", "unknown"]


def test_networks_by_longest_prefix(spark):
    import ipaddress

    rng = random.Random(4)
    cidrs = [f"{rng.choice([10, 172, 192])}.{rng.randrange(4)}.{rng.randrange(3)}.{rng.randrange(256)}/{rng.randrange(33)}" for _ in range(300)]
    odd = [None, "", "x", "1.2.3", "1.2.3.4/33", "256.1.1.1/8", "01.2.3.4/8", "10.0.0.0/8/9"]
    table = spark.createDataFrame([(c, f"n{i % 7}") for i, c in enumerate(cidrs)] + [(c, "bad") for c in odd] + [("10.1.1.1", "one"), ("10.1.1.1/32", "ones")], "cidr string, label string")
    ips = [f"{rng.choice([10, 172, 192, 9])}.{rng.randrange(4)}.{rng.randrange(3)}.{rng.randrange(256)}" for _ in range(500)] + ["10.1.1.1", "10.1.1.1", None, "01.2.3.4", "10.1.1.256", "a"]
    nets = {}
    for i, c in enumerate([*cidrs, "10.1.1.1/32"]):
        net = ipaddress.ip_network(c, strict=False)
        nets[net] = min(nets.get(net, "z"), "one" if i == len(cidrs) else f"n{i % 7}")

    def expected(ip):
        try:
            held = [n for n in nets if ipaddress.ip_address(ip) in n]
        except ValueError:
            held = []
        best = max(held, key=lambda n: n.prefixlen, default=None)
        return (ip, "x", str(best) if best else None, nets.get(best))

    rows = spark.createDataFrame([(ip, "x") for ip in ips], "ip string, more string")
    assert sorted(map(tuple, networks.networks_of(rows, table).collect()), key=str) == sorted(map(expected, ips), key=str)
    assert [tuple(r)[2:] for r in networks.networks_of(rows, table.limit(0)).distinct().collect()] == [(None, None)] * len(set(ips))
    values = ["8.8.8.8", "10.1.2.3", "192.0.0.9", "192.0.0.8", "172.32.0.0", "255.255.255.255"]
    known = networks.networks_of(spark.createDataFrame([(v,) for v in values], "ip string"), networks.default_networks(spark)).collect()
    assert {r.ip: r.label == "private" for r in known} == dict(zip(values, column(spark, values, network.is_private)))


def test_hosts_against_a_table_of_domains(spark):
    hosts = ["github.com", "api.github.com", "a.b.github.com", "github.com.evil.org", "npm.pkg.github.com", "x.tk", "localhost", "1.2.3.4", "pypi.org", "", None, "x.tk"]
    table = spark.createDataFrame([(h, i) for i, h in enumerate(hosts)], "host string, n int")
    domains = spark.createDataFrame([(d,) for d in fx.SAFE_DOMAINS] * 2 + [(None,)], "domain string")
    left = sorted(r.n for r in networks.unsafe_hosts(table, domains).collect())
    assert left == [i for i, bad in enumerate(column(spark, hosts[:10], network.is_suspicious)) if bad] + [11]
    deep = spark.createDataFrame([("pkg.github.com",), ("tk",)], "domain string")
    assert sorted(r.n for r in networks.unsafe_hosts(table, deep, any_parent=True).collect()) == [0, 1, 2, 3, 6, 8, 9]
    assert networks.unsafe_hosts(table, deep.limit(0)).count() == 10


def test_addresses_follow_python(spark):
    lines = ["1.2.3.4", "a1.2.3.4", "1.2.3.4.5", "256.1.1.1 1.1.1.256", "é1.2.3.4", "x 1.2.3.4, 5.6.7.8", "1.2.3.4_"]
    assert column(spark, lines, network.addresses) == [re.findall(fx.IPV4, line) for line in lines]


def test_ports(spark):
    lines = ["port 4444", "4444", "x: 14444", "bind 31337 and 1337", "LISTEN 6667é"]
    assert column(spark, lines, network.ports_of) == [[0], [], [], [3, 4], []]


def test_syntax_facts():
    assert facts_of("import a.b, c\nfrom . import x\nfrom d.e import f") == [
        ("import", "a.b", "a", 1, None), ("import", "c", "c", 1, None), ("from", "d.e", "d", 3, None)]
    assert facts_of("exec(z.loads(b))") == [("call", "exec", "exec", 1, "z.loads"), ("call", "z.loads", "loads", 1, None)]
    assert facts_of("f()()\ng().h(1)") == [("call", "f", "f", 1, None), ("call", "h", "h", 2, None), ("call", "g", "g", 2, None)]
    assert facts_of("def (") == [] and facts_of(None) == [] and facts_of("a\0") == [] and facts_of("﻿import os") == []
    assert facts_of("x = " + "-" * 5000 + "1") == []         # deeper than the parser allows, or nothing to find


# --- URLs -----------------------------------------------------------------------------------------
def test_repo_urls(spark):
    values = ["https://github.com/o/r", "https://github.com/o/r.git", "https://github.com/o/r/tree/dev/x",
              "git@github.com:o/r.git", " https://www.github.com/o/r/ ", "https://gitlab.com/o/r", "https://github.com/o", "",
              "ftp://github.com/o/r", "git@gitlab.com:o/r", "https://github.com/o/b@d"]
    parsed = [tuple(r) for r in column(spark, values, urls.parse_repo_url)]
    assert parsed[:7] == [("o", "r", None), ("o", "r", None), ("o", "r", "dev"), ("o", "r", None), ("o", "r", None),
                          (None, None, None), (None, None, None)]
    checked = [r.error for r in column(spark, values, urls.validate_repo_url)]
    assert checked == ["", "", "", "", "", urls.BAD_HOST, urls.NO_REPO, urls.EMPTY, urls.BAD_SCHEME, urls.BAD_SSH,
                       "Invalid repository name: 'b@d'"]
    assert column(spark, values[:1] + values[5:6], urls.display_name) == ["o/r", "https://gitlab.com/o/r"]


# --- admission and sources --------------------------------------------------------------------------
TREE = {
    "pkg/__init__.py": (b"x=1", "python"), ".env": (b"K=1", "config"), ".bashrc": (b"K=1", "shell"),
    ".hidden.py": (b"x=1", "hidden file"), "LICENSE": (b"text", "excluded file"), "empty.py": (b"", "empty file"),
    "big.py": (b"x" * 1_000_001, "file too large (1.0MB)"), "full.py": (b"x" * 1_000_000, "python"),
    "nul.py": (b"a\0b", "binary file"), "cyr.py": ("привет".encode(), "binary file"),
    "latin.py": (b"# caf\xe9 and more text", "python"), "Makefile": (b"all:", "shell"), "x.MJS": (b"x", "javascript"),
    "tool": (b"#!/usr/bin/env python3\nx", "python"), "tool2.txt": (b"#!/usr/bin/env fish\n", "shell"),
    "notes.txt": (b"text", "unsupported file type"), "crlf.sh": (b"a\r\nb\rc\n", "shell"),
    "node_modules/m.js": (b"x", None), "x.egg-info/a.py": (b"x", None), "sub/env/a.py": (b"x", None),
    "bom.py": (b"\xef\xbb\xbfx = 1  # note", "python"), "..rc": (b"x", "hidden file"), "_private/b.sh": (b"x", "shell"),
}


def outcome(files):
    judged = admission.judged(files).select("path", F.coalesce("skip_reason", "language").alias("o")).collect()
    return {r.path: r.o for r in judged}


def test_tree(spark, tmp_path):
    for path, (content, _) in TREE.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    roots = spark.createDataFrame([("r", str(tmp_path))], "repo_id string, root string")
    files = sources.tree_files(roots)
    assert outcome(files) == {path: expected for path, (_, expected) in TREE.items() if expected}
    texts = {r.path: r for r in admission.admitted(files).collect()}
    assert texts["crlf.sh"].text == "a\nb\nc\n" and texts["crlf.sh"].file_size == 6
    assert texts["latin.py"].text == "# café and more text" and texts["bom.py"].text == "\ufeffx = 1  # note"


def test_directory_rule_without_walking(spark):
    rows = [("r", path, len(content), bytearray(content)) for path, (content, _) in TREE.items()]
    files = spark.createDataFrame(rows, "repo_id string, path string, size_bytes bigint, content binary")
    assert outcome(files) == {path: expected or "skipped directory" for path, (_, expected) in TREE.items()}


def test_many_tasks_list_and_read(spark, tmp_path):
    """40 roots with 2,000 files in all: listing and reading use many tasks although names are thin."""
    for r in range(40):
        for d in range(5):
            folder = tmp_path / f"r{r}" / f"d{d}" / "a" / "b" / "c"
            folder.mkdir(parents=True)
            for k in range(10):
                (folder / f"f{k}.py").write_text(f"x = {r * 1000 + d * 100 + k}\n")
    (tmp_path / "r0" / "loop").symlink_to(tmp_path / "r0", target_is_directory=True)
    roots = spark.createDataFrame([(f"r{r}", str(tmp_path / f"r{r}")) for r in range(40)], "repo_id string, root string")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    for made in (sources.tree_names(roots), sources.tree_files(roots)):
        rows = made.select("repo_id", "path", F.spark_partition_id().alias("task")).collect()
        assert len({r.task for r in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert Counter((r.repo_id, r.path) for r in rows) == Counter(
            (f"r{r}", f"d{d}/a/b/c/f{k}.py") for r in range(40) for d in range(5) for k in range(10))


def test_contents_are_handed_on_in_small_batches(spark):
    """40 files of 500 kB in one task: it never holds more than a few megabytes of them."""
    def read(root, members, chunk):
        import tracemalloc

        tracemalloc.start()
        for member in members:
            yield bytes(500_000), str(tracemalloc.get_traced_memory()[0])
        tracemalloc.stop()

    names = spark.createDataFrame([("r", "/", f"/f{k}.py", f"f{k}.py", 500_000, "same", None) for k in range(40)], sources.NAMES).coalesce(1)
    rows = sources._contents(names, read).select("path", F.length("content").alias("n"), F.col("error").cast("long").alias("held")).collect()
    assert {(r.path, r.n) for r in rows} == {(f"f{k}.py", 500_000) for k in range(40)}
    assert max(r.held for r in rows) < 8_000_000


def archive(members) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return data.getvalue()


def test_archives(spark, tmp_path):
    shapes = {
        "one": archive({"root-1/": "", "root-1/a.py": "import pickle", "root-1/d/b.sh": "echo", "top.py": "x"}),
        "two": archive({"p/a.py": "x", "q/b.py": "y"}),
        "flat": archive({"a.py": "x"}),
        "broken": b"no archive",
    }
    for name, data in shapes.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    table = spark.createDataFrame([(name, str(tmp_path / f"{name}.zip")) for name in shapes], "repo_id string, root string")
    names = sources.archive_names(table)
    files = sources.archive_files(names)
    assert {(r.repo_id, r.path) for r in files.collect()} == {
        ("one", "a.py"), ("one", "d/b.sh"), ("two", "p/a.py"), ("two", "q/b.py"), ("flat", "a.py")}
    errors = sources.archive_errors(names)
    repos = table.select("repo_id").join(errors, "repo_id", "left")
    verdicts = {r.repo_id: r for r in scan(admission.admitted(files), repos=repos, stage=False).repos.collect()}
    assert verdicts["one"].verdict == "high" and verdicts["broken"].verdict == "critical"
    assert verdicts["broken"].summary_message == "Scan failed: Downloaded file is not a valid ZIP archive"


def test_damaged_archives_fail_their_repository(spark, tmp_path):
    """A damaged stream, a wrong checksum, an encrypted member and a broken directory: one error row, no failed job."""
    content = b"import pickle  # " + b"0123456789abcdef" * 40
    deflated, stored = io.BytesIO(), io.BytesIO()
    for data, kind in ((deflated, zipfile.ZIP_DEFLATED), (stored, zipfile.ZIP_STORED)):
        with zipfile.ZipFile(data, "w", kind) as z:
            z.writestr("a.py", content)
            z.writestr("ok.sh", "echo")
    stream, checksum, encrypted, directory, skipped = (bytearray(x.getvalue()) for x in (deflated, stored, stored, stored, stored))
    stream[36:44] = b"\xff" * 8
    checksum[60] ^= 1
    encrypted[6] |= 1
    encrypted[encrypted.index(b"PK\x01\x02") + 8] |= 1
    at = directory.index(b"PK\x01\x02")
    directory[at : at + 4] = b"\0\0\0\0"
    skipped = bytearray(bytes(skipped).replace(b"a.py", b".x.y"))
    skipped[60] ^= 1
    shapes = {"stream": stream, "checksum": checksum, "encrypted": encrypted, "directory": directory, "skipped": skipped}
    for name, data in shapes.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    table = spark.createDataFrame([(name, str(tmp_path / f"{name}.zip")) for name in shapes], "repo_id string, root string")
    names = sources.archive_names(table)
    files = sources.archive_files(names)
    errors = sources.archive_errors(names, files)
    assert Counter(r.repo_id for r in errors.collect()) == Counter(["stream", "checksum", "encrypted", "directory"])
    verdicts = {r.repo_id: r for r in scan(admission.admitted(files), repos=errors, stage=False).repos.collect()}
    for name in ("stream", "checksum", "encrypted", "directory"):
        assert verdicts[name].verdict == "critical" and verdicts[name].summary_message.startswith("Scan failed: ")
    assert verdicts["skipped"].total_files_scanned == 1   # a member that is skipped by name is never opened


def members_of(names) -> Counter:
    files = sources.archive_files(names)
    assert sources.archive_errors(names, files).count() == 0
    return Counter((r.repo_id, r.path, bytes(r.content)) for r in files.collect())


def test_an_archive_is_split(spark, tmp_path, monkeypatch):
    """Spans of the directory are listed, and chunks of members read, by many tasks; all forms of end records."""
    monkeypatch.setattr(sources, "SPAN_BYTES", 1 << 12)
    monkeypatch.setattr(sources, "CHUNK_BYTES", 1 << 10)
    content = {f"top/d{i % 7}/f{i}.py": f"x = {i}\n" * (i % 50 + 1) for i in range(3000)}
    data = archive(content)
    commented = io.BytesIO(data)
    with zipfile.ZipFile(commented, "a") as z:
        z.comment = b"a comment " * 500
    shapes = {"plain": data, "comment": commented.getvalue(), "prefix": b"#!/bin/sh\nexit 0\n" * 400 + data}
    for name, made in shapes.items():
        (tmp_path / f"{name}.zip").write_bytes(made)
        names = sources.archive_names(spark.createDataFrame([(name, str(tmp_path / f"{name}.zip"))], "repo_id string, root string"))
        assert members_of(names) == Counter((name, path.removeprefix("top/"), text.encode()) for path, text in content.items())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert names.select("chunk").distinct().count() > 10 * tasks
    assert sources.archive_files(names).select(F.spark_partition_id()).distinct().count() == tasks
    spans = list(sources._spans("r", str(tmp_path / "prefix.zip")))
    assert len(spans) > 40 and sum(int(s[2].split(",")[3]) for s in spans) == len(content)


def test_archive_of_more_members_than_two_bytes_count(spark, tmp_path):
    content = {f"f{i}.py": "" for i in range(70_000)} | {"last.py": "import pickle"}
    (tmp_path / "big.zip").write_bytes(archive(content))
    names = sources.archive_names(spark.createDataFrame([("r", str(tmp_path / "big.zip"))], "repo_id string, root string"))
    assert names.count() == len(content)
    assert [bytes(r.content) for r in sources.archive_files(names).where("size_bytes > 0").collect()] == [b"import pickle"]


def test_odd_archives(spark, tmp_path, monkeypatch):
    """Of members with one name the last one counts, also in another span; empty, cut off and missing archives."""
    monkeypatch.setattr(sources, "SPAN_BYTES", 1)
    twice = io.BytesIO()
    with zipfile.ZipFile(twice, "w") as z, pytest.warns(UserWarning):
        for text in ("first", "second"):
            z.writestr("a.py", text)
            z.writestr(f"{text}.py", text)
    (tmp_path / "twice.zip").write_bytes(twice.getvalue())
    (tmp_path / "empty.zip").write_bytes(archive({}))
    (tmp_path / "cut.zip").write_bytes(twice.getvalue()[:-30])
    roots = [(n, str(tmp_path / f"{n}.zip")) for n in ("twice", "empty", "cut", "gone")]
    names = sources.archive_names(spark.createDataFrame(roots, "repo_id string, root string"))
    files = sources.archive_files(names).collect()
    assert {(r.repo_id, r.path, bytes(r.content)) for r in files} == {
        ("twice", "a.py", b"second"), ("twice", "first.py", b"first"), ("twice", "second.py", b"second")} and len(files) == 3
    assert {r.repo_id for r in sources.archive_errors(names).collect()} == {"cut", "gone"}
    assert names.where("repo_id = 'empty'").count() == 0


def test_syntax_facts_of_more_texts_than_are_taken_at_once(spark, file_text):
    count = 2 * syntax.TEXTS_AT_ONCE + 7
    texts = [("r", str(i), "python", None if i % 5 == 0 else "x = (" if i % 5 == 1 else f"import os{i}\nf{i}(g())") for i in range(count)]
    found = {(r.path, r.name) for r in syntax.facts_table(file_text(texts).coalesce(1)).collect()}
    assert found == {(str(i), name) for i in range(count) if i % 5 > 1 for name in (f"os{i}", f"f{i}", "g")}
