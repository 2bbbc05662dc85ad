"""The rule book: one row of texts and weights per kind of finding."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftmoor.fixed import detectors as fx

SCHEMA = (
    "def_id int, rule_id string, name string, category string, subcategory string, severity string, "
    "weight int, description string, user_message string, mitre_attack string, confidence double, "
    "context_multiplier double"
)
BROADCAST_RULES = 50_000
# Ids of the built-in kinds are negative; catalogue rules use their catalogue position.
COMBO_BASE, IMPORT_BASE, FROM_BASE, CALL_BASE = -100, -200, -300, -400
SYSTEM_ID, CHAIN_ID, ENTROPY_HIGH_ID, ENTROPY_MED_ID, PUBLIC_IP_ID, DOMAIN_ID = -500, -501, -510, -511, -520, -521
PERMISSION_BASE, PORT_BASE = -600, -700


def combo_rule_id(name: str) -> str:
    return "COMBO-" + name[:10].upper().replace(" ", "")


def builtin_rows() -> list[tuple]:
    """FIXED VALUES: texts of the built-in kinds; ``{}`` and ``{2}`` stand for what varies."""
    rows = []

    def add(def_id, rule_id, name, category, subcategory, severity, weight, description, message,
            mitre="", confidence=1.0, multiplier=1.0):
        rows.append((def_id, rule_id, name, category, subcategory, severity, weight, description, message,
                     mitre, confidence, multiplier))

    for i, (name, _, weight, mitre, message) in enumerate(fx.COMBOS):
        add(COMBO_BASE - i, combo_rule_id(name), f"⚡ Combo: {name}", "combination", "pattern_combo", "critical",
            weight, f"Dangerous pattern combination: {name}", message, mitre, 0.85, 1.5)
    for i, (module, (severity, weight, mitre, text)) in enumerate(fx.RISKY_IMPORTS.items()):
        for base, verb in ((IMPORT_BASE, "imports"), (FROM_BASE, "imports from")):
            add(base - i, f"AST-IMP-{module.upper()}", f"Dangerous Import: {module}", "execution",
                "dangerous_import", severity, weight, text, f"🔍 This script {verb} '{module}' — {text.lower()}",
                mitre, 0.9)
    for i, (call, (severity, weight, mitre, text)) in enumerate(fx.RISKY_CALLS.items()):
        add(CALL_BASE - i, f"AST-CALL-{call.upper()}", "Dangerous Call: {}()", "execution", "dangerous_call",
            severity, weight, text, "🔍 Calls {}() — " + text.lower(), mitre, 0.95)
    add(SYSTEM_ID, "AST-EXEC-OSSYSTEM", "System Command: {}()", "execution", "shell_command", "high", 75,
        "Executes shell commands via {}", "🟠 Calls {}() to run system commands", "T1059", 0.95)
    add(CHAIN_ID, "AST-OBF-CHAIN", "Obfuscation Chain: {}", "obfuscation", "execution_chain", "critical", 95,
        "Decodes/decompresses data and immediately executes it",
        "🔴 OBFUSCATION CHAIN! {} — decodes hidden code and runs it!", "T1027", 0.95, 1.5)
    add(ENTROPY_HIGH_ID, "ENTROPY-HIGH", "Very High Entropy String", "obfuscation", "entropy", "high", 70,
        "String entropy {} exceeds threshold — likely encoded/encrypted",
        "🟠 OBFUSCATION! High entropy string detected (entropy: {2}) — may be encoded malicious payload")
    add(ENTROPY_MED_ID, "ENTROPY-MED", "High Entropy String", "obfuscation", "entropy", "medium", 40,
        "String entropy {} is elevated — could be encoded data",
        "🟡 Elevated entropy string (entropy: {2}) — could be encoded content")
    for i, (category, emoji, label, _) in enumerate(fx.PERMISSIONS):
        add(PERMISSION_BASE - i, f"PERM-{category.upper()}", f"Permission Requested: {label}", "permission",
            category, "info", 10, f"Script accesses: {label}", f"{emoji} Accesses {label}")
    add(PUBLIC_IP_ID, "NET-PUBLIC-IP", "Hardcoded Public IP", "network", "hardcoded_ip", "medium", 45,
        "Hardcoded public IP address: {}",
        "🟡 Hardcoded internet IP address ({}) — scripts shouldn't usually hardcode IPs", "T1071")
    for i, (port, use) in enumerate(fx.PORTS):
        add(PORT_BASE - i, "NET-SUSP-PORT", f"Suspicious Port ({port})", "network", "suspicious_port", "high", 65,
            f"Uses suspicious port {port} ({use})",
            f"🟠 Uses network port {port} — often used by malware ({use})", "T1071")
    add(DOMAIN_ID, "NET-SUSP-DOMAIN", "Suspicious Domain", "network", "suspicious_domain", "medium", 50,
        "Connects to unknown/suspicious domain: {}",
        "🟡 Connects to domain: {} — verify this is a trusted service", "T1071")
    return rows


def rule_book(spark: SparkSession, rules) -> DataFrame:
    """The book of a list of rules, or of a rule table, whose rows are left where they are.

    A list of up to BROADCAST_RULES rules is marked for broadcast; else Spark chooses by size.
    """
    builtin = spark.createDataFrame(builtin_rows(), SCHEMA)
    if isinstance(rules, DataFrame):
        texts = ["rule_id", "name", "category", "subcategory", "severity", "weight", "description", "user_message", "mitre_attack"]
        own = rules.select(F.col("rule_ord").alias("def_id"), *texts, F.lit(1.0).alias("confidence"), F.lit(1.0).alias("context_multiplier"))
        return own.unionByName(builtin)
    rows = [
        (r.rule_ord, r.rule_id, r.name, r.category, r.subcategory, r.severity, r.weight, r.description,
         r.user_message, r.mitre_attack, 1.0, 1.0)
        for r in rules
    ]
    book = spark.createDataFrame(rows + builtin_rows(), SCHEMA)
    return F.broadcast(book) if len(rows) <= BROADCAST_RULES else book


def fill(template, detail, detail2):
    """The text with its placeholders replaced; texts of catalogue rules have none."""
    filled = F.replace(F.replace(template, F.lit("{2}"), F.coalesce(detail2, F.lit(""))), F.lit("{}"), detail)
    return F.coalesce(filled, template)
