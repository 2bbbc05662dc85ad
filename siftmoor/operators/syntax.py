"""Python syntax facts (imports and calls), and the findings that follow from them.

The parser is the one step Spark cannot express.  It runs as an Arrow UDF that
emits facts; every rule on the facts is a column expression.
"""

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from siftmoor.fixed import detectors as fx
from siftmoor.operators.hits import SYNTAX, hit, no_hits
from siftmoor.operators.rulebook import CALL_BASE, CHAIN_ID, FROM_BASE, IMPORT_BASE, SYSTEM_ID

FACTS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("base", T.StringType()), T.StructField("lineno", T.IntegerType()),
    T.StructField("inner_name", T.StringType()),
]))


def _call_name(call: ast.Call) -> str:
    parts, node = [], call.func
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def facts_of(text: str | None) -> list[tuple]:
    """Imports and named calls of a program in source order, outer before inner; [] if it does not parse."""
    if text is None:
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except Exception:
        return []
    facts, todo = [], [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, ast.Import):
            for alias in node.names:
                facts.append(("import", alias.name, alias.name.split(".")[0], node.lineno, None))
        elif isinstance(node, ast.ImportFrom) and node.module:
            facts.append(("from", node.module, node.module.split(".")[0], node.lineno, None))
        elif isinstance(node, ast.Call):
            name = _call_name(node)
            if name:
                first = node.args[0] if node.args else None
                inner = _call_name(first) if isinstance(first, ast.Call) else None
                facts.append(("call", name, name.split(".")[-1], node.lineno, inner or None))
        todo.extend(reversed(list(ast.iter_child_nodes(node))))
    return facts


TEXTS_AT_ONCE = 64
_FACTS_ARROW = to_arrow_type(FACTS)


@F.arrow_udf(FACTS)
def _facts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """One text after the other is taken out of Arrow, and the facts of a few go back into it at once."""
    names = ("kind", "name", "base", "lineno", "inner_name")
    for texts in batches:
        parts = [
            pa.array([[dict(zip(names, fact)) for fact in facts_of(text.as_py())] for text in texts.slice(start, TEXTS_AT_ONCE)], _FACTS_ARROW)
            for start in range(0, len(texts), TEXTS_AT_ONCE)]
        yield pa.concat_arrays(parts) if parts else pa.array([], _FACTS_ARROW)


def syntax_facts(language: Column, text: Column) -> Column:
    """``array<fact>`` of a file; only Python texts are sent to the workers."""
    return _facts(F.when(language == "python", text))


def facts_table(file_text: DataFrame) -> DataFrame:
    """One row per fact, in visiting order."""
    python = file_text.where(F.col("language") == "python")
    facts = python.select("repo_id", "path", F.posexplode(_facts(F.col("text"))).alias("seq", "f"))
    return facts.select("repo_id", "path", "seq", "f.*")


def _place(value: Column, names) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), value).cast("int") - 1


def syntax_hits(facts: Column) -> Column:
    """``array<hit>`` of a file from its facts; needs the columns of ``with_lines``."""
    modules, calls = list(fx.RISKY_IMPORTS), list(fx.RISKY_CALLS)
    lines = F.col("lines")

    def of_fact(f, seq):
        base, name = f["base"], f["name"]
        line = F.when(f["lineno"] >= 1, F.get(lines, f["lineno"] - 1))
        line = F.substring(F.coalesce(line, F.lit("")), 1, fx.RULE_LINE_CHARS)

        def make(k2, def_id, matched, detail):
            return hit(SYNTAX, seq, k2, 0, def_id, f["lineno"], line, matched, detail)

        chain = F.concat(base, F.lit("("), f["inner_name"], F.lit("(...))"))
        chained = F.lit(False)
        for text in fx.CHAIN_INNER:
            chained = chained | F.lower(f["inner_name"]).contains(text)
        called = F.concat(name, F.lit("()"))
        is_call = f["kind"] == "call"
        return F.array_compact(F.array(
            F.when((f["kind"] == "import") & base.isin(modules), make(
                0, F.lit(IMPORT_BASE) - _place(base, modules), F.concat(F.lit("import "), base), base)),
            F.when((f["kind"] == "from") & base.isin(modules), make(
                0, F.lit(FROM_BASE) - _place(base, modules), F.format_string("from %s import ...", base), base)),
            F.when(is_call & base.isin(calls), make(0, F.lit(CALL_BASE) - _place(base, calls), called, name)),
            F.when(is_call & name.isin(fx.SYSTEM_CALLS), make(1, SYSTEM_ID, called, name)),
            F.when(is_call & base.isin(fx.CHAIN_OUTER) & chained, make(2, CHAIN_ID, chain, chain)),
        ))

    return F.coalesce(F.flatten(F.transform(facts, of_fact)), no_hits())
