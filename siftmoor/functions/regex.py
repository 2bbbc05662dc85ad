"""Regular expressions written for Python ``re``, run by Spark's Java engine.

Rules are written as Python patterns (Unicode text, case-insensitive search in
one line).  Spark runs Java patterns, whose ``\\s``, ``\\w`` and ``\\b`` differ, so
these are spelled out as explicit classes.  All of it happens once per pattern,
on the driver, while the plan is built.
"""

import re
import re._parser as sre
from dataclasses import dataclass
from functools import lru_cache

FLAGS = "(?iudU)"          # ignore case (Unicode), "\n" is the only line end, Unicode classes
SPACE = r"\s\x1c-\x1f"
WORD = r"\p{L}\p{N}_"
_EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_OUTSIDE = {"s": f"[{SPACE}]", "S": f"[^{SPACE}]", "w": f"[{WORD}]", "W": f"[^{WORD}]", "b": _EDGE, "B": f"(?!{_EDGE})(?!^$)", "Z": r"\z"}
_INSIDE = {"s": SPACE, "w": WORD, "S": f"[^{SPACE}]", "W": f"[^{WORD}]", "b": r"\x08"}
# The same for a search in a whole text, where no match may run over a line end.
_OUTSIDE_LINE = {**_OUTSIDE, "s": f"[{SPACE}&&[^\\n]]", "W": f"[^{WORD}\\n]", "D": r"[^\d\n]"}
_LINE_CLASS = re.compile(r"[\\\x00-\x1f]")
_REPEAT = re.compile(r"\{(\d*)(,?)(\d*)\}")
_CODE_POINT = re.compile(r"\\(?:U([0-9a-fA-F]{8})|0([0-7]{0,2}))")


def to_java(pattern: str, flags: str = FLAGS, in_text: bool = False) -> str:
    """The Java pattern; with ``in_text`` one that searches a text of several lines for matches within a line."""
    # named groups: Java writes (?<n>...) and \\k<n>, with letters and digits only
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'u')}>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{m[1].replace('_', 'u')}>", pattern)
    out, in_class, i = [], False, 0
    opened, negated = 0, False
    while i < len(pattern):
        ch = pattern[i]
        if code := _CODE_POINT.match(pattern, i):
            out.append(f"\\x{{{int(code[1], 16) if code[1] else int(code[2] or '0', 8):x}}}")
            i = code.end()
            continue
        if not in_class and pattern.startswith("(?#", i):       # a comment
            i = pattern.index(")", i) + 1
            continue
        if not in_class and ch == "{":                          # Java knows no {,n} and no literal {
            count = _REPEAT.match(pattern, i)
            repeats = count and (count[1] or count[2])
            out.append(f"{{{count[1] or 0}{count[2]}{count[3]}}}" if repeats else "\\{")
            i = count.end() if repeats else i + 1
            continue
        if ch == "\\" and i + 1 < len(pattern):
            table = _INSIDE if in_class else _OUTSIDE_LINE if in_text else _OUTSIDE
            out.append(table.get(pattern[i + 1], pattern[i:i + 2]))
            i += 2
            continue
        if ch == "[" and in_class:
            out.append("\\[")          # Java nests classes, Python does not
        elif ch == "&" and in_class:
            out.append("\\&")          # Java reads && as an intersection
        else:
            if ch == "]" and in_class and in_text and (negated or _LINE_CLASS.search(pattern, opened, i)):
                out.append("\\n" if negated else r"&&[^\n]")
            out.append(ch)
            if ch == "[":
                in_class, opened, negated = True, i + 1, pattern.startswith("^", i + 1)
                for lead in ("^", "]"):       # a leading "]" is an ordinary character
                    if pattern.startswith(lead, i + 1):
                        out.append(lead if lead == "^" else "\\]")
                        i += 1
            elif ch == "]":
                in_class = False
        i += 1
    return flags + "".join(out)


def literal_to_java(text: str) -> str:
    return FLAGS + re.sub(r"([^A-Za-z0-9_ \x80-\U0010ffff])", r"\\\1", text)


@dataclass(frozen=True)
class Prepared:
    """A pattern ready for use in a plan."""

    java: str
    anchors: tuple[str, ...]   # lower-case ASCII texts; a match contains at least one of them; () = unknown
    parts: tuple               # further such groups of texts
    always: bool               # matches every line, the empty one included
    in_text: str | None        # searches a whole text for matches within a line; None where that cannot be written


@lru_cache(maxsize=10_000)
def prepare(pattern: str, kind: str) -> Prepared | None:
    """None for a pattern that does not compile, or that has conditional groups or ASCII flags, which Java lacks."""
    source = pattern if kind == "regex" else re.escape(pattern)
    try:
        re.compile(source, re.IGNORECASE)
        tree = sre.parse(source, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return None
    if kind == "regex" and (_conditional(tree) or re.search(r"(?<!\\)\(\?[a-zA-Z]*[aL][a-zA-Z]*[-:)]", source)):
        return None
    java = to_java(pattern) if kind == "regex" else literal_to_java(pattern)
    always = tree.getwidth()[0] == 0 and not _has_assertion(tree)
    groups = [] if always else _required(tree)
    anchors = _best(groups)
    parts = tuple(dict.fromkeys(group for group in groups if group != anchors))
    in_text = None
    if tree.getwidth()[0] and not tree.state.flags & (re.DOTALL | re.VERBOSE) and not _sees_text(tree):
        in_text = "(?m)" + _led(to_java(pattern, in_text=True) if kind == "regex" else java, tree)
    return Prepared(java, anchors, parts, always, in_text)


def _led(java: str, tree) -> str:
    """A pattern that begins with an assertion, behind a test of its first character, which costs less."""
    first = _first_characters(tree)
    if tree[0][0] is not sre.AT or not first:
        return java
    return f"{FLAGS}(?=[{''.join(sorted(first))}])(?:{java.removeprefix(FLAGS)})"


def _first_characters(tree) -> set[str]:
    """The letters and digits a match can begin with; empty if it can begin with others."""
    for op, arg in tree:
        if op is sre.AT:
            continue
        if op is sre.LITERAL:
            return {chr(arg)} if arg < 128 and chr(arg).isalnum() else set()
        if op is sre.SUBPATTERN and not arg[1] and not arg[2]:
            return _first_characters(arg[3])
        if op is sre.BRANCH:
            options = [_first_characters(branch) for branch in arg[1]]
            return set().union(*options) if all(options) else set()
        return set()
    return set()


def _loops() -> tuple:
    """The operators that repeat; a function, as the parser's constants cannot travel with jobs."""
    return sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT


def _children(op, arg):
    if op in _loops():
        return [arg[2]]
    if op is sre.SUBPATTERN:
        return [arg[3]]
    if op is sre.BRANCH:
        return arg[1]
    if op is sre.ATOMIC_GROUP:
        return [arg]
    if op in (sre.ASSERT, sre.ASSERT_NOT):
        return [arg[1]]
    return []


def _conditional(tree) -> bool:
    return any(op is sre.GROUPREF_EXISTS or any(_conditional(child) for child in _children(op, arg)) for op, arg in tree)


def _has_assertion(tree) -> bool:
    plain = (sre.LITERAL, sre.NOT_LITERAL, sre.ANY, sre.IN, sre.BRANCH, sre.SUBPATTERN, *_loops())
    return any(op not in plain or any(_has_assertion(c) for c in _children(op, arg)) for op, arg in tree)


def _sees_text(tree) -> bool:
    """The pattern names a line end, the edge of the searched text, or lets a point match line ends."""
    for op, arg in tree:
        if op is sre.LITERAL and arg == ord("\n") or op is sre.AT and arg in (sre.AT_BEGINNING_STRING, sre.AT_END_STRING):
            return True
        if op is sre.IN and arg[0][0] is not sre.NEGATE and (sre.LITERAL, ord("\n")) in arg:
            return True
        if op is sre.SUBPATTERN and arg[1] & (re.DOTALL | re.VERBOSE):
            return True
        if any(_sees_text(child) for child in _children(op, arg)):
            return True
    return False


def _required(tree) -> list[tuple[str, ...]]:
    """Groups of texts; every match contains at least one text of each group."""
    groups, run = [], ""
    for op, arg in tree:
        if op is sre.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if op is sre.AT:
            continue
        groups.append((run,))
        run = ""
        if op is sre.SUBPATTERN and not arg[1] and not arg[2]:
            groups.extend(_required(arg[3]))
        elif op in _loops() and arg[0] >= 1:
            groups.extend(_required(arg[2]))
        elif op is sre.BRANCH:
            options = [_best(_required(branch)) for branch in arg[1]]
            if all(options):
                groups.append(tuple(sorted({text for option in options for text in option})))
    groups.append((run,))
    return [group for group in groups if all(group)]


def _best(groups) -> tuple[str, ...]:
    return max(groups, key=lambda texts: (min(map(len, texts)), -len(texts)), default=())


_COMMON_FIRST = "etaoinsrhldcumfpgwybvk "     # letters of prose and code, most frequent first


def rare_start(anchor: str, keep: int = 4) -> str:
    """The anchor cut to begin at its rarest character: substring tests compare first characters first."""
    starts = range(max(1, len(anchor) - keep + 1))
    return anchor[max(starts, key=lambda i: (_COMMON_FIRST.find(anchor[i]) % 99, -i)):]
