"""Anchors: short texts that every match of a detector contains.

The anchors that can matter for a file's language are looked for in one pass over
its text; a detector looks at the file's lines only if one of its anchors was found.  This
only ever skips work that could not have led to a hit.
"""

from collections import defaultdict

from pyspark.sql import Column, functions as F

from siftmoor.fixed import detectors as fx
from siftmoor.functions.regex import Prepared, prepare, rare_start
from siftmoor.functions.text import sql_array, sql_literal, sql_text

SCHEME = "://"
HTTP = "http"


_HEAD = 4           # characters of an anchor that the search looks for; where they occur, the whole anchor is tested
_FEW = 6            # alternatives that are tried one by one
_COMMON = "etaoinsrhldcumf "


def _head(anchor: str) -> str:
    """The part of an anchor that the search looks for: it begins with the rarest character."""
    return rare_start(anchor, max(4, len(anchor) - 2))[:_HEAD]


def _any_start(options: dict[str, str]) -> str:
    """One of several patterns, given by their first characters; halves are chosen by a class, so that few are tried."""
    if len(options) <= _FEW:
        return "|".join(options.values())
    keys = sorted(options)
    halves = keys[: len(keys) // 2], keys[len(keys) // 2:]
    return "|".join(f"(?=[{''.join(map(_quoted, half))}])(?:{_any_start({k: options[k] for k in half})})" for half in halves)


def _quoted(ch: str) -> str:
    return ch if ch.isalnum() else f"\\x{{{ord(ch):x}}}"


def longest_of(texts) -> str:
    """A Java pattern for the longest of several texts that starts at a place."""
    by_first = defaultdict(set)
    for text in texts:
        by_first[text[:1]].add(text[1:])
    optional = by_first.pop("", None) is not None
    if not by_first:
        return ""
    rest = _any_start({first: _quoted(first) + longest_of(tails) for first, tails in by_first.items()})
    return f"(?:{rest})" + ("?" if optional else "")


def one_by_one(anchors) -> list[str]:
    """The anchors without a rare character, and those too short to begin with one."""
    return sorted(a for a in anchors if len(_head(a)) < 2 or _head(a)[0] in _COMMON)


def _search(anchors) -> str:
    """SQL: the anchors in ``folded``.

    Those with a rare character are found in one pass over the text, which stops at such characters only; what follows one
    leads to anchors.  The others are looked for one by one.
    """
    single = one_by_one(anchors)
    found, by_tail = sql_array(single) if single else "CAST(array() AS array<string>)", defaultdict(list)
    for anchor in sorted(set(anchors) - set(single)):
        by_tail[_head(anchor)[1:]].append(anchor)
    if by_tail:
        firsts = "".join(map(_quoted, sorted({_head(a)[0] for texts in by_tail.values() for a in texts})))
        # What was found stands for the shorter texts it begins with as well.
        led_to = {tail: [a for n in range(1, len(tail) + 1) for a in by_tail.get(tail[:n], [])] for tail in by_tail}
        tails = f"array_distinct(regexp_extract_all(folded, {sql_text(f'[{firsts}](?=({longest_of(by_tail)}))')}, 1))"
        found = f"concat({found}, flatten(transform({tails}, t -> element_at({sql_literal(led_to, 'map<string,array<string>>')}, t))))"
    return f"filter(array_distinct({found}), a -> contains(folded, a))"


class Anchors:
    """The anchors of all detectors of one scan."""

    def __init__(self, patterns):
        everywhere = {a for *_, group in fx.PERMISSIONS for p in group for a in prepare(p, "regex").anchors}
        everywhere |= {text.lower() for _, required, *_ in fx.COMBOS for text in required}
        everywhere |= {str(port) for port, _ in fx.PORTS} | {SCHEME, HTTP}
        by_language = defaultdict(set)
        for p in patterns:
            for language in p.rule.languages:
                (everywhere if language == "all" else by_language[language]).update(p.prepared.anchors)
        self.everywhere = {rare_start(a) for a in everywhere}
        self.by_language = {
            language: {rare_start(a) for a in anchors} - self.everywhere for language, anchors in by_language.items()}

    def found(self) -> Column:
        """The anchors that occur in the file's ``folded`` text (see ``with_lines``)."""
        own = " ".join(f"WHEN language = {sql_text(language)} THEN {_search(self.everywhere | anchors)}"
                       for language, anchors in sorted(self.by_language.items()))
        search = f"CASE {own} ELSE {_search(self.everywhere)} END" if own else _search(self.everywhere)
        return F.expr(f"coalesce({search}, CAST(array() AS array<string>))")

    @staticmethod
    def any_of(texts) -> str:
        """SQL: one of the texts may occur in the file."""
        anchors = sorted({rare_start(t) for t in texts})
        if len(anchors) == 1:
            return f"array_contains(found, {sql_text(anchors[0])})"
        return f"arrays_overlap(found, {sql_array(anchors)})"

    @classmethod
    def may_match(cls, p: Prepared) -> str:
        """SQL: the pattern may match in the file."""
        tests = [cls.any_of(p.anchors)] if p.anchors else []
        for texts in p.parts:
            tests.append("(" + " OR ".join(f"contains(folded, {sql_text(t)})" for t in texts) + ")")
        return " AND ".join(tests) or "true"
