"""Regular expressions: validity, complexity, literals every match contains, and the JVM dialect.

Python's ``re`` decides what a pattern means. ``required_literal`` feeds the prefilter of the match
operator; ``to_jvm`` rewrites a pattern for ``rlike`` where the rewriting is exact, else gives None.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as sre
from re import _parser

_QUIET = {"action": "ignore"}
_REPEATS = tuple(getattr(sre, n) for n in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") if hasattr(sre, n))


def compiled(pattern: str) -> re.Pattern:
    with warnings.catch_warnings():
        warnings.simplefilter(**_QUIET)
        return re.compile(pattern)


def parsed(pattern: str):
    with warnings.catch_warnings():
        warnings.simplefilter(**_QUIET)
        return _parser.parse(pattern)


def complexity(pattern: str) -> int:
    """Nodes of the syntax tree; a character class is one node; 0 where the pattern doesn't parse."""
    try:
        tree = parsed(pattern)
    except (re.error, RecursionError, OverflowError):
        return 0

    def below(item) -> int:
        if isinstance(item, _parser.SubPattern):
            return sum(map(node, item))
        if isinstance(item, (tuple, list)):
            return sum(below(x) for x in item)
        return 0

    def node(entry) -> int:
        op, arg = entry
        return 1 if op is sre.IN else 1 + below(arg)

    return sum(map(node, tree))


def required_literals(pattern: str) -> tuple[frozenset[str], bool]:
    """(lower-cased ASCII literals of which every match contains one, empty where there are none; whether case is ignored).

    The longest run of literals that cannot be left out, or a choice all of whose branches have one,
    whichever has the longer shortest literal.
    """
    tree = parsed(pattern)
    ignore = bool(tree.state.flags & re.IGNORECASE)
    changed = False  # flags within the pattern: what is found holds only if they don't concern case

    def best(sub) -> frozenset[str]:
        nonlocal changed
        choices: list[frozenset[str]] = []
        runs = [""]

        def walk(sub) -> None:
            nonlocal changed
            for op, arg in sub:
                if op is sre.LITERAL and arg < 128:
                    runs[-1] += chr(arg).lower()
                elif op is sre.SUBPATTERN:
                    changed |= bool((arg[1] | arg[2]) & re.IGNORECASE)
                    walk(arg[3])
                elif op is sre.AT:
                    continue
                else:
                    runs.append("")
                    if op in _REPEATS and arg[0] >= 1:
                        walk(arg[2])
                    elif op is sre.BRANCH:
                        inner = [best(x) for x in arg[1]]
                        if all(inner):
                            choices.append(frozenset().union(*inner))
                    elif op is getattr(sre, "ATOMIC_GROUP", None):
                        walk(arg)
                    runs.append("")

        walk(sub)
        longest = max(runs, key=len)
        options = choices + ([frozenset({longest})] if longest else [])
        return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=frozenset())

    found = best(tree)
    return (frozenset(), ignore) if changed else (found, ignore)


#: White space as Python sees it, and ASCII's (fixed values).
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII_SPACE = r"\t-\r\x20"
#: Characters beyond ASCII that a case-blind pattern may take for an ASCII letter (fixed value).
_EXTRA = "\u0130\u0131\u017f\u212a"
_MOST_REPEATS = 1000


class _NoCounterpart(Exception):
    pass


def _char(code: int) -> str:
    if 0xD800 <= code <= 0xDFFF:
        raise _NoCounterpart
    c = chr(code)
    return c if c.isascii() and c.isalnum() else rf"\x{{{code:x}}}"


def _category(name, ascii_only: bool) -> str:
    """Items of a JVM class for a category of Python's."""
    space, digit, word = (_ASCII_SPACE, "0-9", "a-zA-Z0-9_") if ascii_only else (_SPACE, r"\p{Nd}", r"\p{L}\p{N}_")
    items = {sre.CATEGORY_SPACE: space, sre.CATEGORY_DIGIT: digit, sre.CATEGORY_WORD: word}
    against = {sre.CATEGORY_NOT_SPACE: space, sre.CATEGORY_NOT_DIGIT: digit, sre.CATEGORY_NOT_WORD: word}
    if name in items:
        return items[name]
    if name in against:
        return f"[^{against[name]}]"
    raise _NoCounterpart


def _blind(test: str) -> str:
    """Items of a JVM class for what the one-character Python pattern ``test`` takes when case is ignored; ASCII and what folds to it."""
    one = re.compile(test, re.IGNORECASE)
    return "".join(_char(ord(c)) for c in [*map(chr, range(128)), *_EXTRA] if one.fullmatch(c))


def _class(items, flags: int) -> str:
    negated = bool(items) and items[0][0] is sre.NEGATE
    out = []
    for op, arg in items[negated:]:
        if op is sre.CATEGORY:
            out.append(_category(arg, bool(flags & re.ASCII)))
        elif op in (sre.LITERAL, sre.RANGE):
            lo, hi = (arg, arg) if op is sre.LITERAL else arg
            if flags & re.IGNORECASE:
                if hi > 127 or flags & re.ASCII:
                    raise _NoCounterpart
                out.append(_blind(f"[{re.escape(chr(lo))}-{re.escape(chr(hi))}]"))
            else:
                out.append(_char(lo) if lo == hi else f"{_char(lo)}-{_char(hi)}")
        else:
            raise _NoCounterpart
    return f"[{'^' if negated else ''}{''.join(out)}]"


def _jvm(sub, flags: int, depth: int = 0) -> str:
    out = []
    for op, arg in sub:
        if op is sre.LITERAL:
            out.append(_class([(sre.LITERAL, arg)], flags) if flags & re.IGNORECASE and chr(arg).lower() != chr(arg).upper() else _char(arg))
        elif op is sre.NOT_LITERAL:
            out.append(_class([(sre.NEGATE, None), (sre.LITERAL, arg)], flags))
        elif op is sre.IN:
            out.append(_class(arg, flags))
        elif op is sre.ANY:
            out.append(r"[\x{0}-\x{10ffff}]" if flags & re.DOTALL else r"[^\n]")
        elif op is sre.BRANCH:
            out.append("(?:" + "|".join(_jvm(x, flags, depth + 1) for x in arg[1]) + ")")
        elif op is sre.SUBPATTERN:
            group, add, drop, inner = arg
            out.append(("(" if group is not None else "(?:") + _jvm(inner, (flags | add) & ~drop, depth + 1) + ")")
        elif op in _REPEATS:
            low, high, inner = arg
            # the JVM walks a repeated group by recursion: long ones would exhaust its stack
            if len(inner) != 1 or inner[0][0] not in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY):
                if high is sre.MAXREPEAT or int(high) > _MOST_REPEATS:
                    raise _NoCounterpart
            bound = "{%d,}" % low if high is sre.MAXREPEAT else "{%d,%d}" % (low, high)
            kind = {"MIN_REPEAT": "?", "POSSESSIVE_REPEAT": "+"}.get(str(op), "")
            out.append(f"(?:{_jvm(inner, flags, depth + 1)}){bound}{kind}")
        elif op is sre.GROUPREF and not flags & re.IGNORECASE:
            out.append(rf"(?:\{arg})")
        elif op in (sre.ASSERT, sre.ASSERT_NOT):
            sign = ("=" if op is sre.ASSERT else "!") if arg[0] > 0 else ("<=" if op is sre.ASSERT else "<!")
            out.append(f"(?{sign}{_jvm(arg[1], flags, depth + 1)})")
        elif op is getattr(sre, "ATOMIC_GROUP", None):
            out.append(f"(?>{_jvm(arg, flags, depth + 1)})")
        elif op is sre.AT:
            word = f"[{_category(sre.CATEGORY_WORD, bool(flags & re.ASCII))}]"
            at = {
                sre.AT_BEGINNING: r"(?:\A|(?<=\n))" if flags & re.MULTILINE else r"\A",
                sre.AT_BEGINNING_STRING: r"\A",
                sre.AT_END: r"(?=\n|\z)" if flags & re.MULTILINE else r"(?=\n?\z)",
                sre.AT_END_STRING: r"\z",
                sre.AT_BOUNDARY: f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))",
            }.get(arg)
            if at is None:
                raise _NoCounterpart
            out.append(at)
        else:
            raise _NoCounterpart
    return "".join(out)


def to_jvm(pattern: str) -> str | None:
    """An equivalent pattern for java.util.regex without flags, or None.

    Written anew from Python's syntax tree over a list of node types: characters by number, categories
    and boundaries spelled out, case-blind ASCII as classes. Conditionals, case-blind characters
    beyond ASCII, back references that ignore case, the opposite of a boundary, and groups repeated
    without a small bound have no counterpart. Letters of a Unicode version newer than the JVM's are
    the one difference left.
    """
    try:
        tree = parsed(pattern)
        compiled(pattern)
        if tree.state.flags & re.LOCALE:
            return None
        return _jvm(tree, tree.state.flags)
    except (re.error, RecursionError, OverflowError, _NoCounterpart):
        return None
