"""Strings from a regular expression: a random walk over its syntax tree.

Repeats are capped at ``CAP`` unless their minimum is larger, lazy repeats take their minimum, and
assertions are left to the check that the string matches. A sampler is deterministic for its seed.
"""

from __future__ import annotations

import random
import string
from re import _constants as sre

from rulesieve.functions.patterns import _REPEATS, parsed

CAP = 100
PRINTABLE = string.ascii_letters + string.digits + string.punctuation + " "
CLASSES = {
    sre.CATEGORY_DIGIT: string.digits,
    sre.CATEGORY_SPACE: " \t",
    sre.CATEGORY_WORD: string.ascii_letters + string.digits + "_",
}
OPPOSITE = {sre.CATEGORY_NOT_DIGIT: sre.CATEGORY_DIGIT, sre.CATEGORY_NOT_SPACE: sre.CATEGORY_SPACE, sre.CATEGORY_NOT_WORD: sre.CATEGORY_WORD}


class Sampler:
    def __init__(self, pattern: str, rng: random.Random):
        self.tree, self.rng = parsed(pattern), rng

    def one(self) -> str:
        self.groups: dict[int, str] = {}
        return self._walk(self.tree)

    def _walk(self, sub) -> str:
        return "".join(self._emit(op, arg) for op, arg in sub)

    def _emit(self, op, arg) -> str:
        rng = self.rng
        if op is sre.LITERAL:
            return chr(arg)
        if op is sre.NOT_LITERAL:
            return rng.choice(PRINTABLE.replace(chr(arg), "") or " ")
        if op is sre.ANY:
            return rng.choice(PRINTABLE)
        if op is sre.IN:
            return self._class(arg)
        if op is sre.BRANCH:
            return self._walk(rng.choice(arg[1]))
        if op is sre.SUBPATTERN:
            text = self._walk(arg[3])
            if arg[0] is not None:
                self.groups[arg[0]] = text
            return text
        if op in _REPEATS:
            low, high, inner = arg
            lazy = op is sre.MIN_REPEAT
            times = low if lazy else rng.randint(low, max(low, min(int(high), CAP)))
            return "".join(self._walk(inner) for _ in range(times))
        if op is sre.GROUPREF:
            return self.groups.get(arg, "")
        if op is sre.GROUPREF_EXISTS:
            number, yes, no = arg
            return self._walk(yes) if number in self.groups else self._walk(no) if no else ""
        if op is getattr(sre, "ATOMIC_GROUP", None):
            return self._walk(arg)
        if op is sre.ASSERT:  # what a look-ahead wants may as well stand there; the check decides
            return self._walk(arg[1]) if arg[0] > 0 and rng.random() < 0.3 else ""
        return ""  # anchors and negative assertions

    def _class(self, items) -> str:
        negated = bool(items) and items[0][0] is sre.NEGATE
        told: list[str] = []
        for op, arg in items[negated:]:
            if op is sre.LITERAL:
                told.append(chr(arg))
            elif op is sre.RANGE:
                told.append("".join(map(chr, range(arg[0], min(arg[1], arg[0] + 500) + 1))))
            elif op is sre.CATEGORY:
                told.append(CLASSES[arg] if arg in CLASSES else "".join(c for c in PRINTABLE if c not in CLASSES[OPPOSITE[arg]]))
        if negated:
            out = set("".join(told))
            return self.rng.choice([c for c in PRINTABLE if c not in out] or ["é"])
        return self.rng.choice(self.rng.choice(told))


class NearMiss(Sampler):
    """Strings that keep to the pattern but for one place, where its syntax tree is not obeyed.

    A literal becomes another character, a class gives one from outside, a repeat falls one short of
    its least count, an anchor gets something beyond it. Whether the result still matches by other
    ways is for the caller to check.
    """

    def one(self) -> str:
        self.place, self.target = 0, -1
        whole = super().one()  # counts the places of one walk
        self.place, self.target = 0, self.rng.randrange(self.place) if self.place else -1
        return super().one() if self.target >= 0 else whole

    def _emit(self, op, arg) -> str:
        if op in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY, sre.AT) or (op in _REPEATS and arg[0] > 0):
            self.place += 1
            if self.place - 1 == self.target:
                return self._broken(op, arg)
        return super()._emit(op, arg)

    def _broken(self, op, arg) -> str:
        if op is sre.LITERAL:
            return self.rng.choice(PRINTABLE.replace(chr(arg), ""))
        if op is sre.NOT_LITERAL:
            return chr(arg)
        if op is sre.ANY:
            return "\n"
        if op is sre.IN:
            inside = arg[1:] if arg and arg[0][0] is sre.NEGATE else [(sre.NEGATE, None), *arg]
            return self._class(inside)
        if op is sre.AT:
            return self.rng.choice(string.ascii_letters)
        return "".join(self._walk(arg[2]) for _ in range(arg[0] - 1))
