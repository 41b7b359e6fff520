"""Exceptions of the library."""

from __future__ import annotations


class RuleSieveError(Exception):
    """Base of all errors raised here."""


class InputError(RuleSieveError):
    """A file is missing, unreadable, of unknown format or empty."""


class RuleError(RuleSieveError):
    """A rule is invalid; carries where it stands."""

    def __init__(self, message: str, rule_name: str = "", file: str = "", entry: int = 0):
        super().__init__(message)
        self.rule_name, self.file, self.entry = rule_name, file, entry


class SampleError(RuleSieveError):
    """Too few strings could be generated for a rule."""

    def __init__(self, message: str, rule_name: str = ""):
        super().__init__(message)
        self.rule_name = rule_name
