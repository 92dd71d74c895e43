"""Errors that the engine raises."""

from __future__ import annotations


class EngineError(Exception):
    """Base of the engine's errors."""


class UnknownEnzymeError(EngineError):
    """An enzyme's name isn't in the table."""

    def __init__(self, name: str, similar: list[str]) -> None:
        super().__init__(f"{name} is no known enzyme" + (f"; similar names: {', '.join(similar)}" if similar else ""))
        self.similar = similar


class UnknownOrientationError(EngineError):
    """An orientation is neither forward, reverse nor unknown."""


class NoneAcceptedError(EngineError):
    """No sequence passes the acceptance criteria."""


class TooFewError(EngineError):
    """An ordering needs at least three members."""


class NoRemainingClustersError(EngineError):
    """No cluster is left after filtering."""


class NoReportError(EngineError):
    """A cluster report is asked for before it is made."""


class ZeroLengthError(EngineError):
    """A sequence has no length."""


class ParseError(EngineError):
    """A file isn't in the expected format."""


class CoverageFormatError(EngineError):
    """A sequence's name or description holds no coverage."""


class UnsupportedError(EngineError):
    """Something that the engine doesn't offer on purpose."""
