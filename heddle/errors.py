"""Errors of the engine, each with a code and advice."""

from __future__ import annotations


class EngineError(Exception):
    """Something the engine can't do. ``code`` tells the kind, ``advice`` what may help, ``retryable`` whether time may."""

    code, retryable = "XX000", False

    def __init__(self, message: str, advice: str = ""):
        super().__init__(message)
        self.advice = advice


class StatementError(EngineError):
    code = "42601"


class MissingError(EngineError):
    code = "42P01"


class DuplicateError(EngineError):
    code = "42P07"


class DependencyError(EngineError):
    code = "2BP01"


class ConstraintError(EngineError):
    code = "23000"


class NotNullError(ConstraintError):
    code = "23502"


class ForeignKeyError(ConstraintError):
    code = "23503"


class UniqueError(ConstraintError):
    code = "23505"


class CheckError(ConstraintError):
    code = "23514"


class TransactionError(EngineError):
    code = "25000"


class RaisedError(EngineError):
    code = "P0001"
