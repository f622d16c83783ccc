"""Typed errors of queries, cursors and commits."""

from __future__ import annotations


class QueryError(Exception):
    """``code`` names the rule that was broken, ``path`` the place in the document."""

    def __init__(self, code: str, path: str, message: str, **more):
        super().__init__(f"{code} at {path}: {message}" if path else f"{code}: {message}")
        self.code, self.path, self.more = code, path, more


class ValidationError(QueryError):
    pass


class UnboundVariable(QueryError):
    pass


class UnknownAttribute(QueryError):
    """``more["suggestion"]`` has a near spelling, if there is one."""


class CursorError(QueryError):
    pass


class CommitError(QueryError):
    """A transaction that was not committed."""
