"""Coded errors of the query surface."""

from __future__ import annotations


class QueryError(ValueError):
    """An error with a code, which starts its message."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
