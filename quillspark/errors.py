"""Errors with stable numeric codes."""

from __future__ import annotations

import re


class QueryError(ValueError):
    """A query that can't be compiled; ``code`` tells why."""

    def __init__(self, code: int, message: str):
        super().__init__(f"[{code}] {message}")
        self.code = code
        self.message = message


BAD_VALUE, FAILED_TO_PARSE, TYPE_MISMATCH, CONFLICT, NOT_IMPLEMENTED, DUPLICATE_KEY = 2, 9, 14, 40, 238, 11000
NAMESPACE_NOT_FOUND, NAMESPACE_EXISTS, IMMUTABLE_FIELD, COMMAND_NOT_FOUND, WRITE_CONFLICT = 26, 48, 66, 59, 112

_CODED = re.compile(r"\[(\d{1,6})\] ([^\n]*)")


def caused(error: Exception) -> QueryError | None:
    """The coded error that a row raised while a plan ran, from Spark's report of it; None for any other failure."""
    found = _CODED.search(str(error))
    return QueryError(int(found[1]), found[2].strip()) if found else None
