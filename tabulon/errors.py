"""Errors that statements raise, and the codes that services report them under."""

from __future__ import annotations

#: The error codes that clients of the service layer know.
AUTH_FAILED = "AUTH_FAILED"
AUTH_REQUIRED = "AUTH_REQUIRED"
INVALID_REQUEST = "INVALID_REQUEST"
QUERY_ERROR = "QUERY_ERROR"
NOT_FOUND = "NOT_FOUND"
NOT_LEADER = "NOT_LEADER"
TIMEOUT = "TIMEOUT"
UNSUPPORTED = "UNSUPPORTED"
INTERNAL_ERROR = "INTERNAL_ERROR"
PROTOCOL_ERROR = "PROTOCOL_ERROR"
SERVER_BUSY = "SERVER_BUSY"
RESULT_TOO_LARGE = "RESULT_TOO_LARGE"


class SqlError(Exception):
    """A statement that cannot be run."""

    code = QUERY_ERROR

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        if code is not None:
            self.code = code
        elif message.startswith("table not found"):
            self.code = NOT_FOUND
        elif message.startswith("unsupported"):
            self.code = UNSUPPORTED


class RowLimitError(SqlError):
    code = RESULT_TOO_LARGE


class BusyError(SqlError):
    code = SERVER_BUSY


class StatementTimeout(SqlError):
    code = TIMEOUT
