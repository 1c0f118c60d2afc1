"""Typed errors: a stable code, a message, and details."""

from __future__ import annotations

CODES = (
    "LIBRARY_DIR_MISSING", "LIBRARY_DIR_UNREADABLE", "CATALOGUE_MISSING", "SCHEMA_UNRECOGNISED", "BOOK_NOT_FOUND", "BOOK_NOT_DOWNLOADED", "BOOK_UNREADABLE", "INDEX_MISSING", "INDEX_STALE",
    "CURSOR_INVALID", "CURSOR_STALE", "UNSAFE_OUTPUT_PATH", "WRITE_INTO_LIBRARY", "ENGINE_UNAVAILABLE", "INVALID_QUERY", "OVERRIDES_INVALID", "CHECKPOINT_MISMATCH", "EXPORT_INCOMPLETE",
)


class QuireError(Exception):
    def __init__(self, code: str, message: str, **details):
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details

    def payload(self) -> dict:
        return {"ok": False, "error": {"code": self.code, "message": self.message, "details": self.details}}


def guarded(f, *args, **kwargs) -> dict:
    """The result of a tool, or its error as a payload. An untyped failure counts as an unrecognised schema."""
    try:
        return {"ok": True, **f(*args, **kwargs)}
    except QuireError as e:
        return e.payload()
    except Exception as e:
        return QuireError("SCHEMA_UNRECOGNISED", f"unexpected failure: {e}", kind=type(e).__name__).payload()
