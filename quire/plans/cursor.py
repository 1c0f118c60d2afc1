"""Opaque cursors, bound to what they were issued for."""

from __future__ import annotations

import base64
import hashlib
import json
import math

from quire.errors import QuireError
from quire.functions.text import NORMALIZER

VERSION = 1


def _pack(payload: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(payload, separators=(",", ":")).encode()).decode().rstrip("=")


def _unpack(raw: str) -> dict:
    try:
        payload = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)))
    except ValueError as e:
        raise QuireError("CURSOR_INVALID", "the cursor can't be decoded; start again without one") from e
    if not isinstance(payload, dict):
        raise QuireError("CURSOR_INVALID", "the cursor has another shape")
    return payload


def fingerprint(generation: str, docs: int, scope: list) -> str:
    """Identity of an index and a scope: 24 hexadecimal digits. scope: what tells the scope's books, however many, in a few values."""
    told = json.dumps({"engine": "quire", "normalizer": NORMALIZER, "docs": docs, "generation": generation, "scope": scope})
    return hashlib.sha256(told.encode()).hexdigest()[:24]


def encode(kind: str, fp: str, qh: str, score: float, doc: int, delivered: int, total: int) -> str:
    return _pack({"v": VERSION, "k": kind, "fp": fp, "qh": qh, "after": {"score": score, "doc": doc}, "delivered": delivered, "total": total})


def decode(raw: str, kind: str, fp: str, qh: str) -> dict:
    """The payload. Checked in this order: decodable, shape and kind, version, fingerprint, query."""
    p = _unpack(raw)
    after = p.get("after")
    numbers = isinstance(after, dict) and all(isinstance(after.get(k), int | float) and math.isfinite(after[k]) for k in ("score", "doc"))
    if not numbers or p.get("k") != kind or not isinstance(p.get("delivered"), int) or not isinstance(p.get("total"), int):
        raise QuireError("CURSOR_INVALID", "the cursor has another shape or belongs to another call")
    for key, want, what in (("v", VERSION, "version"), ("fp", fp, "index or scope"), ("qh", qh, "query")):
        if p.get(key) != want:
            raise QuireError("CURSOR_STALE", f"the cursor was issued for another {what}; start again without one")
    return p


def encode_ordinal(kind: str, request: object, at: int) -> str:
    """A position in a list, bound to the request it belongs to."""
    return _pack({"v": VERSION, "k": kind, "rq": request_hash(request), "at": at})


def decode_ordinal(raw: str | None, kind: str, request: object) -> int:
    if raw is None:
        return 0
    p = _unpack(raw)
    if p.get("v") != VERSION or p.get("k") != kind or type(p.get("at")) is not int or p["at"] < 0:
        raise QuireError("CURSOR_INVALID", "the cursor isn't one of this list")
    if p.get("rq") != request_hash(request):
        raise QuireError("CURSOR_STALE", "the cursor was issued for another request")
    return p["at"]


def request_hash(request: object) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()[:16]
