"""Parsing of queries."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from quire.errors import QuireError
from quire.functions.text import NORMALIZER, fold_py, tokens_py
from quire.schema import MODES


@dataclass(frozen=True)
class ParsedQuery:
    raw: str
    mode: str
    terms: tuple[str, ...]
    hash: str

    @property
    def distinct(self) -> list[str]:
        return list(dict.fromkeys(self.terms))


def parse(raw: str, mode: str = "all_terms") -> ParsedQuery:
    if mode not in MODES:
        raise QuireError("INVALID_QUERY", f"unknown match mode {mode}", raw=raw)
    terms = tuple(tokens_py(fold_py(raw)))
    if not terms:
        raise QuireError("INVALID_QUERY", "nothing to search for is left after folding", raw=raw)
    told = json.dumps({"mode": mode, "terms": terms, "normalizer": NORMALIZER}, ensure_ascii=False)
    return ParsedQuery(raw, mode, terms, hashlib.sha256(told.encode()).hexdigest()[:16])


def to_expression(query: ParsedQuery) -> str:
    """The query in the quoted form of full-text engines; for display only."""
    quoted = ['"' + t.replace('"', '""') + '"' for t in query.terms]
    return {"phrase": " + ", "all_terms": " AND ", "any_terms": " OR "}[query.mode].join(quoted)
