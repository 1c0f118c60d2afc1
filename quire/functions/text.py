"""Text functions: folding, tokens, HTML to text, entities, excerpts. Columns for Spark, and plain Python for queries.

All of it stays in the JVM but NFC, which Spark lacks: needs_nfc() finds out whether a corpus has any text that NFC could
change, and only then fold() adds an Arrow function.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The classes and folds of the search form.
ZERO_WIDTH = "\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff"
MARKS = "\u064b-\u065f\u0670\u06d6-\u06ed"
TATWEEL = "\u0640"
FOLD_FROM = "\u0622\u0623\u0625\u0671\u0649\u06cc\u0624\u0629\u06af\u06a9\u067e\u0686"
FOLD_TO = "\u0627\u0627\u0627\u0627\u064a\u064a\u0648\u0647\u0643\u0643\u0628\u062c"
DIGITS_FROM, DIGITS_TO = "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669\u06f0\u06f1\u06f2\u06f3\u06f4\u06f5\u06f6\u06f7\u06f8\u06f9", "01234567890123456789"
SPACES = "\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
IBN, BN = "\u0627\u0628\u0646", "\u0628\u0646"
#: The named entities that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "laquo": "«", "raquo": "»", "ldquo": "“", "rdquo": "”", "hellip": "…", "mdash": "—", "ndash": "–"}
BLOCK = r"</?(?:p|div|br|tr|li|h[1-6]|blockquote|hr|table|section)\b[^>]*>"
NORMALIZER = "quire-fold-1"
#: Characters of folded texts that leave Python at once with their maps, beside the last text's.
MAP_CHARS = 1 << 18
BATCH_BYTES = "1m"

_DROP = f"[{ZERO_WIDTH}{MARKS}{TATWEEL}]+"
_TOKEN = r"[\p{L}\p{N}]+"
_PY_DROP, _PY_SPACE = re.compile(_DROP), re.compile(f"[{SPACES}]+")
_PY_MAP = str.maketrans(FOLD_FROM + DIGITS_FROM, FOLD_TO + DIGITS_TO)


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def needs_nfc(df: DataFrame, column: str) -> bool:
    """Whether any text has a character from U+0300 on; below it NFC changes nothing."""
    return not df.where(F.col(column).rlike("[^\u0000-\u02ff]")).isEmpty()


def fold(text: Column, nfc: bool = True) -> Column:
    """The search form: NFC, no zero-width characters, marks or tatweel, letters and digits folded, white space collapsed."""
    if nfc:
        text = F.pandas_udf(_nfc, "string")(text)
    text = F.translate(F.regexp_replace(text, _DROP, ""), FOLD_FROM + DIGITS_FROM, FOLD_TO + DIGITS_TO)
    return F.regexp_replace(F.regexp_replace(text, f"[{SPACES}]+", " "), "^ | $", "")


def tokens(folded: Column) -> Column:
    """Maximal runs of letters and numbers, one of them shortened."""
    found = F.regexp_extract_all(folded, F.lit(f"({_TOKEN})"), F.lit(0))
    return F.transform(found, lambda t: F.when(t == IBN, BN).otherwise(t))


def fold_py(text: str | None) -> str:
    text = unicodedata.normalize("NFC", text or "")
    return _PY_SPACE.sub(" ", _PY_DROP.sub("", text).translate(_PY_MAP)).strip(" ")


def tokens_py(folded: str) -> list[str]:
    import regex

    return [BN if t == IBN else t for t in regex.findall(_TOKEN, folded)]


@functools.cache
def _by_code() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it stays (0), is dropped (1) or is white space (2), and what it folds to."""
    kind, to = np.zeros(sys.maxunicode + 1, np.int8), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for code, c in enumerate(map(chr, range(1 << 16))):  # the classes have none beyond
        kind[code] = 1 if _PY_DROP.fullmatch(c) else 2 if _PY_SPACE.fullmatch(c) else 0
    to[list(_PY_MAP)] = list(_PY_MAP.values())
    return kind, to


def _fold_map(text: str | None) -> tuple[str, np.ndarray]:
    kind, to = _by_code()
    codes = np.frombuffer(unicodedata.normalize("NFC", text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    left = np.flatnonzero(kind[codes] != 1)
    space = kind[codes[left]] == 2
    gap = np.append(False, space[:-1])[~space] if len(space) else space
    gap[:1] = False  # no space in front of all
    at = np.repeat(left[~space].astype(np.int32), 1 + gap)
    out = to[codes[at]]
    out[np.cumsum(1 + gap)[gap] - 2] = ord(" ")
    return out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), at


def fold_map_py(text: str | None) -> tuple[str, list[int]]:
    """The folded text and, for each of its characters, its index in the NFC source; a collapsed space maps to the next kept one."""
    folded, at = _fold_map(text)
    return folded, at.tolist()


def _mapped(found: list[tuple[str, np.ndarray]]) -> pa.Array:
    ends = np.cumsum([0] + [len(at) for _, at in found])
    at = pa.ListArray.from_arrays(pa.array(ends, "int32"), pa.array(np.concatenate([at for _, at in found]), "int32"))
    return pa.StructArray.from_arrays([pa.array([f for f, _ in found], "string"), at], ["folded", "source_at"])


def fold_maps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """fold_map_py over batches of texts. The maps are larger than the texts, so they go out by MAP_CHARS characters (or one text),
    however many texts come at once.
    """
    for texts in batches:
        found, size = [], 0
        for t in texts:
            found.append(_fold_map(t.as_py()))
            size += len(found[-1][1])
            if size >= MAP_CHARS:
                yield _mapped(found)
                found, size = [], 0
        if found:
            yield _mapped(found)


def modest_batches(spark: SparkSession) -> None:
    """Keeps what goes to Python at once to BATCH_BYTES of texts (or one text), unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "67108864b"):  # the default
        spark.conf.set(key, BATCH_BYTES)


def fold_map(text: Column) -> Column:
    return F.arrow_udf(fold_maps, "folded string, source_at array<int>")(text)


def html_to_text(html: Column) -> Column:
    """Readable text of light markup: block tags become line breaks, other tags vanish, entities are decoded."""
    t = F.coalesce(html, F.lit(""))
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    t = decode_entities(F.regexp_replace(F.regexp_replace(t, "(?i)" + BLOCK, "\n"), "<[^>]*>", ""))
    t = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), "[ \t\xa0]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, " *\n *", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(t, f"^[{SPACES}]+|[{SPACES}]+$", "")


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal references, in one pass: what a reference yields isn't read again."""
    named = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    form = r"(?s)^&(#x?[0-9a-fA-F]+|[a-zA-Z]+);"

    def part(p: Column) -> Column:
        body = F.regexp_extract(p, form, 1)
        number = F.when(body.startswith("#x"), F.conv(F.substring(body, 3, 16), 16, 10)).otherwise(F.regexp_extract(body, "^#([0-9]+)", 1))
        code = number.try_cast("long")
        usable = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        one = F.when(body.startswith("#"), F.when(usable, char)).otherwise(F.try_element_at(named, F.lower(body)))
        return F.when((body != "") & one.isNotNull(), F.concat(one, F.regexp_replace(p, form, ""))).otherwise(p)

    return F.array_join(F.transform(F.split(text, "(?=&)"), part), "")


def excerpt(text: Column, at: Column, radius: int) -> Column:
    """text around an offset, widened to white space, with an ellipsis on each side that was cut."""
    size = F.length(text)
    start, end = F.greatest(F.lit(0), at - radius), F.least(size, at + radius)
    # \z, since Java's $ matches in front of a line break at the end too
    left = start - F.length(F.regexp_extract(F.substring(text, F.lit(1), start), rf"(?s)^(?:.*[{SPACES}])?([^{SPACES}]*)\z", 1))
    right = end + F.length(F.regexp_extract(F.substring(text, end + 1, size), f"^[^{SPACES}]*", 0))
    middle = F.regexp_replace(F.substring(text, left + 1, right - left), rf"^[{SPACES}]+|[{SPACES}]+\z", "")
    cut = F.concat(F.when(left > 0, "… ").otherwise(""), middle, F.when(right < size, " …").otherwise(""))
    return F.when(size <= 2 * radius, text).otherwise(cut)


def first_match_offset(folded: Column, terms: list[str], mode: str) -> Column:
    """Offset of the joined terms (phrase) or else of the earliest term, as substrings; -1 if none."""
    places = F.array(*(F.locate(t, folded) - 1 for t in terms))
    least = F.coalesce(F.array_min(F.filter(places, lambda x: x >= 0)), F.lit(-1))
    if mode != "phrase":
        return least
    joined = F.locate(" ".join(terms), folded) - 1
    return F.when(joined >= 0, joined).otherwise(least)


def match_reason(folded: Column, raw: str, terms: list[str], mode: str) -> Column:
    """Why a page matched, from the terms found in its own text."""
    if mode == "phrase":
        return F.when(folded.contains(" ".join(terms)), f"phrase «{raw.strip()}» occurs in order on the page").otherwise("the index matched the phrase; its order isn't confirmed in the readable text")
    # one condition a term, and no lambda, so that the folded text may come from an Arrow function
    there = F.array_compact(F.array(*(F.when(folded.contains(t), t) for t in terms)))
    gone = F.array_compact(F.array(*(F.when(~folded.contains(t), t) for t in terms)))
    found, missing, count = F.array_join(there, ", "), F.array_join(gone, ", "), F.size(there).cast("string")
    if mode == "all_terms":
        return F.concat(F.lit("all terms on the page ("), count, F.lit(f"/{len(terms)}): "), found)
    return F.when(missing == "", F.concat(F.lit("every term found: "), found)).otherwise(F.concat(F.lit("found: "), found, F.lit(" - missing: "), missing))
