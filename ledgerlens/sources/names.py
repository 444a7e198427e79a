"""Header normalisation: any header text to unique snake_case names."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame

# Symbol words and letters without a decomposition, so that
# cleaned names match the usual snake_case convention of tidy tooling.
SYMBOL_WORDS = {"%": " percent ", "#": " number ", "&": " and ", "@": " at "}
SPECIAL_LETTERS = {"ß": "ss", "Æ": "AE", "æ": "ae", "Ø": "O", "ø": "o", "Œ": "OE", "œ": "oe", "Ł": "L", "ł": "l"}


def snake_name(name: str) -> str:
    """One header to snake_case ASCII (duplicates are handled by ``clean_names``)."""
    s = name
    for sym, word in SYMBOL_WORDS.items():
        s = s.replace(sym, word)
    s = "".join(SPECIAL_LETTERS.get(ch, ch) for ch in s)
    s = unicodedata.normalize("NFKD", s)
    s = "".join(ch for ch in s if not unicodedata.combining(ch))
    s = s.encode("ascii", "ignore").decode("ascii")
    # camelCase and ACRONYMWord boundaries become separators
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_name_list(names: list[str]) -> list[str]:
    """Snake-case every name; later duplicates get ``_2``, ``_3`` ..."""
    out: list[str] = []
    seen: dict[str, int] = {}
    taken = set()
    for n in names:
        base = snake_name(n)
        cand = base
        if cand in taken:
            k = seen.get(base, 1)
            while cand in taken:
                k += 1
                cand = f"{base}_{k}"
            seen[base] = k
        taken.add(cand)
        out.append(cand)
    return out


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns of ``df`` at once (a single projection, no data pass)."""
    return df.toDF(*clean_name_list(df.columns))
