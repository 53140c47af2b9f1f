"""Names of entities and hashes of texts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "(?U)\\s+"


def name_of(text: str | None) -> str | None:
    """Trimmed, without one pair of quotes around it and without final .,;: - white space single, NFKC, lower case."""
    if text is None:
        return None
    text = text.strip()
    if len(text) >= 2 and (text[0], text[-1]) in (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("`", "`")):
        text = text[1:-1]
    text = text.rstrip(".,;:")
    return unicodedata.normalize("NFKC", " ".join(text.split())).lower()


@F.pandas_udf(T.StringType())
def normalized_name(names: pd.Series) -> pd.Series:
    """name_of for a column; NFKC has no built-in form."""
    return names.map(name_of)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of a text with its white space collapsed."""
    return F.sha2(collapsed(text), 256)


def edits_allowed(shorter: int) -> int:
    return 0 if shorter <= 4 else 1 if shorter <= 8 else 2


def within(a: str, b: str, most: int) -> bool:
    """Whether a becomes b in at most so many edits."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def _initials(a: list[str], b: list[str]) -> bool:
    if len(a) != len(b):
        return False
    whole = 0
    for x, y in zip(a, b, strict=True):
        x, y = x.rstrip("."), y.rstrip(".")
        if x == y and len(x) > 1:
            whole += 1
        elif x != y and not (x and y and (len(x) == 1 or len(y) == 1) and x[0] == y[0]):
            return False
    return whole > 0


def _acronym(a: list[str], b: list[str]) -> bool:
    if len(a) != 1 or len(b) < 2:
        return False
    letters = re.sub("[^\\w]", "", a[0])
    return len(letters) >= 2 and letters == "".join(t[0] for t in b)


def _contains(a: list[str], b: list[str]) -> bool:
    short, long = sorted((a, b), key=len)
    return len(short) >= 2 and len(long) > len(short) and any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))


def alike(a: str, b: str) -> bool:
    """Whether two normalised names may be one: equal, initials, acronym, few edits, or one within the other."""
    if not a or not b:
        return False
    if a == b:
        return True
    x, y = a.split(), b.split()
    if _initials(x, y) or _acronym(x, y) or _acronym(y, x):
        return True
    return within(a, b, edits_allowed(min(len(a), len(b)))) or _contains(x, y)


def block_keys(name: str | None, probe: bool) -> list[str]:
    """Keys of which two names that are alike share one, if one name's are made with probe and the other's without.

    One for each rule: a whole token at its place among as many tokens, the letters of an acronym, a part of the name that few edits leave
    whole (a name cut into one part more than edits are allowed), two tokens that follow each other.
    """
    if not name:
        return []
    tokens, size = name.split(), len(name)
    keys = {f"i{len(tokens)}/{k}/{t.rstrip('.')}" for k, t in enumerate(tokens) if len(t.rstrip(".")) > 1}
    keys.add("a" + (re.sub("[^\\w]", "", tokens[0]) if len(tokens) == 1 else "".join(t[0] for t in tokens)))
    keys |= {f"c{a} {b}" for a, b in zip(tokens[:-1], tokens[1:], strict=True)}
    keys.add("=" + name)
    for other in range(max(size - 2, 1), size + 3):
        most = edits_allowed(min(size, other))
        if not most or abs(size - other) > most:
            continue
        length = other if probe else size  # of the name that is cut
        cuts = [k * length // (most + 1) for k in range(most + 2)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            for shift in range(-most, most + 1) if probe else (0,):
                if a + shift >= 0 and b + shift <= size:
                    keys.add(f"s{most}/{length}/{k}/{name[a + shift : b + shift]}")
    return sorted(keys)


@F.pandas_udf(T.ArrayType(T.StringType()))
def keys_of(names: pd.Series) -> pd.Series:
    return names.map(lambda x: block_keys(x, False))


@F.pandas_udf(T.ArrayType(T.StringType()))
def probes_of(names: pd.Series) -> pd.Series:
    return names.map(lambda x: block_keys(x, True))


@F.pandas_udf(T.BooleanType())
def names_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bool(x) and bool(y) and alike(x, y) for x, y in zip(a, b, strict=True)])


def few_edits(a: Column, b: Column) -> Column:
    """The rule of few edits as an expression."""
    n = F.least(F.length(a), F.length(b))
    most = F.when(n <= 4, 0).when(n <= 8, 1).otherwise(2)
    return F.levenshtein(a, b) <= most
