"""Loops of speech models: where a character or a few are said over and over, found by comparing a text with itself, shifted.

Separators left out, a unit of p characters that stands four times makes 3p places in a row that equal the place p further on.
So twenty shifts over the characters' codes, whatever the texts, leave the few places where a pattern with
back-references can match at all, and it is tried only there.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators of loops, and how often a unit of one character, or of 2-20, must be repeated.
SEPARATORS = r"[、，,。\s]*"
SINGLE = re.compile(rf"([^\s、，,。])({SEPARATORS}\1)(?:{SEPARATORS}\1){{6,}}")
MULTI = re.compile(rf"(\S{{2,20}}?)({SEPARATORS}\1)(?:{SEPARATORS}\1){{2,}}")
LONGEST, COPIES, SINGLE_COPIES = 20, 4, 8
#: Characters that are looked at together.
STEP = 1 << 20
#: Stands between texts that are looked at together.
BETWEEN = "\U0010ffff"
_tables: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """0, or 1 for white space, or 2 for other separators, of each character."""
    if not _tables:
        table = np.zeros(0x110000, np.uint8)
        table[[c for c in range(0x3001) if chr(c).isspace()]] = 1
        table[[ord(c) for c in "、，,。"]] = 2
        _tables.append(table)
    return _tables[0]


def _runs(same: np.ndarray, length: int) -> np.ndarray:
    """Where ``length`` trues in a row begin."""
    if len(same) < length:
        return np.zeros(0, np.int64)
    have = 1
    while have < length:
        step = min(have, length - have)
        same = same[: len(same) - step] & same[step:]
        have += step
    return np.flatnonzero(same)


def _places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where a loop of one character, and of several, can begin."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[codes]
    at = np.flatnonzero(kind == 0)
    bare = codes[at]
    single, several = np.zeros(0, np.int64), [np.zeros(0, np.int64)]
    for p in range(1, LONGEST + 1):
        same = bare[:-p] == bare[p:]
        runs = _runs(same, (COPIES - 1) * p)
        several.append(runs)
        if p == 1 and len(runs):
            single = at[_runs(same, SINGLE_COPIES - 1)]
    first = np.unique(np.concatenate(several))
    # A unit may begin with separators that stand before; those that aren't white space.
    before = np.where(first > 0, at[first - 1] + 1, 0) if len(first) else first
    found = [np.arange(max(a, b - LONGEST), b + 1) for a, b in zip(before.tolist(), at[first].tolist(), strict=True)]
    # Units of separators alone.
    dense = np.flatnonzero(kind != 1)
    found.append(dense[_runs(kind[dense] == 2, 2 * COPIES)])
    return single, np.unique(np.concatenate(found))


def _collapse(pattern: re.Pattern, text: str, places: list[int]) -> tuple[str, int]:
    parts, done, n = [], 0, 0
    for i in places:
        if i >= done and (m := pattern.match(text, i)):
            parts += [text[done:i], m[1], m[2]]
            done, n = m.end(), n + 1
    return "".join([*parts, text[done:]]) if n else text, n


def collapse(texts: list[str]) -> list[tuple[str, int]]:
    """Each text with its loops cut to two units and the separator between, single characters first; and how many there were."""
    whole = BETWEEN.join(texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    single, several = _places(whole)
    cuts = [np.searchsorted(x, starts) for x in (single, several)]
    made = []
    for k, text in enumerate(texts):
        own = [(x[c[k] : c[k + 1]] - starts[k]).tolist() for x, c in zip((single, several), cuts, strict=True)]
        less, n = _collapse(SINGLE, text, own[0])
        less, more = _collapse(MULTI, less, _places(less)[1].tolist() if n else own[1])
        made.append((less, n + more))
    return made


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())]))
def collapsed(texts: pa.Array) -> pa.Array:
    """(text, n) of each text; null for null."""
    made: list[tuple[str, int]] = []
    held: list[str] = []
    size = 0
    for t in texts.to_pylist():
        held.append(t or "")
        size += len(held[-1])
        if size > STEP:
            made += collapse(held)
            held, size = [], 0
    made += collapse(held)
    gone = texts.is_null().to_pylist()
    columns = [pa.array([None if g else m[i] for m, g in zip(made, gone, strict=True)], t) for i, t in enumerate((pa.string(), pa.int32()))]
    return pa.StructArray.from_arrays(columns, ["text", "n"])
