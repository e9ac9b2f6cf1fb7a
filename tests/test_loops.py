"""Loops by shifts against a scan that counts copies at every place, and texts with their results written out."""

import random
from functools import lru_cache

import pytest

from parley.functions import loops
from parley.operators import clean

LIGHT = set("、，,。")


def copies_after(text, at, unit, least):
    """Ends of the copies of the unit that follow each other from ``at``, ``least`` or more, each as far on as can be; or None."""

    @lru_cache(None)
    def after(at, least):
        gap = at
        while gap < len(text) and (text[gap] in LIGHT or text[gap].isspace()):
            gap += 1
        for start in range(gap, at - 1, -1):
            if text.startswith(unit, start) and (more := after(start + len(unit), max(0, least - 1))) is not None:
                return [start + len(unit), *more]
        return None if least else []

    return after(at, least)


def scan(text, lengths, least, plain):
    out, at, n = "", 0, 0
    while at < len(text):
        for size in lengths:
            unit = text[at : at + size]
            if len(unit) < size or any(c.isspace() for c in unit) or (plain and unit in LIGHT):
                continue
            if ends := copies_after(text, at + size, unit, least - 1):
                out, at, n = out + text[at : ends[0]], ends[-1], n + 1
                break
        else:
            out, at = out + text[at], at + 1
    return out, n


def collapsed(text):
    text, one = scan(text, [1], 8, True)
    text, more = scan(text, range(2, 21), 4, False)
    return text, one + more


CASES = [
    ("啊啊啊啊啊啊啊啊好", "啊啊好", 1),
    ("啊啊啊啊啊啊啊好", "啊啊啊啊啊啊啊好", 0),
    ("對、對、對、對、對、對、對、對。", "對、對。", 1),
    ("謝謝大家謝謝大家謝謝大家謝謝大家", "謝謝大家謝謝大家", 1),
    ("謝謝大家 謝謝大家 謝謝大家。", "謝謝大家 謝謝大家 謝謝大家。", 0),
    ("ok, ok, ok, ok, end", "ok, ok, end", 1),
    ("no\nno\nno\nno\nyes", "no\nno\nyes", 1),
    (",,,,,,,,", ",,,,", 1),
    ("a" * 9 + " " + "xy" * 5, "aa xyxy", 2),
    ("x " * 200_000, "x x ", 1),
    ("", "", 0),
    (None, None, None),
]


def test_written_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    found = {r.doc_id: (r.text, r.loops_collapsed) for r in clean.collapse_loops(df).collect()}
    assert found == {i: (t, n) for i, (_, t, n) in enumerate(CASES)}


@pytest.mark.parametrize("letters", ["ab", "a,", "ab ,", "abc、，。 \n", "謝大家。 "])
def test_random_texts(letters):
    r = random.Random(letters)
    texts = []
    for _ in range(1500):
        unit = "".join(r.choice(letters) for _ in range(r.randint(1, 6)))
        texts.append("".join(r.choice([unit, unit, unit, r.choice(letters)]) for _ in range(r.randint(0, 16))))
    found = [x for i in range(0, 1500, 7) for x in loops.collapse(texts[i : i + 7])]
    assert found == [collapsed(t) for t in texts]
    assert sum(n > 0 for _, n in found) > 100


def test_long_units_and_texts_in_steps(spark, monkeypatch):
    r = random.Random(2)
    texts = []
    for size in range(1, 25):
        unit = "".join(r.choice("abcdefgh") for _ in range(size))
        for k in (3, 4, 5):
            texts.append("in " + unit * k + " out")
            texts.append("in " + ", ".join([unit] * k) + " out")
    monkeypatch.setattr(loops, "STEP", 50)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: (r.text, r.loops_collapsed) for r in clean.collapse_loops(df).collect()}
    assert found == {i: collapsed(t) for i, t in enumerate(texts)}
