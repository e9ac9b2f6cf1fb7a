"""K4: differences against difflib's own, and a gate whose cost doesn't grow with the square of a text."""

import random
import time
from difflib import SequenceMatcher

from parley.functions.diffs import opcodes_within
from parley.operators import correct
from parley.plans import q_correct


def changed(text, letters, n, r):
    out = list(text)
    for _ in range(n):
        at = r.randint(0, len(out))
        out[at : at + r.randint(0, 2)] = r.choice(["", r.choice(letters), text[: r.randint(0, 20)]])
    return "".join(out)


def test_opcodes_are_those_of_difflib():
    r = random.Random(5)
    beyond = 0
    for _ in range(2500):
        letters = r.choice(["a", "ab", "abcdef", "aé會😀x", "lorem ipsum dolor, sit. "])
        a = "".join(r.choice(letters) for _ in range(r.randint(0, r.choice([5, 60, 300]))))
        a = r.choice([a, (a[: r.randint(1, 30)] * 40)[:300]])
        b = r.choice([changed(a, letters, r.randint(0, 4), r), changed(a, letters, r.randint(0, 40), r), a[::-1], a + " and more", a[2:]])
        expected = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        differ = sum(max(j - i, m - k) for tag, i, j, k, m in expected if tag != "equal")
        most = r.randint(0, len(a) // 5 + 1)
        found = opcodes_within(a, b, most)
        assert opcodes_within(a, b, differ) == expected
        assert found == expected or (found is None and differ > most), (a, b, most)
        beyond += found is None
    assert 300 < beyond < 2300


def test_gate_of_long_texts(spark):
    """Comparing each character with all its equals takes minutes for one of these texts."""
    r = random.Random(7)
    words = ["".join(r.choice("abdehilnorstvwyz") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    text = " ".join(r.choice(words) for _ in range(16_000))
    at = text.index("b", 50_000)
    near = text[:at] + "d" + text[at + 1 :] + " and more"
    rows = [(1, 0, text, near), (1, 1, text, text[::-1]), (1, 2, text, text[2:]), (1, 3, "", "new"), (1, 4, None, "x"), (1, 5, "x", None), (1, 6, " x", "x ")]
    pairs = spark.createDataFrame(rows, "doc_id int, seg_no int, original string, candidate string")
    began = time.time()
    texts, changes = correct.gate_corrections(pairs, q_correct.syllables(spark), spark.createDataFrame([], "wrong string, right string"))
    found = {x.seg_no: (x.text, x.dropped) for x in texts.collect()}
    assert time.time() - began < 60
    assert found == {0: (near[: len(text)], False), 1: (text, True), 2: (text, False), 3: ("", False), 4: (None, False), 5: ("x", False), 6: (" x", False)}
    told = sorted((x.seg_no, x.op_no, x.original, x.corrected, x.accepted, x.reason) for x in changes.collect())
    assert told == [(0, 1, "b", "d", True, ""), (0, 3, "", " and more", False, "insertion"), (1, -1, "", "", False, "changes too much"), (2, 0, text[:2], "", False, "deletion"), (3, 0, "", "new", False, "insertion")]


def test_keys_that_are_there_twice_or_null(spark):
    """Each pair keeps its own replacements."""
    base = "".join(chr(0x5000 + i) for i in range(40))
    rows = [(1, 0, base + "b" + base, base + "d" + base), (1, 0, base + "n" + base, base + "x" + base), (None, 0, base + "v", base + "w")]
    pairs = spark.createDataFrame(rows, "doc_id int, seg_no int, original string, candidate string")
    texts, changes = correct.gate_corrections(pairs, q_correct.syllables(spark), spark.createDataFrame([], "wrong string, right string"))
    assert sorted(x.text for x in texts.collect()) == sorted([rows[0][3], rows[1][2], rows[2][3]])
    assert sorted((x.original, x.accepted) for x in changes.collect()) == [("b", True), ("n", False), ("v", True)]
