"""Differences of two texts as difflib gives them, at a cost that falls with how much alike they are."""

from __future__ import annotations

from difflib import Match, SequenceMatcher

#: Runs of fewer characters are left to difflib, unless no shorter ones than ``NEEDED`` would do.
SHORT, NEEDED = 16, 6


def common_start(a: str, b: str) -> int:
    """How many characters two texts begin with alike, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def long_run(a: str, b: str, least: int) -> tuple[int, int, int] | None:
    """(start in a, start in b, length) of the longest common run, the first in a and then in b, if it has ``least`` characters.

    Any such run holds one of the grams that are taken from ``a`` at even distances, whole."""
    gram = (least + 1) // 2
    best, ends = (0, 0, 0), {}
    for at in range(0, len(a) - gram + 1, least - gram + 1):
        found = b.find(a[at : at + gram])
        while found >= 0:
            # Of each diagonal, where its last run ends: a gram within it is a part of that run.
            if ends.get(found - at, 0) < at + gram:
                before = common_start(a[:at][::-1], b[:found][::-1])
                size = before + gram + common_start(a[at + gram :], b[found + gram :])
                ends[found - at] = at - before + size
                best = min(best, (-size, at - before, found - before))
            found = b.find(a[at : at + gram], found + 1)
    return (best[1], best[2], -best[0]) if -best[0] >= least else None


class Beyond(Exception):
    """The texts differ by more characters than asked for."""


class Matcher(SequenceMatcher):
    """``SequenceMatcher(None, a, b, autojunk=False)``: the same blocks and opcodes, or ``Beyond`` as soon as it is sure that
    more than ``most`` characters differ (of each replacement the longer side counts).

    Long runs are looked for by search in the text; only where there is none, characters are compared with all equal ones."""

    def __init__(self, a: str, b: str, most: int) -> None:
        super().__init__(autojunk=False)  # of nothing, so that no index of b is made
        # Between two runs no fewer characters differ than the one side is longer by.
        self.a, self.b, self.most, self.differ = a, b, most, abs(len(a) - len(b))

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> Match:
        a, b = self.a[alo:ahi], self.b[blo:bhi]
        longer, elsewhere = max(len(a), len(b)), self.differ - abs(len(a) - len(b))
        # Between runs of fewer characters than this, more would differ than is left.
        need = longer // (self.most - elsewhere + 1)
        i, j, size = longest_run(a, b, need)
        self.differ = elsewhere + (abs(i - j) + abs((len(a) - i) - (len(b) - j)) if size else longer)
        if size < need or self.differ > self.most:
            raise Beyond
        return Match(alo + i, blo + j, size)


def longest_run(a: str, b: str, need: int) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run, the first in a and then in b; of a shorter one than ``need``
    it may say that there is none."""
    least = min(len(a), len(b))
    if a == b:
        return 0, 0, least
    if least == 1:
        i, j = (a.find(b), 0) if len(b) == 1 else (0, b.find(a))
        return (i, j, 1) if min(i, j) >= 0 else (0, 0, 0)
    while least >= 2 * SHORT:
        least //= 2
        if run := long_run(a, b, least):
            return run
    if need >= NEEDED:
        return long_run(a, b, need) or (0, 0, 0)
    return SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b))


def opcodes_within(a: str, b: str, most: int) -> list[tuple[str, int, int, int, int]] | None:
    """difflib's opcodes, or None where more than ``most`` characters differ; that may be found out before they are known."""
    if abs(len(a) - len(b)) > most:
        return None
    try:
        return Matcher(a, b, most).get_opcodes()
    except Beyond:
        return None
