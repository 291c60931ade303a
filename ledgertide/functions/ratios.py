"""Whether the matching ratio of two texts reaches a threshold, without taking the ratio."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from heapq import heappop, heappush

#: Letters from which on SequenceMatcher leaves a second text's usual letters out of its search, and runs of rare letters for each letter at most.
USUAL_FROM, MOST_RUNS = 200, 4


def _same_back(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many letters before a[i] and b[j] are the same, at most `most`."""
    k = 0
    while k < most:
        w = min(64, most - k)
        if a[i - k - w : i - k] == b[j - k - w : j - k]:
            k += w
            continue
        while a[i - k - 1] == b[j - k - 1]:
            k += 1
        return k
    return k


def _same_on(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many letters from a[i] and b[j] on are the same, at most `most`."""
    k = 0
    while k < most:
        w = min(64, most - k)
        if a[i + k : i + k + w] == b[j + k : j + k + w]:
            k += w
            continue
        while a[i + k] == b[j + k]:
            k += 1
        return k
    return k


class Against:
    """Texts against one, b: reached_by(a) is SequenceMatcher(None, a, b).ratio() >= threshold.

    The matcher looks for the longest run of letters that are rare in b, the first of equal ones, extends it by any equal letters, and goes on before and
    after it. Here runs of rare letters are looked up by their places rather than letter by letter, and it ends as soon as what is left can't
    reach the threshold. Texts that have no usual letters are left to the matcher itself.
    """

    def __init__(self, b: str, threshold: float) -> None:
        self.b, self.threshold, self.places = b, threshold, {}
        if len(b) < USUAL_FROM:
            return
        rare = "".join(c for c, n in Counter(b).items() if n <= len(b) // 100 + 1)
        self.among = re.compile(f"[{re.escape(rare)}]+") if rare else re.compile("(?!)")
        runs = [(m.start(), m.group()) for m in self.among.finditer(b)]
        self.plain = sum(len(r) * (len(r) + 1) // 2 for _, r in runs) <= MOST_RUNS * len(b)
        for start, run in runs if self.plain else ():
            for k in range(len(run)):
                for end in range(k + 1, len(run) + 1):
                    self.places.setdefault(run[k:end], []).append(start + k)

    def reached_by(self, a: str) -> bool:
        b, total = self.b, len(a) + len(self.b)
        best = min(len(a), len(b))
        if not total or 2.0 * best / total < self.threshold:
            return not total and self.threshold <= 1.0
        if len(b) < USUAL_FROM or not self.plain:
            return SequenceMatcher(None, a, b).ratio() >= self.threshold
        places, starts, there = self.places, defaultdict(list), defaultdict(list)
        for m in self.among.finditer(a):
            start, run = m.start(), m.group()
            for k in range(len(run)):
                for end in range(k + 1, len(run) + 1):
                    if (found := places.get(run[k:end])) is None:
                        break
                    starts[end - k].append(start + k)
                    there[end - k].append(found)
        sizes = sorted(starts, reverse=True)
        open_ = [(-best, 0, len(a), 0, len(b))]
        while open_:
            bound, alo, ahi, blo, bhi = heappop(open_)
            i, j, size = alo, blo, 0
            for length in sizes:
                if length > -bound:
                    continue
                at, where = starts[length], there[length]
                k, end = bisect_left(at, alo), ahi - length
                while k < len(at) and at[k] <= end:
                    x = bisect_left(where[k], blo)
                    if x < len(where[k]) and where[k][x] + length <= bhi:
                        i, j, size = at[k], where[k][x], length
                        break
                    k += 1
                if size:
                    break
            back = _same_back(a, i, b, j, min(i - alo, j - blo))
            i, j, size = i - back, j - back, size + back
            size += _same_on(a, i + size, b, j + size, min(ahi - i, bhi - j) - size)
            best += bound + size
            if size:
                for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                    if most := min(part[1] - part[0], part[3] - part[2]):
                        best += most
                        heappush(open_, (-most, *part))
            if 2.0 * best / total < self.threshold:
                return False
        return True


def reaches(a: str, b: str, threshold: float) -> bool:
    """SequenceMatcher(None, a, b).ratio() >= threshold."""
    return Against(b, threshold).reached_by(a)
