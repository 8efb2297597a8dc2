"""String similarity by the normalised longest common subsequence, 0 to 100, over sorted words or sets of words."""

from __future__ import annotations

from functools import lru_cache

def indel(a: str, b: str) -> float:
    """200 * common subsequence / (both lengths); 100 for two empty strings."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


@lru_cache(maxsize=1 << 16)
def token_sort(a: str, b: str) -> float:
    """``indel`` of the sorted words; headers repeat from file to file, so pairs are remembered."""
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of: common words against common words with the rest of either, and these against each other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one, two = (f"{both} {' '.join(sorted(s - (x & y)))}".strip() for s in (x, y))
    return max(indel(one, two), indel(both, one) if both else 0.0, indel(both, two) if both else 0.0)

