import numpy as np
import pytest

from tessera.llm.jaccard import RegionJoin


def brute(sets, num, den):
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(np.intersect1d(a, b))
            if den * n >= num * (len(a) + len(b) - n):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
@pytest.mark.parametrize("leaf", [256, 4])
def test_region_join(monkeypatch, seed, num, den, leaf):
    """Chains of near copies, sets that differ by just as much as links allow, and strangers; in small pieces too."""
    monkeypatch.setattr(RegionJoin, "LEAF", leaf)
    monkeypatch.setattr(RegionJoin, "CELLS", 64 if leaf == 4 else 1 << 22)
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(6):
        s = rng.choice(10**6, int(rng.integers(5, 60)), replace=False)
        for _ in range(int(rng.integers(1, 9))):
            s = s.copy()
            s[rng.choice(len(s), int(rng.integers(0, 1 + len(s) // 9)), replace=False)] += 10**7 + int(rng.integers(1000))
            sets.append(np.unique(s).astype(np.uint64))
    rng.shuffle(sets := list(map(tuple, sets)))
    sets = [np.array(s, np.uint64) for s in sets]
    join = RegionJoin(sets, num, den)
    assert [join.top(i) for i in range(len(sets))] == brute(sets, num, den)
    join = RegionJoin.__new__(RegionJoin)
    join.sets, join.num, join.den, join.size, join.root = sets, num, den, np.array(list(map(len, sets))), np.arange(len(sets))
    join.product(np.arange(len(sets)))
    assert [join.top(i) for i in range(len(sets))] == brute(sets, num, den)
