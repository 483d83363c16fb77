"""Keys of fingerprints that differ in four bits or fewer, wherever these stand."""

import itertools

import numpy as np
import pytest

from sieveline.llm import golay_simhash


@pytest.mark.parametrize("wide", [False, True])
def test_near_fingerprints_share_a_key(wide):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        # all four in one segment, three and one, two and two, or anywhere
        at = [range(21), range(21, 42), range(42, 64), range(64)][i % 4]
        places = list(rng.choice(list(at), i % 3 + 2, replace=False)) + list(rng.choice(64, 2 - i % 3, replace=False))
        for p in set(map(int, places)):
            b[i] ^= np.uint64(1) << np.uint64(p)
    assert np.bitwise_count(a ^ b).max() == 4
    keys = []
    for x in (a, b):
        found = [set() for _ in x]
        for row, key in zip(*(k.tolist() for k in golay_simhash.fuzzy_keys(x, wide))):
            found[row].add(key)
        keys.append(found)
    assert all(x & y for x, y in zip(*keys))


def test_keys_of_all_short_errors():
    base = np.uint64(0x0123456789ABCDEF)
    near = [base ^ np.uint64(sum(1 << p for p in places)) for n in (1, 2) for places in itertools.combinations(range(64), n)]
    for wide in (False, True):
        own = set(golay_simhash.fuzzy_keys(np.array([base]), wide)[1].tolist())
        rows, keys = golay_simhash.fuzzy_keys(np.array(near), wide)
        assert set(rows[[k in own for k in keys.tolist()]].tolist()) == set(range(len(near)))
