"""The tally of shared positional bytes decides which pairs have their bits counted."""

import numpy as np

from signalbook.llm import simhash


def test_tally():
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 2**64, (2, 4000), dtype=np.uint64)
    keep = draw.integers(0, 2, (4000, 8)).astype(bool)
    mask = (keep * (np.uint64(0xFF) << (8 * np.arange(8, dtype=np.uint64)))).sum(axis=1, dtype=np.uint64)
    b = (a & mask) | (b & ~mask)
    same = (a.view(np.uint8).reshape(-1, 8) == b.view(np.uint8).reshape(-1, 8)).sum(axis=1)
    assert (simhash.shared_bytes(a ^ b) == same).all() and set(same) >= set(range(9))


def test_retained_pairs_equal_brute_force(monkeypatch):
    draw = np.random.default_rng(4)
    roots = draw.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in draw.choice(64, n, replace=False)) for n in draw.integers(0, 7, 400)], np.uint64)
    fps = np.unique(draw.choice(roots, 400) ^ flips)
    differ = fps[:, None] ^ fps[None, :]
    counted = []
    count = np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: (counted.append(x.size), count(x))[1])
    for bits in range(5):
        counted.clear()
        got = simhash.retained(differ, bits)
        assert set(zip(*got)) == set(zip(*np.nonzero(count(differ) <= bits)))
        tallied, verified = counted
        assert tallied == differ.size and verified < tallied / 4
