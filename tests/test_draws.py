"""Draws of the bootstrap: the digest rule, and counts that leave a task once."""

import numpy as np
import pandas as pd

from cohortlens.operators import bootstrap as bs

MASK = 0xFFFFFFFF


def mixed(x):
    x ^= x >> 16
    x = x * 0x7FEB352D & MASK
    x ^= x >> 15
    x = x * 0x846CA68B & MASK
    return x ^ x >> 16


def position(seed, step, b, label, block, slot, size):
    halves = []
    for half in (0, 1):
        key = 0
        for p in (seed, half, step, label, block, b, slot >> 32, slot & MASK):
            key = mixed(key ^ p & MASK)
        halves.append(key)
    return ((halves[0] << 21) + (halves[1] >> 11)) % size


def test_draws_of_a_run_follow_the_digest():
    for low, n, size in ((0, 3, 5), (40, bs.DRAWS_AT_ONCE + 7, 99991), (2**32 - 4, 9, 2**33 + 1)):
        got = bs.drawn(42, 1, np.array([1, 70]), 1, 5, np.arange(low, low + n), size)
        for i, r in enumerate((1, 70)):
            for j in {0, n // 2, n - 2, n - 1}:
                assert got[i, j] == position(42, 1, r, 1, 5, low + j, size)


def test_draws_of_resamples_of_unequal_size():
    keys, taken = bs.draw_keys(3, 1, np.arange(1, 5), 0, 2), np.array([5, 0, 70000, 1])
    found = [[] for _ in taken]
    for i, j, owner, at in bs.draw_runs(keys, 0, taken, 1000, bs._rooms()):
        for k in range(i, j):
            found[k] += at[np.broadcast_to(owner, at.shape) == k - i].tolist()
    for r, (n, mine) in enumerate(zip(taken, found)):
        assert mine == (bs.drawn(3, 1, np.array([r + 1]), 0, 2, np.arange(n), 1000)[0].tolist() if n else [])


def test_blocks_are_found_by_table_and_by_search():
    even, crowded = np.arange(0, 3_000_000, 2999), np.concatenate([np.arange(400), [2_000_000]])
    for starts in (even, crowded, np.array([0])):
        at = np.random.default_rng(1).integers(0, 3_000_000, 5000)
        at[:500] = np.arange(500)
        assert (bs._finder(starts, 3_000_000)(at) == np.searchsorted(starts, at, "right") - 1).all()


def test_a_task_gives_one_count_for_all_its_slots():
    """One frame row per chunk of slots; before, each chunk gave its own row per resample and block."""
    starts, ids = [0, 100, 250], [0, 2, 4]
    chunks = [(1, 400, starts, ids, low, low + 100) for low in range(0, 400, 100)] + [(0, 30, [0], [2], 0, 30)]
    frames = [pd.DataFrame(chunks, columns=["label", "total", "starts", "blocks", "low", "high"])]
    out = pd.concat(bs._block_counts(7, 70, [])(iter(frames)))
    assert not out.duplicated(["b", "block", "label"]).any()
    assert (out.groupby(["b", "label"]).t.sum().unstack() == [30, 400]).all().all()
    at = bs.drawn(7, 0, np.array([66]), 1, 0, np.arange(400), 400)[0]
    assert out[(out.b == 66) & (out.label == 1)].t.tolist() == [(at < 100).sum(), ((at >= 100) & (at < 250)).sum(), (at >= 250).sum()]
