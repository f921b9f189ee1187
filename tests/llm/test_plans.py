"""Packing plans with the parameters that op5 runs with."""

import random
from collections import Counter

import pytest

from sparkfolio.llm import packing

from . import brute


def planted(seed, bins, capacity):
    """Three pieces for each of `bins` full sequences."""
    r, out = random.Random(seed), []
    for _ in range(bins):
        a, b = sorted(r.sample(range(400, capacity - 400), 2))
        out += [a, b - a, capacity - b]
    return Counter(out)


@pytest.mark.parametrize("bins", [6, 10, 14])
def test_search_finds_planted_packings(bins):
    for seed in range(5):
        counts = planted(seed, bins, 2048)
        made = packing.plan(counts, 2048)
        assert Counter({s: sum(n * dict(p).get(s, 0) for p, n in made) for s in counts}) == counts
        assert all(sum(a * b for a, b in p) <= 2048 for p, _ in made)
        assert sum(n for _, n in made) == bins < sum(n for _, n in packing.best_fit(counts, 2048))


def test_optimal_on_small_cases():
    r = random.Random(8)
    for _ in range(200):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        assert sum(n for _, n in packing.plan(Counter(sizes), 20)) == brute.fewest_bins(sizes, 20), sizes


def test_fillings_are_undominated_and_whole():
    counts = [0] * 11
    for s in (2, 3, 5, 8):
        counts[s] = 2
    there = sum(1 << s for s, n in enumerate(counts) if n)
    assert sorted(packing.fillings(counts, there, 10, [10**6])) == [[5, 5], [8, 2]]


@pytest.mark.parametrize("pieces, low, high, gap", [(2000, 600, 760, 5), (1500, 300, 699, 2), (5000, 300, 699, 4)])
def test_search_betters_best_fit(pieces, low, high, gap):
    """Lengths that best-fit packs badly: within a few sequences of the bound, at the setting that op5 runs with."""
    for seed in range(3):
        r = random.Random(seed)
        counts = Counter(r.randint(low, high) for _ in range(pieces))
        made = packing.plan(counts, 2048)
        assert Counter({s: sum(n * dict(p).get(s, 0) for p, n in made) for s in counts}) == counts
        assert all(sum(a * b for a, b in p) <= 2048 for p, _ in made)
        used = sum(n for _, n in made)
        assert used <= packing.lower_bound(counts, 2048) + gap and used < sum(n for _, n in packing.best_fit(counts, 2048))


def test_fullest_is_the_least_waste():
    r = random.Random(4)
    for _ in range(300):
        room, counts = r.randint(1, 40), [0] * 41
        for _ in range(r.randint(0, 6)):
            counts[r.randint(1, 40)] += r.randint(1, 3)
        there = sum(1 << s for s, n in enumerate(counts) if n)
        got = packing.fullest(counts, there, room)
        reach = {0}
        for s, n in enumerate(counts):
            for _ in range(n):
                reach |= {x + s for x in reach if x + s <= room}
        assert sum(got) == max(reach) and all(got.count(s) <= counts[s] for s in got)


def test_unbounded_search_is_exact():
    r = random.Random(9)
    for _ in range(60):
        sizes = [r.randint(3, 30) for _ in range(r.randint(1, 9))]
        assert sum(n for _, n in packing.plan(Counter(sizes), 30, None)) == brute.fewest_bins(sizes, 30)
