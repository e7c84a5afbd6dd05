"""Budgeted selection against the plain loop."""

import random

from feedlens.operators import match


def loop(entry, pos, relevance, covered, pinned, budget):
    rows = list(range(len(entry)))
    while len(rows) > budget and not all(pinned[i] for i in rows):
        def cost(i):
            alone = sum(sum(s in covered[j] for j in rows) == 1 for s in covered[i])
            return 0.5 + relevance[i] + 1.5 * alone + 100 * (sum(entry[j] == entry[i] for j in rows) == 1)

        rows.remove(min((i for i in rows if not pinned[i]), key=lambda i: (cost(i), -pos[i])))
    return rows


def test_heap_equals_the_loop_on_random_groups():
    rng = random.Random(8)
    for _ in range(1000):
        n = rng.randrange(0, 14)
        group = (
            [rng.randrange(4) for _ in range(n)], rng.sample(range(100), n), [rng.choice((0.0, 0.5, 1.0, 1.5)) for _ in range(n)],
            [rng.sample("abcde", rng.randrange(4)) for _ in range(n)], [rng.random() < 0.2 for _ in range(n)],
        )
        budget = rng.randrange(6)
        assert match.kept_within(*group, budget) == loop(*group, budget)


def test_many_bullets_are_quick():
    n = 20_000
    kept = match.kept_within([i % 50 for i in range(n)], list(range(n)), [i % 97 / 10 for i in range(n)], [[f"s{i % 30}"] for i in range(n)], [False] * n, 60)
    assert len(kept) == 60
