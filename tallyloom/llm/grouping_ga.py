"""A grouping genetic algorithm for packing lengths into bins of one capacity.

A solution is a list of bins, a bin the sorted tuple of its lengths. Pieces of
equal length are interchangeable, so solutions need no names of pieces.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections import Counter, defaultdict

Bin = tuple[int, ...]
WELL_FILLED = 0.99


def best_fit(bins: list[Bin], lengths: list[int], capacity: int) -> list[Bin]:
    """Put each length, in the order given, where it leaves the least room; open bins as needed."""
    filled = [list(b) for b in bins]
    rooms = sorted((capacity - sum(b), i) for i, b in enumerate(filled))
    for x in lengths:
        at = bisect_left(rooms, (x, -1))
        if at == len(rooms):
            filled.append([x])
            insort(rooms, (capacity - x, len(filled) - 1))
        else:
            room, i = rooms.pop(at)
            filled[i].append(x)
            insort(rooms, (room - x, i))
    return [tuple(sorted(b)) for b in filled]


def bins_needed(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins."""
    return -(-sum(lengths) // capacity)


def fitness(bins: list[Bin], capacity: int) -> tuple[int, float]:
    """Smaller is better: bins, then how evenly they are filled (full bins beside empty ones are best)."""
    return len(bins), -sum((sum(b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(one: list[Bin], other: list[Bin], capacity: int, rng: random.Random) -> list[Bin]:
    """Inject well-filled bins of ``other`` into ``one``.

    Bins of ``one`` that hold a length now there twice are taken apart; what else
    was in them is displaced and placed again by best fit, longest first.
    """
    good = [b for b in other if sum(b) >= WELL_FILLED * capacity] or [max(other, key=sum)]
    injected = rng.sample(good, rng.randint(1, max(1, len(good) // 2)))
    twice = Counter(x for b in injected for x in b)
    holders = defaultdict(list)
    order = sorted(range(len(one)), key=lambda i: (sum(one[i]), rng.random()))  # worst filled first
    for i in order:
        for x in set(one[i]):
            if x in twice:
                holders[x].append(i)
    apart, displaced = set(), Counter()

    def take(i: int) -> None:
        apart.add(i)
        displaced.update(one[i])

    for x, n in twice.items():
        for i in holders[x]:
            if displaced[x] >= n:
                break
            if i not in apart:
                take(i)
    displaced.subtract(twice)
    rest = [b for i, b in enumerate(one) if i not in apart]
    return best_fit([*rest, *injected], sorted(displaced.elements(), reverse=True), capacity)


def mutated(bins: list[Bin], capacity: int, rng: random.Random) -> list[Bin]:
    """Take the emptiest bins and a few others apart and place their lengths again."""
    order = sorted(range(len(bins)), key=lambda i: sum(bins[i]))
    k = max(2, len(bins) // 10)
    gone = {*order[: k // 2], *rng.sample(range(len(bins)), min(len(bins), k))}
    lengths = [x for i in gone for x in bins[i]]
    lengths.sort(key=lambda x: x * rng.uniform(0.7, 1.0), reverse=True)
    return best_fit([b for i, b in enumerate(bins) if i not in gone], lengths, capacity)


def evolve(lengths: list[int], elites: list[list[Bin]], capacity: int, seed: int, population: int = 6, generations: int = 10) -> list[Bin]:
    """The best solution an island finds from the elites it is given; it stops early where no better one can exist."""
    rng = random.Random(seed)
    least = bins_needed(lengths, capacity)
    people = [e for e in elites if e] or [best_fit([], sorted(lengths, reverse=True), capacity)]
    best = min(people, key=lambda b: fitness(b, capacity))
    if len(best) <= least:
        return best
    while len(people) < population:
        people.append(mutated(best, capacity, rng))
    for _ in range(generations):
        children = []
        for _ in range(population):
            one, other = rng.sample(people, 2)
            child = crossover(one, other, capacity, rng)
            children.append(mutated(child, capacity, rng) if rng.random() < 0.3 else child)
        people = sorted([*people, *children], key=lambda b: fitness(b, capacity))[:population]
        if len(people[0]) <= least:
            break
    return people[0]
