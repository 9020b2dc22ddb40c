"""Few bins for a table of lengths: bin completion by branch and bound, with best-fit solutions as incumbents.

Items of one length are alike, so a state is how many are left of each length and a step fills a number of bins in one way. The work
grows with the different lengths, at most the capacity of a bin, and not with the number of items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np

#: How often a way of filling a bin is used, and its (length, number of items) pairs, longest first.
Pattern = tuple[int, tuple[tuple[int, int], ...]]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A number of bins that no packing goes below: items over half a bin lie alone, and what is left of theirs bounds the rest."""
    n = np.zeros(capacity + 1, np.int64)
    for length, k in counts.items():
        n[length] = k
    items, sums = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * np.arange(capacity + 1)))
    half = capacity // 2
    low = np.arange(half + 1)
    high = capacity - low
    alone, middle = items[-1] - items[high + 1], items[high + 1] - items[half + 1]
    room = middle * capacity - (sums[high + 1] - sums[half + 1])
    small = sums[half + 1] - sums[low]
    return int(max(0, np.max(alone + middle + np.maximum(0, -((room - small) // capacity)))))


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit by falling length: each item goes to the fullest bin that takes it. Bins that are filled alike are one entry."""
    rooms: list[int] = []
    open_at: dict[int, list[tuple]] = {}

    def put(room: int, filling: tuple, bins: int) -> None:
        if room not in open_at:
            insort(rooms, room)
        open_at.setdefault(room, []).append((filling, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                filling, bins = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
            else:
                room, filling, bins = capacity, (), -(-left // (capacity // length))
            each = room // length
            full = min(bins, left // each)
            rest = left - full * each if full < bins else 0
            if full:
                put(room - each * length, (*filling, (length, each)), full)
            if rest:
                put(room - rest * length, (*filling, (length, rest)), 1)
            if bins - full - bool(rest):
                put(room, filling, bins - full - bool(rest))
            left -= full * each + rest
    return [(bins, filling) for room in rooms for filling, bins in open_at[room]]


def undominated(counts: dict[int, int], gap: int, most_waste: int, most: int) -> list[tuple[int, tuple]]:
    """(waste, filling) of up to ``most`` undominated fillings of ``gap``, least waste first, and long items before short ones. Eight times as many are
    looked at; if all of these are dominated, the first of them counts.

    A filling is dominated if an item that it leaves out could take the place of some that it holds, fits, and is no shorter than they are
    together: what it frees fits wherever that item would have gone.
    """
    have = sorted((x for x in counts if counts[x] and x <= gap), reverse=True)
    if not have:
        return [(gap, ())] if gap <= most_waste else []
    if have[0] == gap:
        return [(0, ((gap, 1),))]
    mask, there = (1 << gap + 1) - 1, sum(1 << x for x in have)
    reach = [1]  # the sums that the shorter lengths can make
    for x in reversed(have):
        sums, copies, step = reach[-1], min(counts[x], gap // x), 1
        while copies:
            step = min(step, copies)
            sums |= sums << step * x & mask
            copies -= step
            step *= 2
        reach.append(sums)
    reach.reverse()

    def exact(k: int, rest: int) -> Iterator[tuple]:
        if not rest:
            yield ()
            return
        for at in range(k, len(have)):
            x = have[at]
            if x > rest:
                continue
            if not reach[at] >> rest & 1:
                return
            for copies in range(min(counts[x], rest // x), 0, -1):
                if reach[at + 1] >> rest - copies * x & 1:
                    for tail in exact(at + 1, rest - copies * x):
                        yield ((x, copies), *tail)

    found: list[tuple[int, tuple]] = []
    spare: list[tuple[int, tuple]] = []
    tried = 0
    for waste in range(min(most_waste, gap) + 1):
        if not reach[0] >> gap - waste & 1:
            continue
        for filling in exact(0, gap - waste):
            tried += 1
            (spare if dominated(filling, counts, there, waste) else found).append((waste, filling))
            if len(found) >= most or tried >= 8 * most:
                return found or spare[:1]
    return found


def dominated(filling: tuple, counts: dict[int, int], there: int, slack: int) -> bool:
    """``there`` has a bit for each length of which items are left."""
    one = many = 0  # bits of the sums of one item, and of two or more
    for x, copies in filling:
        if counts[x] <= copies:
            there &= ~(1 << x)
        for _ in range(copies):
            many |= (many | one) << x
            one |= 1 << x
    longer = spread(one << 1, slack - 1) if slack else 0
    return bool((spread(many, slack) | longer) & there)


def spread(bits: int, by: int) -> int:
    """The bits, and each of the ``by`` places above any of them."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 2000, branch: int = 6) -> tuple[list[Pattern], int]:
    """(patterns, lower bound): every item of ``counts`` {length: items} in bins of ``capacity``, in as few as the search finds.

    The incumbent is best fit by falling length. If it does not meet the lower bound, bins are completed one way at a time: the longest item
    left, and an undominated filling of the room beside it, least waste first, in as many bins as there are items for, then in fewer.
    A branch ends when its waste, or its bins and the lower bound of what is left, could not beat the incumbent; each better solution is the new one.
    The search ends at the lower bound, when all is searched, or after ``nodes`` states of ``branch`` fillings at most; then the best packing so far counts.
    """
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return [], 0
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths lie between 1 and the capacity")
    best = best_fit(counts, capacity)
    most, least, total = sum(n for n, _ in best), least_bins(counts, capacity), sum(x * n for x, n in counts.items())
    left, chosen = dict(counts), []

    def use(pattern: Pattern, sign: int) -> None:
        for x, copies in pattern[1]:
            left[x] += sign * pattern[0] * copies

    def ways(bins: int, wasted: int) -> Iterator[tuple[int, Pattern]]:
        allowed = (most - 1) * capacity - total - wasted
        longest = max(x for x in left if left[x])
        left[longest] -= 1
        fillings = undominated(left, capacity - longest, allowed, branch)
        left[longest] += 1
        for waste, filling in fillings:
            held = dict(filling)
            held[longest] = held.get(longest, 0) + 1
            times = min(left[x] // n for x, n in held.items())
            while times:
                yield waste, (times, tuple(sorted(held.items(), reverse=True)))
                times = times // 2 if times > 8 else times - 1

    bins = wasted = seen = 0
    stack: list[Iterator] = []
    if most > least:
        stack.append(ways(0, 0))
    while stack and most > least and seen < nodes:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if chosen:
                waste, pattern = chosen.pop()
                use(pattern, 1)
                bins, wasted = bins - pattern[0], wasted - waste * pattern[0]
            continue
        waste, pattern = step
        if wasted + waste * pattern[0] > (most - 1) * capacity - total:
            continue
        seen += 1
        use(pattern, -1)
        bins, wasted = bins + pattern[0], wasted + waste * pattern[0]
        rest = {x: n for x, n in left.items() if n}
        if not rest and bins < most:
            best, most = [*(p for _, p in chosen), pattern], bins
        if rest and bins + least_bins(rest, capacity) < most:
            chosen.append(step)
            stack.append(ways(bins, wasted))
        else:
            use(pattern, 1)
            bins, wasted = bins - pattern[0], wasted - waste * pattern[0]
    return best, least
