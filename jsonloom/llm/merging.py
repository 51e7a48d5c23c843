"""Rank-synchronous merging of byte-pair sequences held as ragged arrays.

Both ways here give what merging one pair after the other gives, in each
sequence the pair of lowest rank first, the leftmost of several.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

NONE = np.int64(1) << 40
#: Sequences of more symbols than this are merged rank by rank, so that time grows with their length and not its square.
LONG = 96
Pair = Callable[[np.ndarray, np.ndarray], np.ndarray]


def merge(sym: np.ndarray, seq: np.ndarray, pair: Pair, product: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What survives: symbols and their sequences, ordered by sequence.

    ``pair`` gives the rank of pairs (NONE if they don't merge), ``product`` the
    symbol that a rank makes (itself if not given).
    """
    if not len(sym):
        return sym, seq
    first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
    size = np.diff(np.append(first, len(sym)))
    long = np.repeat(size > LONG, size)
    if not long.any():
        return by_rounds(sym, seq, pair, product)
    parts = [by_rounds(sym[~long], seq[~long], pair, product), by_ranks(sym[long], seq[long], pair, product)]
    sym, seq = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(seq, kind="stable")
    return sym[order], seq[order]


def by_rounds(sym: np.ndarray, seq: np.ndarray, pair: Pair, product: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """In a round each sequence applies its pair of lowest rank once: few rounds if all are short."""
    rank = np.full(len(sym), NONE)
    if len(sym) > 1:
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inside] = pair(sym[inside], sym[inside + 1])
    done_sym, done_seq = [], []
    while len(sym):
        first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        order = np.where(rank < NONE, rank * len(sym) + np.arange(len(sym)), np.iinfo(np.int64).max)
        best = np.minimum.reduceat(order, first)
        live = best < np.iinfo(np.int64).max
        keep = np.repeat(live, np.diff(np.append(first, len(sym))))
        done_sym.append(sym[~keep])
        done_seq.append(seq[~keep])
        at = best[live] % len(sym)
        sym[at] = rank[at] if product is None else product[rank[at]]
        if not len(at):
            break
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        sym, seq, rank, at = sym[keep], seq[keep], rank[keep], moved[at]
        # only pairs beside the new symbols have changed
        rank[at] = NONE
        right = at[at + 1 < len(sym)]
        right = right[seq[right + 1] == seq[right]]
        rank[right] = pair(sym[right], sym[right + 1])
        left = at[at > 0]
        left = left[seq[left - 1] == seq[left]] - 1
        rank[left] = pair(sym[left], sym[left + 1])
    if not done_sym:
        return sym, seq
    sym, seq = np.concatenate(done_sym), np.concatenate(done_seq)
    order = np.argsort(seq, kind="stable")
    return sym[order], seq[order]


def by_ranks(sym: np.ndarray, seq: np.ndarray, pair: Pair, product: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rank after rank, all pairs of that rank at once in all sequences: each pair is looked at once or twice.

    That is the same as one after the other as long as no merge makes a pair of
    that rank or a lower one. A sequence where one does is merged by a queue.
    """
    n = len(sym)
    start_sym, start_seq = sym.copy(), seq
    sym = sym.copy()
    # one more element that is no symbol, at both ends
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    last = np.append(seq[1:] != seq[:-1], True)
    after[last], before[np.append(True, last[:-1])] = n, n
    rank = np.full(n + 1, NONE)
    inside = np.flatnonzero(~last)
    rank[inside] = pair(sym[inside], sym[inside + 1])
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def wait(at: np.ndarray) -> None:
        at = at[rank[at] < NONE]
        if not len(at):
            return
        r = rank[at]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for part, value in zip(np.split(at, cuts), r[np.append(0, cuts)].tolist(), strict=True):
            if value not in waiting:
                waiting[value] = []
                heapq.heappush(queue, value)
            waiting[value].append(part)

    wait(inside)
    alive = np.ones(n + 1, bool)
    odd: set[int] = set()
    sym = np.append(sym, np.int64(-1))
    after = np.append(after, n)
    before = np.append(before, n)
    while queue:
        r = heapq.heappop(queue)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        # of pairs that overlap, every other one from the left
        if len(at) > 1:
            run = np.append(False, after[at[:-1]] == at[1:])
            if run.any():
                head = np.maximum.accumulate(np.where(run, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
        gone = after[at]
        made = np.int64(r) if product is None else product[r]
        following = after[gone]
        # what the new symbol makes with what follows before that merges as well
        passing = following[following < n]
        owner = at[following < n]
        seen = pair(np.full(len(passing), made), sym[passing]) if len(passing) else np.zeros(0, np.int64)
        if (bad := seen <= r).any():
            odd.update(seq[owner[bad]].tolist())
        sym[at] = made
        alive[gone] = False
        after[at] = following
        before[following[following < n]] = owner
        rank[gone] = NONE
        rank[at] = NONE
        right = at[after[at] < n]
        rank[right] = pair(sym[right], sym[after[right]])
        left = before[at]
        left = left[left < n]
        rank[left] = pair(sym[left], sym[after[left]])
        changed = np.unique(np.append(right, left))
        low = changed[rank[changed] <= r]
        if len(low):
            odd.update(seq[low].tolist())
        wait(changed[rank[changed] > r])
    keep = alive[:n]
    if not odd:
        return sym[:n][keep], seq[keep]
    strange = np.isin(seq, list(odd))
    out_sym, out_seq = [sym[:n][keep & ~strange]], [seq[keep & ~strange]]
    for s in sorted(odd):
        own = by_queue(start_sym[start_seq == s].tolist(), pair, product)
        out_sym.append(own)
        out_seq.append(np.full(len(own), s, seq.dtype))
    sym, seq = np.concatenate(out_sym), np.concatenate(out_seq)
    order = np.argsort(seq, kind="stable")
    return sym[order], seq[order]


def by_queue(sym: list[int], pair: Pair, product: np.ndarray | None) -> np.ndarray:
    """One sequence, a merge at a time, from a queue of pairs by rank and place."""
    n = len(sym)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    cache: dict[tuple[int, int], int] = {}

    def rank_of(a: int, b: int) -> int:
        if (a, b) not in cache:
            cache[a, b] = int(pair(np.array([a]), np.array([b]))[0])
        return cache[a, b]

    queue = [(r, i) for i in range(n - 1) if (r := rank_of(sym[i], sym[i + 1])) < NONE]
    heapq.heapify(queue)
    alive = [True] * n
    while queue:
        r, i = heapq.heappop(queue)
        j = after[i]
        if not alive[i] or j < 0 or rank_of(sym[i], sym[j]) != r:
            continue
        sym[i] = r if product is None else int(product[r])
        alive[j], after[i] = False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (new := rank_of(sym[a], sym[b])) < NONE:
                heapq.heappush(queue, (new, a))
    return np.array([s for s, ok in zip(sym, alive, strict=True) if ok], np.int64)
