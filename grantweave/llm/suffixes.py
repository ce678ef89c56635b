"""Suffix arrays by induced sorting, in numpy: many suffixes are induced at once.

``suffix_array`` classifies suffixes as larger or smaller than their right neighbour, sorts the leftmost-smaller
substrings by one induction, names them, sorts the string of names by the same procedure unless (nearly) all names differ, and
induces the whole array from that order. A string over few symbols is induced bucket by bucket. The strings of
names have thousands of symbols and next to nothing in a bucket; there all suffixes are induced together, along the runs of
larger and of smaller ones, by doubling (runs are short, so two or three rounds do).
"""

from __future__ import annotations

import numpy as np

#: Symbols up to which buckets are induced one by one.
NARROW = 1024
#: The share of different names from which their string is sorted by rank doubling, which ends after a few rounds there.
UNLIKE = 0.5


def sorting(key: np.ndarray) -> np.ndarray:
    """As argsort of whole numbers from 0 on: with their places in the low bits they are sorted as values, which is faster, where 63 bits are enough."""
    n = len(key)
    bits = n.bit_length()
    if not n or int(key.max()).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    return np.sort(key.astype(np.int64) << bits | np.arange(n)) & ((1 << bits) - 1)


def by_rank_doubling(s: np.ndarray) -> np.ndarray:
    """Suffix array of integers of any range; log(longest repeat) sorts."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank, span = rank.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-span] = rank[span:] + 1
        key = rank * (n + 2) + after
        order = sorting(key)
        new = np.empty(n, np.int64)
        sorted_key = key[order]
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if new[order[-1]] == n - 1 or span >= n:
            return order
        rank, span = new, span * 2


def induce(s: np.ndarray, starts: dict[int, np.ndarray], sigma: int) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones of each bucket in order."""
    none = np.empty(0, np.int64)

    def spread(found: np.ndarray, queue: list[list[np.ndarray]]) -> None:
        """Append suffixes to their buckets' queues, keeping their order."""
        if len(found):
            c = s[found]
            order = np.argsort(c, kind="stable")
            found, c = found[order], c[order]
            cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
            for part, a in zip(np.split(found, cuts), [0, *cuts.tolist()], strict=True):
                queue[int(c[a])].append(part)

    def waves(queued: list[np.ndarray], c: int) -> np.ndarray:
        """The queued suffixes, then those that a run of the same symbol puts before them, and so on."""
        cur = np.concatenate(queued) if queued else none
        out = [cur]
        while len(cur):
            cur = cur[cur > 0] - 1
            cur = cur[s[cur] == c]
            out.append(cur)
        return np.concatenate(out)

    larger: list[np.ndarray] = [none] * sigma
    queue: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    for c in range(sigma):
        larger[c] = waves(queue[c], c)
        scan = np.concatenate([larger[c], starts.get(c, none)])
        before = scan[scan > 0] - 1
        spread(before[s[before] > c], queue)
    smaller: list[np.ndarray] = [none] * sigma
    queue = [[] for _ in range(sigma)]
    queue[0] = [np.array([len(s) - 1], np.int64)]
    for c in range(sigma - 1, -1, -1):
        smaller[c] = waves(queue[c], c)
        scan = np.concatenate([smaller[c], larger[c][::-1]])
        before = scan[scan > 0] - 1
        spread(before[s[before] < c], queue)
    return np.concatenate([part for c in range(sigma) for part in (larger[c], smaller[c][::-1])])


def names_of(s: np.ndarray, leftmost: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """A number for each leftmost-smaller substring, equal ones sharing theirs; ``ranked`` has them in order."""
    n = len(s)
    begin = leftmost[ranked]
    stop = np.concatenate([leftmost[1:], [n - 1]])[ranked]
    length = stop - begin + 1
    same = length[1:] == length[:-1]
    left = np.flatnonzero(same)
    for k in range(int(length.max())):  # compare neighbours symbol by symbol while any pair is alike
        if not len(left):
            break
        left = left[length[left] > k]
        differ = s[begin[left] + k] != s[begin[left + 1] + k]
        same[left[differ]] = False
        left = left[~differ]
    names = np.empty(len(leftmost), np.int64)
    names[ranked] = np.concatenate([[0], np.cumsum(~same)])
    return names


def dense(key: np.ndarray) -> np.ndarray:
    order = sorting(key)
    ranked, rank = key[order], np.empty(len(key), np.int64)
    rank[order[:1]] = 0
    rank[order[1:]] = np.cumsum(ranked[1:] != ranked[:-1])
    return rank


def refined(first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Ranks of chains: a chain begins with ``first`` and goes on at the place ``after``; its last place leads to itself."""
    rank, span, kinds = dense(first), len(first) + 1, 0
    while kinds < rank.max() + 1 < len(rank):
        kinds = rank.max() + 1
        rank, after = dense(rank * span + rank[after]), after[after]
    return rank


def induced_ranks(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray, given: np.ndarray) -> np.ndarray:
    """A number for every suffix that sorts it, given numbers that sort the leftmost-smaller ones; where those are equal for
    equal symbols, suffixes that are equal up to the next leftmost-smaller one share a number."""
    n = len(s)
    place, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    kind, span = 2 * s.astype(np.int64) + small, n + 1

    def run(mine: np.ndarray, ends: np.ndarray, known: np.ndarray) -> None:
        every = np.concatenate([mine, ends])
        place[every] = np.arange(len(every))
        after = np.concatenate([place[np.minimum(mine + 1, n - 1)], place[ends]])
        rank[mine] = refined(kind[every] * span + np.concatenate([np.zeros(len(mine), np.int64), known]), after)[: len(mine)]

    run(np.flatnonzero(~small), leftmost, given)
    ends = np.flatnonzero(small[:-1] & ~small[1:]) + 1
    run(np.flatnonzero(small), ends, rank[ends])
    return dense(kind * span + rank)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``symbols`` (integers from 0 on); the end counts as smaller than any symbol."""
    if not len(symbols):
        return np.empty(0, np.int64)
    sigma = int(symbols.max()) + 2
    s = np.zeros(len(symbols) + 1, np.uint16 if sigma < 1 << 16 else np.int64)  # 16 bits are sorted by radix
    s[:-1] = symbols
    s[:-1] += 1
    n = len(s)
    # a suffix is smaller than its right neighbour if the next unlike symbol is larger
    unlike = np.concatenate([s[1:] != s[:-1], [True]])
    following = np.minimum.accumulate(np.where(unlike, np.arange(n), n)[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = s[np.minimum(following[:-1] + 1, n - 1)] > s[:-1]
    leftmost = np.flatnonzero(small & np.concatenate([[False], ~small[:-1]]))

    def by_bucket(order: np.ndarray) -> dict[int, np.ndarray]:
        c = s[order]
        stable = np.argsort(c, kind="stable")
        order, c = order[stable], c[stable]
        cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
        return {int(c[a]): part for part, a in zip(np.split(order, cuts), [0, *cuts.tolist()], strict=True)}

    if sigma <= NARROW:
        order = induce(s, by_bucket(leftmost), sigma)
        number = np.full(n, -1, np.int64)
        number[leftmost] = np.arange(len(leftmost))
        ranked = number[order]
        names = names_of(s, leftmost, ranked[ranked >= 0])
    else:
        names = dense(induced_ranks(s, small, leftmost, np.zeros(len(leftmost), np.int64))[leftmost])
    different = int(names.max()) + 1
    final = sorting(names) if different == len(names) else suffix_array(names) if different < UNLIKE * len(names) else by_rank_doubling(names)
    if sigma <= NARROW:
        return induce(s, by_bucket(leftmost[final]), sigma)[1:]
    given = np.empty(len(leftmost), np.int64)
    given[final] = np.arange(len(leftmost))
    return sorting(induced_ranks(s, small, leftmost, given))[1:]


def common_prefixes(data: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the prefixes that the suffixes at the places a and b share, eight bytes at a time."""
    n = len(data)
    words = np.ndarray((n + 1,), "<u8", data + b"\0" * 8, 0, (1,))
    shared, at, done = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(at):
        x, y = a[at], b[at]
        room = n - np.maximum(x, y) - done
        differ = words[np.minimum(x + done, n)] ^ words[np.minimum(y + done, n)]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        equal = np.minimum(equal, np.maximum(room, 0))
        shared[at] += equal
        at, done = at[equal == 8], done + 8
    return shared


def permuted_prefixes(data: bytes, order: np.ndarray, cap: int) -> np.ndarray:
    """For each place, the length up to ``cap`` of the prefix its suffix shares with the suffix before it in ``order``, all suffixes in order.

    Where both suffixes stand behind equal bytes, the length is that of the place before less one: such lengths are carried on, and
    only the others are compared."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    s = np.frombuffer(data, np.uint8)
    carried = np.zeros(n, bool)
    carried[1:] = (before[1:] > 0) & (s[np.arange(n - 1)] == s[before[1:] - 1])
    fresh = np.flatnonzero(~carried)
    shared = np.zeros(n, np.int64)
    some = fresh[before[fresh] >= 0]
    shared[some] = common_prefixes(data, some, before[some])
    last = np.maximum.accumulate(np.where(carried, 0, np.arange(n)))
    return np.minimum(shared[last] - (np.arange(n) - last), cap)
