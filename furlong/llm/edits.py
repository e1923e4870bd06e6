"""Whether strings lie within so many edits of each other, for many pairs at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD = 64
CELLS = 1 << 15
"""Pairs times blocks of the shorter string that are handled at a time."""
LONG = 4096
"""From this length on a pair is handled by itself, on Python's long integers."""
STEP = 128
"""Columns after which pairs on long integers are looked at, and after which those in groups are."""
FEW = 32
"""Pairs of about one length up to which each is handled by itself: a group costs as much, however small."""
ONE = np.uint64(1)
ALL = np.uint64(2**64 - 1)


def within(xs: list[str], ys: list[str], most: np.ndarray) -> np.ndarray:
    """Whether at most ``most`` edits turn each x into its y: exact, by Myers' bit vectors."""
    out = np.zeros(len(xs), bool)
    short, long = [], []
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        short.append(x)
        long.append(y)
        out[k] = len(y) - len(x) <= most[k] and word_by_word(x, y, int(most[k]))
    m, n = (np.array([len(s) for s in some], np.int64) for some in (short, long))
    open_pairs = ~out & (n - m <= most)
    out[open_pairs & (m == 0)] = True
    for i in np.flatnonzero(open_pairs & (m > 0) & (n >= LONG)):
        out[i] = one_within(short[i], long[i], int(most[i]))
    at = np.flatnonzero(open_pairs & (m > 0) & (n < LONG))
    at = at[np.argsort(n[at], kind="stable")]
    for first, last in runs(n[at]):
        some = at[first:last]
        if len(some) <= FEW:
            out[some] = [one_within(short[i], long[i], int(most[i])) for i in some]
            continue
        out[some] = group_within([short[i] for i in some], [long[i] for i in some], most[some].astype(np.int64))
    return out


LOOK = ((1, 1), (0, 1), (1, 0), (2, 2), (0, 2), (2, 0), (1, 2), (2, 1))


def word_by_word(x: str, y: str, most: int) -> bool:
    """Whether replacing, inserting and deleting a few words here and there turns x into y within ``most`` edits.

    False may also mean that it takes another way.
    """
    a, b = x.split(" "), y.split(" ")
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i += 1
            j += 1
            continue
        for di, dj in LOOK:
            if a[i + di : i + di + 2] == b[j + dj : j + dj + 2]:
                break
        else:
            di = dj = 1
        cost += max(sum(map(len, a[i : i + di])) + di, sum(map(len, b[j : j + dj])) + dj) if di != dj or di > 1 else max(len(a[i]), len(b[j]))
        if cost > most:
            return False
        i += di
        j += dj
    return cost + sum(map(len, a[i:])) + len(a) - i + sum(map(len, b[j:])) + len(b) - j <= most


def runs(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of pairs of about the same length, no longer than ``CELLS`` allows."""
    begin = 0
    while begin < len(n):
        end = min(len(n), begin + max(1, CELLS // (int(n[begin]) // WORD + 1)))
        near = int(np.searchsorted(n, n[begin] * 1.3 + 16, "right"))
        end = min(end, near) if near > begin else end
        yield begin, end
        begin = end


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings, end to end, and their bounds."""
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum([len(s) for s in strings])))


def group_within(xs: list[str], ys: list[str], most: np.ndarray) -> np.ndarray:
    """``within`` for pairs in order of the length of y.

    Only blocks within reach of the diagonal are computed: cells outside are
    taken for greater than they are, which changes no distance up to ``most``.
    A way that leaves the diagonal has to come back to the last one, so half the
    edits lead as far as it may go.  A cell of the last diagonal is no greater than the
    distance, if that is up to ``most``, so pairs beyond are let go on the way.
    """
    count = len(xs)
    (a, a_bounds), (b, b_bounds) = codes(xs), codes(ys)
    letters = np.unique(a)
    m, n = np.diff(a_bounds), np.diff(b_bounds)
    above, below = int((most - n + m).max()) // 2, int((most + n - m).max()) // 2
    own = (m - 1) // WORD
    blocks = int(own.max()) + 1
    # Places of the letters in x as bits, by block, letter and pair; the last letter is one that x does not have.
    bits = np.zeros((blocks, len(letters) + 1, count), np.uint64)
    owner = np.repeat(np.arange(count), m)
    place = np.arange(len(a)) - a_bounds[owner]
    np.bitwise_or.at(bits, (place // WORD, np.searchsorted(letters, a), owner), ONE << (place % WORD).astype(np.uint64))
    letter = np.searchsorted(letters, b).clip(max=len(letters) - 1)
    letter[letters[letter] != b] = len(letters)
    columns = np.full((int(n.max()), count), len(letters), np.int64)
    columns[np.arange(len(b)) - np.repeat(b_bounds[:-1], n), np.repeat(np.arange(count), n)] = letter
    columns *= count
    columns += np.arange(count)
    bits = bits.reshape(blocks, -1)
    up, down = np.full((blocks, count), ALL), np.zeros((blocks, count), np.uint64)
    # The last block of a pair ends at its last row.
    ends = [np.where(own == w, (m - 1) % WORD, WORD - 1).astype(np.uint64) for w in range(blocks)]
    last = 0
    scores = [ends[0] + ONE]
    out = np.zeros(count, bool)
    still = np.arange(count)
    done = base = 0
    for j in range(int(n.max())):
        letter = columns[j - base]
        while last < min(blocks - 1, (j + above) // WORD):
            last += 1
            scores.append(scores[-1] + ends[last] + ONE)
        above_up, above_down = ONE, None
        for w in range(max(0, (j - below) // WORD), last + 1):
            pv, mv = up[w], down[w]
            eq = bits[w].take(letter)
            xv = eq | mv
            if above_down is not None:
                eq |= above_down
            xh = eq & pv
            xh += pv
            xh ^= pv
            xh |= eq
            ph = xh | pv
            np.invert(ph, out=ph)
            ph |= mv
            mh = xh
            mh &= pv
            next_up, next_down = ph >> ends[w], mh >> ends[w]
            next_up &= ONE
            next_down &= ONE
            ph <<= ONE
            ph |= above_up
            mh <<= ONE
            if above_down is not None:
                mh |= above_down
            np.bitwise_and(ph, xv, out=down[w])
            xv |= ph
            np.invert(xv, out=xv)
            np.bitwise_or(mh, xv, out=up[w])
            above_up, above_down = next_up, next_down
            scores[w] += next_up
            scores[w] -= next_down
        if n[done] == j + 1:
            stop = int(np.searchsorted(n, j + 1, "right"))
            for w in range(last + 1):
                at = done + np.flatnonzero(own[done:stop] == w)
                out[still[at]] = scores[w][at].view(np.int64) <= most[at]
            done = stop
            if done == len(n):
                break
        if j % STEP == STEP - 1:
            row = j - n + m
            near = np.arange(len(n)) >= done
            for w in range(last + 1):
                at = np.flatnonzero(near & (row >= 0) & (row // WORD == w))
                later = ALL << (row[at] % WORD).astype(np.uint64) << ONE
                later &= ALL >> (np.uint64(WORD - 1) - ends[w][at])
                cell = scores[w][at].view(np.int64) - np.bitwise_count(up[w][at] & later) + np.bitwise_count(down[w][at] & later)
                near[at] = cell <= most[at]
            keep = np.flatnonzero(near)
            if len(keep) <= FEW:
                out[still[keep]] = [one_within(xs[i], ys[i], int(k)) for i, k in zip(still[keep], most[keep], strict=True)]
                break
            if 2 * len(keep) <= len(n):
                bits = bits.reshape(blocks, -1, len(n))[:, :, keep].reshape(blocks, -1)
                columns = (columns[j + 1 - base :, keep] - keep) // len(n) * len(keep) + np.arange(len(keep))
                up, down = up[:, keep], down[:, keep]
                ends, scores = [x[keep] for x in ends], [x[keep] for x in scores]
                still, own, m, n, most = (x[keep] for x in (still, own, m, n, most))
                done, base = 0, j + 1
    return out


def one_within(a: str, b: str, most: int) -> bool:
    """``within`` for one pair, a no longer than b; rows out of reach of the diagonal are left out, ``STEP`` columns at a time."""
    more = len(b) - len(a)
    above, below = (most - more) // 2, (most + more) // 2
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up = down = score = low = high = 0
    for first in range(0, len(b), STEP):
        start, end = max(0, first - below), min(len(a), first + STEP + above)
        up, down = up >> start - low, down >> start - low
        up |= (1 << end - high) - 1 << high - start
        score += end - high
        low, high = start, end
        full, top = (1 << high - low) - 1, 1 << high - low - 1
        eqs: dict[str, int] = {}
        for c in b[first : first + STEP]:
            eq = eqs.get(c)
            if eq is None:
                eq = eqs[c] = places.get(c, 0) >> low & full
            zero = (((eq & up) + up) ^ up) | eq | down
            plus = down | ~(zero | up) & full
            minus = up & zero
            score += bool(plus & top) - bool(minus & top)
            plus = (plus << 1 | 1) & full
            minus = minus << 1 & full
            up = minus | ~(zero | plus) & full
            down = plus & zero
        # A cell of the last diagonal is no greater than the distance, if that is up to most.
        row = min(first + STEP, len(b)) - more - low
        if row > 0 and score - (up >> row).bit_count() + (down >> row).bit_count() > most:
            return False
    return score <= most
