"""Deep-shallow suffix sorting of chosen positions of a byte buffer.

Multikey quicksort orders the suffixes to a shallow depth, eight bytes (one
"character" of a large alphabet) at a time; segments that are small enough are
sorted directly on the characters that are left. Suffixes that still agree
there have a long common prefix; blind tries order these groups to the full
depth, and tell which of them are equal.
"""

from __future__ import annotations

import numpy as np

#: Characters of eight bytes that the quicksort looks at, and the segment size below which it sorts directly.
SHALLOW, SMALL = 4, 1 << 14


class _Node:
    __slots__ = ("children", "depth", "leaf", "places")

    def __init__(self, depth: int, leaf: bytes | None, place: int = -1):
        self.depth, self.leaf, self.children, self.places = depth, leaf, {}, [place]


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """The places of strings of one length, in order, equal ones together; inner nodes hold only the depth at which their strings part."""
    size = len(strings[0])
    if strings.count(strings[0]) == len(strings):
        return [list(range(len(strings)))]
    root = _Node(size, strings[0], 0)
    for place, s in enumerate(strings[1:], 1):
        path, node = [], root
        while node.children:
            path.append(node)
            node = node.children.get(s[node.depth]) or next(iter(node.children.values()))
        other = node.leaf
        if other == s:
            node.places.append(place)
            continue
        parted = int.from_bytes(s) ^ int.from_bytes(other)
        common = size - (parted.bit_length() + 7) // 8
        path.append(node)
        at = next(i for i, n in enumerate(path) if n.depth >= common)
        below, leaf = path[at], _Node(size, s, place)
        if below.children and below.depth == common:
            below.children[s[common]] = leaf
            continue
        fork = _Node(common, None)
        fork.children = {other[common]: below, s[common]: leaf}
        if at:
            path[at - 1].children[s[path[at - 1].depth]] = fork
        else:
            root = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.children:
            stack.extend(node.children[c] for c in sorted(node.children, reverse=True))
        else:
            out.append(node.places)
    return out


def characters(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The first SHALLOW characters of the suffixes at ``at``, as big-endian numbers."""
    padded = np.concatenate([data, np.zeros(8 * SHALLOW, np.uint8)])
    eight = np.ndarray(len(padded) - 7, np.dtype(">u8"), padded, strides=(1,))
    return [eight[at + 8 * i].astype(np.uint64) for i in range(SHALLOW)]


def multikey_quicksort(chars: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their characters."""
    done, stack = [], [(np.arange(len(chars[0])), 0)]
    while stack:
        seg, level = stack.pop()
        if level == len(chars) or len(seg) < 2:
            done.append(seg)
        elif len(seg) <= SMALL:
            done.append(seg[np.lexsort([c[seg] for c in reversed(chars[level:])])])
        else:
            key = chars[level][seg]
            sample = np.sort(key[:: max(1, len(key) // 9)])
            pivot = sample[len(sample) // 2]
            less, more = key < pivot, key > pivot
            stack += [(seg[more], level), (seg[~(less | more)], level + 1), (seg[less], level)]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def equal_suffixes(data: np.ndarray, at: np.ndarray, size: np.ndarray, first: list[np.ndarray], matters: np.ndarray | None = None) -> np.ndarray:
    """The class of each string of ``size`` bytes at ``at``: equal numbers for equal strings, rising in their order.

    ``first`` are numbers by which strings differ before their bytes count (a
    group's key, their size). Strings are at least 8 * SHALLOW bytes long. Strings
    that agree to the shallow depth and in ``matters`` may share a number.
    """
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    chars = [*first, *characters(data, at)]
    order = multikey_quicksort(chars)
    new = np.ones(n, bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in chars], axis=0)
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    deep = count > 1
    if matters is not None:
        deep &= np.minimum.reduceat(matters[order], start) < np.maximum.reduceat(matters[order], start)
    raw, begin, end = data.tobytes(), at[order].tolist(), (at + size)[order].tolist()
    for s, c in zip(start[deep].tolist(), count[deep].tolist(), strict=True):
        groups = blind_trie([raw[begin[i] : end[i]] for i in range(s, s + c)])
        if len(groups) > 1:
            order[s : s + c] = order[s : s + c][[i for g in groups for i in g]]
            for g in groups[:-1]:
                s += len(g)
                new[s] = True
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(new) - 1
    return out
