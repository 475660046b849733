"""Deep-shallow sorting of byte strings of one length, with their common prefixes.

Shallow: multikey quicksort with eight bytes for a character, down to a fixed
depth: a group of strings equal so far is parted three ways by a pivot (the
median of three of its characters at its depth), and what is equal to the pivot
goes on one character deeper.  numpy parts all open groups at once.  Deep: strings
that still agree there go into a blind trie, which stores only branching depths
and characters; a string finds its place by one blind descent, one comparison
with the leaf it meets, and a second descent to where they differ.
"""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 24


class _Node:
    __slots__ = ("children", "depth", "leaf")

    def __init__(self, depth: int, leaf: bytes):
        self.depth, self.leaf = depth, leaf
        self.children: dict[int, _Node] = {}


def _differ(a: bytes, b: bytes) -> int:
    """First position where two different strings of one length differ."""
    n = len(a)
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie_order(strings: set[bytes]) -> list[bytes]:
    """Different strings of one length in ascending order."""
    rest = iter(strings)
    first = next(rest)
    size = len(first)
    root = _Node(size, first)
    for s in rest:
        node = root
        while node.depth < size:  # blind: only at branching characters
            node = node.children.get(s[node.depth]) or next(iter(node.children.values()))
        at = _differ(s, node.leaf)
        parent, node = None, root
        while node.depth < at:
            parent, node = node, node.children[s[node.depth]]
        if node.depth == at:
            node.children[s[at]] = _Node(size, s)
        else:
            branch = _Node(at, s)
            branch.children = {node.leaf[at]: node, s[at]: _Node(size, s)}
            if parent is None:
                root = branch
            else:
                parent.children[s[parent.depth]] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.depth == size:
            out.append(node.leaf)
        else:
            stack.extend(node.children[c] for c in sorted(node.children, reverse=True))
    return out


def multikey_quicksort(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new) of rows by their first ``depth`` characters; ``new`` marks where a row differs from the one before."""
    n = len(words)
    order, at, new = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
    new[:1] = True
    open_ = np.ones(n, bool) if n > 1 else np.zeros(n, bool)
    while open_.any():
        spots = np.flatnonzero(open_)
        starts = np.flatnonzero(new[spots])  # open groups lie whole among the spots
        sizes = np.diff(np.append(starts, len(spots)))
        group = np.repeat(np.arange(len(starts)), sizes)
        value = words[order[spots], at[spots]]
        ends = np.stack([value[starts], value[starts + sizes // 2], value[starts + sizes - 1]])
        pivot = np.sort(ends, 0)[1][group]
        side = np.where(value < pivot, 0, np.where(value == pivot, 1, 2))
        inner = np.argsort(3 * group + side, kind="stable")
        order[spots], side = order[spots[inner]], side[inner]
        at[spots] += side == 1
        new[spots[1:]] |= side[1:] != side[:-1]
        begin = np.flatnonzero(new)
        alone = np.diff(np.append(begin, n)) == 1
        open_ &= at < depth
        open_[begin[alone]] = False
    return order, new


def deep_shallow_sort(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the rows of a matrix of bytes; lcp[i]: bytes that the i-th in order shares with the one before (lcp[0] is 0)."""
    n, size = rows.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = -(-size // 8) * 8
    padded = np.zeros((n, width), np.uint8)
    padded[:, :size] = rows
    words = padded.view(">u8").astype(np.uint64)
    depth = min(max(shallow // 8, 1), words.shape[1])
    order, new = multikey_quicksort(words, depth)
    if 8 * depth < size:
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], n)
        for start, stop in zip(starts[stops - starts > 1].tolist(), stops[stops - starts > 1].tolist(), strict=True):
            own = order[start:stop]
            tails = rows[own, 8 * depth :]
            if (tails == tails[0]).all():
                continue
            strings = [t.tobytes() for t in tails]
            rank = {s: i for i, s in enumerate(blind_trie_order(set(strings)))}
            order[start:stop] = own[np.argsort([rank[s] for s in strings], kind="stable")]
    lcp = np.zeros(n, np.int64)
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        first = max(at, 1)
        if first < stop:
            unequal = rows[order[first:stop]] != rows[order[first - 1 : stop - 1]]
            lcp[first:stop] = np.where(unequal.any(1), unequal.argmax(1), size)
    return order, lcp
