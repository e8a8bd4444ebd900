"""Deep-shallow string sorting: multikey quicksort down to a shallow depth, blind tries below it."""
from __future__ import annotations

import numpy as np

SHALLOW = 32
_STEP = 4       # bytes taken as one character by the quicksort


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


class _Node:
    """An inner node: the depth at which its strings differ, and its branches by byte (-1: the string ends)."""
    __slots__ = ("depth", "branches")

    def __init__(self, depth: int, branches: dict):
        self.depth, self.branches = depth, branches


def blind_trie(strings: list[bytes], items: list[int]) -> list[int]:
    """Sorted items by a blind trie, whose nodes keep depths only; a leaf lists items with equal strings.

    A string descends without comparing, is compared once with the leaf it reaches and hangs where the two part.
    """
    root: _Node | list[int] = [items[0]]
    for item in items[1:]:
        s = strings[item]
        node = root
        while type(node) is _Node:
            child = node.branches.get(s[node.depth] if node.depth < len(s) else -1)
            node = next(iter(node.branches.values())) if child is None else child
        leaf = strings[node[0]]
        at = common_prefix(s, leaf)
        if at == len(s) == len(leaf):
            node.append(item)
            continue
        parent, key, node = None, 0, root
        while type(node) is _Node and node.depth < at:
            parent, key = node, s[node.depth] if node.depth < len(s) else -1
            node = node.branches[key]
        mine = s[at] if at < len(s) else -1
        if type(node) is _Node and node.depth == at:
            node.branches[mine] = [item]
            continue
        fresh = _Node(at, {leaf[at] if at < len(leaf) else -1: node, mine: [item]})
        if parent is None:
            root = fresh
        else:
            parent.branches[key] = fresh
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if type(node) is _Node:
            stack.extend(node.branches[k] for k in sorted(node.branches, reverse=True))
        else:
            out.extend(node)
    return out


def sort_group(strings: list[bytes], items: list[int], shallow: int = SHALLOW) -> list[int]:
    """Items in the order of their strings; equal strings keep their order."""
    out: list[int] = []
    stack = [(items, 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) == 1 or depth < 0:
            out.extend(items)
        elif depth >= shallow:
            out.extend(blind_trie(strings, items))
        else:
            keys = [strings[i][depth:depth + _STEP] for i in items]
            pivot = keys[len(keys) // 2]
            more = [i for i, k in zip(items, keys) if k > pivot]
            same = [i for i, k in zip(items, keys) if k == pivot]
            if more:
                stack.append((more, depth))
            less = [i for i, k in zip(items, keys) if k < pivot]
            if len(pivot) < _STEP:
                stack.append((same, -1))         # these strings end here and are equal
            else:
                stack.append((same, depth + _STEP))
            if less:
                stack.append((less, depth))
    return out


def sorted_classes(strings: list[bytes], groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order within consecutive equal ``groups``, and each entry's common prefix with the one before it.

    The common prefix is -1 where a group begins.
    """
    n = len(strings)
    begins = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if n else np.zeros(0, np.int64)
    order: list[int] = []
    prefix = np.full(n, -1, np.int64)
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), n]):
        if end - begin == 1:
            order.append(begin)
            continue
        ranked = sort_group(strings, list(range(begin, end)), shallow)
        order.extend(ranked)
        for k in range(1, len(ranked)):
            prefix[begin + k] = common_prefix(strings[ranked[k - 1]], strings[ranked[k]])
    return np.array(order, np.int64), prefix


def classes_at(order: np.ndarray, prefix: np.ndarray, length: int) -> np.ndarray:
    """For each string a number that strings of one group share iff their first ``length`` bytes agree."""
    at = np.maximum.accumulate(np.where(prefix < length, np.arange(len(order)), 0))
    out = np.empty(len(order), np.int64)
    out[order] = at
    return out
