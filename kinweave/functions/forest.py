"""Spanning forests of edge arrays, in numpy."""

from __future__ import annotations

import numpy as np


def min_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): every node of the edges (u, v) and the smallest node it reaches.

    Hooks every root to its smallest neighbouring root, then jumps pointers,
    until no edge joins two roots.
    """
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u):]
    parent = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return nodes, nodes[parent]


def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not its own root: at most nodes - 1 edges."""
    nodes, roots = min_roots(u, v)
    other = nodes != roots
    return nodes[other], roots[other]
