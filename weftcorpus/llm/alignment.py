"""Alignment of page trees by simple tree matching.

A tree is given as arrays in document order: each node's parent, label and text (a
hash; 0 for none). Of two trees with equal root labels, the match is the largest one
that keeps parents and the order of siblings; equal texts count double, so they align.
Nothing here recurses, so that depth is not bounded by a stack, and the table of two
long lists of siblings is halved until it fits, so that memory is bounded as well.
"""

from __future__ import annotations

import numpy as np

_HEADER = np.dtype([("parent", "<i4"), ("label", "<i4"), ("text", "<i8"), ("link", "i1")])


class Tree:
    """parent, label, text and link (whether all of its text is in links) of each node."""

    __slots__ = ("parent", "label", "text", "link", "kids")

    def __init__(self, parent: list[int], label: list[int], text: list[int], link: list[bool]):
        self.parent, self.label, self.text, self.link = parent, label, text, link
        self.kids: list[list[int]] = [[] for _ in parent]
        for i, p in enumerate(parent):
            if i:
                self.kids[p].append(i)

    def packed(self) -> bytes:
        out = np.empty(len(self.parent), _HEADER)
        out["parent"], out["label"], out["text"], out["link"] = self.parent, self.label, self.text, self.link
        return out.tobytes()

    def keys(self) -> list[int]:
        """For each node with text a hash of its path of labels and its text, for counting."""
        path, out = [0], []
        for i, (p, name, words) in enumerate(zip(self.parent, self.label, self.text)):
            path.append(((path[p + 1 if i else 0] * 1_000_003) ^ name) & ((1 << 61) - 1))
            if words:
                out.append((path[-1] * 7919 + words) & ((1 << 63) - 1))
        return out

    @classmethod
    def unpacked(cls, raw: bytes) -> Tree:
        x = np.frombuffer(raw, _HEADER)
        return cls(x["parent"].tolist(), x["label"].tolist(), x["text"].tolist(), x["link"].astype(bool).tolist())


def _rows(a: Tree, b: Tree, x: list[int], y: list[int], weights: dict):
    """A function that gives the weights of x[i] with all of y[lo:hi]."""
    la, lb = np.array([a.label[i] for i in x]), np.array([b.label[j] for j in y])
    ta, tb = np.array([a.text[i] for i in x]), np.array([b.text[j] for j in y])
    deep = [j for j, v in enumerate(y) if b.kids[v]]

    def row(i: int, lo: int, hi: int) -> np.ndarray:
        w = (lb[lo:hi] == la[i]).astype(np.int64)
        if ta[i]:
            w += w & (tb[lo:hi] == ta[i])
        if a.kids[x[i]]:
            for j in deep:
                if lo <= j < hi and w[j - lo]:
                    w[j - lo] = weights[x[i], y[j]]
        return w

    return row


def _step(best: np.ndarray, w: np.ndarray) -> None:
    """From the sizes for all rows before to those with one row more, of weights w."""
    reach = np.maximum(best[1:], np.where(w > 0, best[:-1] + w, 0))
    best[1:] = np.maximum.accumulate(reach)


def _last(row, i0: int, i1: int, j0: int, j1: int, back: bool) -> np.ndarray:
    """The sizes of the largest matches of rows i0..i1 with each beginning (back: end) of columns j0..j1."""
    best = np.zeros(j1 - j0 + 1, np.int64)
    for i in reversed(range(i0, i1)) if back else range(i0, i1):
        w = row(i, j0, j1)
        _step(best, w[::-1] if back else w)
    return best


def siblings(row, n: int, m: int, most_cells: int = 1 << 21) -> list[tuple[int, int]]:
    """The pairs of the largest order-keeping match of n rows with m columns."""
    out, todo = [], [(0, n, 0, m)]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        if (i1 - i0) * (j1 - j0) > most_cells and i1 - i0 > 1:
            mid = (i0 + i1) // 2
            head, tail = _last(row, i0, mid, j0, j1, False), _last(row, mid, i1, j0, j1, True)
            cut = j0 + int(np.argmax(head + tail[::-1]))
            todo += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
            continue
        table = np.zeros((i1 - i0 + 1, j1 - j0 + 1), np.int64)
        for i in range(i0, i1):
            table[i - i0 + 1] = table[i - i0]
            _step(table[i - i0 + 1], row(i, j0, j1))
        i, j = i1 - i0, j1 - j0
        while i and j:
            if table[i, j] == table[i - 1, j]:
                i -= 1
            elif table[i, j] == table[i, j - 1]:
                j -= 1
            else:
                out.append((i0 + i - 1, j0 + j - 1))
                i, j = i - 1, j - 1
    return out


def _small(a: Tree, b: Tree, x: list[int], y: list[int], weights: dict) -> tuple[int, list[tuple[int, int]]]:
    """Size and pairs for a few siblings, without arrays."""
    label, text, kids = b.label, b.text, b.kids
    table = [[0] * (len(y) + 1)]
    for u in x:
        above, now, own, t, deep = table[-1], [0], a.label[u], a.text[u], bool(a.kids[u])
        for j, v in enumerate(y):
            best = above[j + 1] if above[j + 1] > now[j] else now[j]
            if label[v] == own:
                w = weights[u, v] if deep and kids[v] else 2 if t and t == text[v] else 1
                if above[j] + w > best:
                    best = above[j] + w
            now.append(best)
        table.append(now)
    out, i, j = [], len(x), len(y)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return table[-1][-1], out


def match(a: Tree, b: Tree) -> tuple[int, list[tuple[int, int]]]:
    """The size of the largest match and its pairs of nodes; 0 where the roots' labels differ."""
    if not a.parent or not b.parent or a.label[0] != b.label[0]:
        return 0, []
    weights: dict[tuple[int, int], int] = {}
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    todo = [(0, 0, False)]
    while todo:
        u, v, ready = todo.pop()
        if (u, v) in weights:
            continue
        x, y = a.kids[u], b.kids[v]
        if not ready:
            todo.append((u, v, True))
            deep = [j for j in y if b.kids[j]]
            todo += [(i, j, False) for i in x if a.kids[i] for j in deep if a.label[i] == b.label[j]]
            continue
        if len(x) * len(y) <= 256:
            size, pairs = _small(a, b, x, y, weights)
        else:
            row = _rows(a, b, x, y, weights)
            pairs = siblings(row, len(x), len(y))
            size = sum(int(row(i, j, j + 1)[0]) for i, j in pairs)
        weights[u, v] = 1 + (1 if a.text[u] and a.text[u] == b.text[v] else 0) + size
        found[u, v] = pairs
    out, todo = [], [(0, 0)]
    while todo:
        u, v = todo.pop()
        out.append((u, v))
        if (u, v) in found:
            todo += [(a.kids[u][i], b.kids[v][j]) for i, j in found[u, v]]
    return weights[0, 0], out
