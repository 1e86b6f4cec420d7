"""Dealing documents to places by their words, so that documents with common rare words lie near each other.

A document is the random projection of its distinct terms, weighted by inverse document frequency.  A tree
of halvings, each along the axis of greatest variance, is learned from a bounded sample; it gives every
document a leaf and a place along the leaf's own axis.
"""

from __future__ import annotations

import numpy as np

DIMENSIONS = 48
#: The tree is learned from about so many documents; a leaf has at most LEAF_DOCS of them.
SAMPLE_DOCS = 4096
LEAF_DOCS = 64


class Tree:
    """Learned from the ids of sample documents; ``vocabulary`` is above every id."""

    def __init__(self, sample: list[np.ndarray], vocabulary: int = 1 << 16):
        df = np.zeros(vocabulary)
        for ids in sample:
            df[np.unique(ids)] += 1
        self.weight = np.log1p((len(sample) - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.leaves, self._made = 0, None
        x = self.vectors(sample)
        self.root = self._grow(x, np.arange(len(x)))

    def _axes(self) -> np.ndarray:
        if self._made is None:
            draw = np.random.Generator(np.random.PCG64(9))
            self._made = draw.standard_normal((len(self.weight), DIMENSIONS), dtype=np.float32) * self.weight[:, None]
        return self._made

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_made": None}

    def vectors(self, texts: list[np.ndarray]) -> np.ndarray:
        axes = self._axes()
        out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
        for i, ids in enumerate(texts):
            out[i] = axes[np.unique(ids)].sum(axis=0)
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))

    def _grow(self, x: np.ndarray, rows: np.ndarray) -> tuple:
        here = x[rows]
        axis = np.linalg.svd(here - here.mean(axis=0), full_matrices=False)[2][0] if len(rows) else np.zeros(DIMENSIONS, np.float32)
        along = here @ axis
        middle = np.median(along) if len(rows) else 0.0
        low = along < middle
        if len(rows) <= LEAF_DOCS or not low.any():
            self.leaves += 1
            return axis, self.leaves - 1
        return axis, middle, self._grow(x, rows[low]), self._grow(x, rows[~low])

    def places(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of every document and place in it."""
        x = self.vectors(texts)
        leaf, place = np.zeros(len(x), np.int64), np.zeros(len(x))
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            along = x[rows] @ node[0]
            if len(node) == 2:
                leaf[rows], place[rows] = node[1], along
            else:
                low = along < node[1]
                todo += [(node[2], rows[low]), (node[3], rows[~low])]
        return leaf, place
