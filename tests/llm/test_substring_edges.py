import numpy as np

from martlib.llm import words as W
from martlib.llm.substrings import _edges


def test_an_edge_depends_on_every_word_of_its_stretch():
    """Anchors can lie 2 * node + 1 apart when a window is three nodes long."""
    node, a = 3, np.array([0])
    words = np.random.default_rng(1).integers(1, 1 << 62, 10).astype(np.uint64)
    for gap in range(1, 2 * node + 2):
        b = np.array([gap])
        edge = _edges(W.window_hashes(words, node), a, b, node)
        for i in range(gap + node):
            other = words.copy()
            other[i] += np.uint64(1)
            assert _edges(W.window_hashes(other, node), a, b, node) != edge, (gap, i)
