"""An Aho-Corasick automaton over word numbers, in arrays, that scans many texts at a time.

The keys are windows of the items' words, whole items where they are shorter. Nodes are prefixes of
keys, numbered level by level in the order of their words. An edge is one number, node times
vocabulary plus word; in that numbering the edges are sorted as they come, and the k-th leads to the
k-th node below the first level. A node takes 16 bytes. Texts are one stream of word numbers in
which 0, a word of no key, leads back to the root. The stream is read in lanes of equal length side
by side; a lane starts as many words early as the longest key has before its last word, and
reports the matches that end in its own part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Words of a lane.
LANE = 192


@dataclass
class WordAutomaton:
    vocabulary: dict[bytes, int]  # from 1
    first: np.ndarray  # node that each word leads to from the root, 0 for none
    edges: np.ndarray  # node * (words + 1) + word of all other edges, sorted
    fail: np.ndarray  # the longest proper suffix that is a node
    hit: np.ndarray  # the node itself or its longest suffix where a key ends, 0 for none
    levels: np.ndarray  # first node of each level
    ends: np.ndarray  # nodes where a key ends, once for each owner, sorted
    owners: np.ndarray  # who holds the key

    @property
    def longest(self) -> int:
        return len(self.levels) - 2

    def sizes(self, nodes: np.ndarray) -> np.ndarray:
        """Words of the prefixes that nodes stand for."""
        return np.searchsorted(self.levels, nodes, side="right") - 1

    def owned(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``nodes``, owner), a pair for each owner of the key that ends at each node."""
        low, high = np.searchsorted(self.ends, nodes), np.searchsorted(self.ends, nodes, side="right")
        n = high - low
        at = np.repeat(np.arange(len(nodes)), n)
        return at, self.owners[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _step(a: WordAutomaton, state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The states that these words lead to."""
    out = a.first[words]
    if not len(a.edges):
        return out
    width = len(a.first)
    open_ = np.flatnonzero((state > 0) & (words > 0))
    at = state[open_]
    while len(open_):
        keys = at * width + words[open_]
        place = np.minimum(np.searchsorted(a.edges, keys), len(a.edges) - 1)
        done = a.edges[place] == keys
        out[open_[done]] = a.levels[2] + place[done]
        at = a.fail[at[~done]].astype(np.int64)
        open_ = open_[~done][at > 0]
        at = at[at > 0]
    return out


def build(items: list[tuple[list[bytes], int]], window: int) -> WordAutomaton:
    """An automaton over the windows of (words, owner); repeated items count once."""
    vocabulary: dict[bytes, int] = {}
    tables, owners = [], []
    for words, owner in items:
        if words:
            numbers = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32)
            rows = np.zeros((max(1, len(numbers) - window + 1), window), np.int32)
            if len(numbers) < window:
                rows[0, : len(numbers)] = numbers
            else:
                rows[:] = np.lib.stride_tricks.sliding_window_view(numbers, window)
            tables.append(rows)
            owners.append(np.full(len(rows), owner))
    table = np.concatenate(tables) if tables else np.zeros((0, window), np.int32)
    owner_of = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.lexsort(table.T[::-1])
    table, owner_of = table[order], owner_of[order]
    lengths = (table > 0).sum(axis=1)
    width = len(vocabulary) + 1
    a = WordAutomaton(vocabulary, np.zeros(width, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    levels = [0, 1]
    at, fresh = np.zeros(len(table), np.int64), np.zeros(len(table), bool)
    fresh[:1] = True
    terminal = [np.zeros(1, bool)]
    for k in range(int(lengths.max(initial=0))):
        fresh[1:] |= table[1:, k] != table[:-1, k]
        held = lengths > k
        new = np.flatnonzero(fresh & held)
        parents, words = at[new], table[new, k].astype(np.int64)
        a.levels = np.array(levels)
        if k == 0:
            a.first[words] = levels[-1] + np.arange(len(new))
            down = np.zeros(len(new), np.int64)
        else:  # a child fails to where its parent's failure goes with the same word
            down = _step(a, a.fail[parents].astype(np.int64), words)
            a.edges = np.concatenate([a.edges, parents * width + words])
        a.fail = np.concatenate([a.fail, down.astype(np.int32)])
        at[held] = (levels[-1] - 1 + np.cumsum(fresh & held))[held]
        levels.append(levels[-1] + len(new))
        ends = np.zeros(len(new), bool)
        ends[at[lengths == k + 1] - levels[-2]] = True
        terminal.append(ends)
    a.levels = np.array(levels)
    a.hit = np.zeros(levels[-1], np.int32)
    for low, high, ends in zip(levels[1:], levels[2:], terminal[1:], strict=False):  # shorter suffixes come first
        nodes = np.arange(low, high)
        a.hit[low:high] = np.where(ends, nodes, a.hit[a.fail[low:high]])
    pairs = np.unique(np.stack([at, owner_of], axis=1), axis=0)
    a.ends, a.owners = pairs[:, 0].copy(), pairs[:, 1].copy()
    return a


def _long_runs(stream: np.ndarray, least: int) -> np.ndarray:
    """The stream without its runs of known words that are shorter than any key."""
    edge = np.diff(np.concatenate([[0], (stream > 0).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    long_ = ends - starts >= least
    marks = np.zeros(len(stream) + 1, np.int8)
    marks[starts[long_]] += 1
    marks[ends[long_]] -= 1
    return np.where(np.cumsum(marks[:-1]) > 0, stream, 0)


def scan(a: WordAutomaton, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the stream of last words, nodes) of every key that ends there, in no order."""
    warm = max(0, a.longest - 1)
    if a.longest < 1 or not len(stream):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stream = _long_runs(stream, int(a.sizes(a.ends).min()))
    lanes = -(-len(stream) // LANE)
    padded = np.zeros(warm + lanes * LANE, np.int64)
    padded[warm : warm + len(stream)] = stream
    # lanes without a known word are not read
    live = np.flatnonzero(np.add.reduceat(padded[warm:] > 0, np.arange(lanes) * LANE))
    starts = live * LANE
    state = np.zeros(len(live), np.int64)
    places, nodes = [], []
    for step in range(warm + LANE):
        state = _step(a, state, padded[starts + step])
        if step >= warm:
            ends = a.hit[state]
            at = np.flatnonzero(ends)
            while len(at):
                found = ends[at].astype(np.int64)
                places.append(starts[at] + step - warm)
                nodes.append(found)
                ends[at] = a.hit[a.fail[found]]
                at = at[ends[at] > 0]
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(nodes)
