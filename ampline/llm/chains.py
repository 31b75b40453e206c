"""Chains of words run in step: dynamic programming over many texts at once, one word position after another.

A long text is cut into parts. What a part does to any state at its start is a small matrix, so the parts of a text are
first run side by side from every state, then joined by their matrices, and only then run with the states that hold.
Parts are ordered by length, so those that still have a word at position t are a prefix of the arrays. Steps are
the words of the longest part, memory a few numbers a word; nothing is padded.
"""

from __future__ import annotations

import numpy as np

#: Words of a part.
PART = 2048


class Lockstep:
    """Runs over the parts of chains; ``offsets`` are the chains' bounds."""

    def __init__(self, offsets: np.ndarray, part: int | None = None):
        part = part or PART
        chain_sizes = np.diff(offsets)
        cuts = np.maximum(-(-chain_sizes // part), 1)
        chain = np.repeat(np.arange(len(chain_sizes)), cuts)
        nth = np.arange(len(chain)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        starts = offsets[:-1][chain] + nth * part
        sizes = np.minimum(offsets[1:][chain] - starts, part)
        order = np.argsort(-sizes, kind="stable")
        self.starts, self.sizes, self.first = starts[order], sizes[order], nth[order] == 0
        self.steps = int(sizes.max(initial=0))
        #: parts with more than t words
        self.live = np.searchsorted(-self.sizes, -np.arange(self.steps), side="left")
        #: where the parts of each long chain stand, by their place in it: rows (chains that have such a part, the part, the part before)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        later = np.flatnonzero(nth)
        self.joins = [(place[x], place[x - 1]) for k in range(1, int(cuts.max(initial=1))) if len(x := later[nth[later] == k])]

    def forward(self):
        """(live parts, position of each one's t-th word) for t = 0, 1, ..."""
        for k, t in zip(self.live.tolist(), range(self.steps), strict=True):
            yield k, self.starts[:k] + t

    def backward(self):
        """(live parts, live parts one word later, position of each one's t-th word) for t = last, ..., 0."""
        later = 0
        for k, t in zip(self.live[::-1].tolist(), range(self.steps - 1, -1, -1), strict=True):
            yield k, later, self.starts[:k] + t
            later = k


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word where a change of label costs ``penalty``; ties go to the lower label and to no change."""
    n, labels = scores.shape
    run = Lockstep(offsets)
    best = np.zeros((len(run.starts), labels))
    if run.joins:
        # through[p, a, b]: the best score of part p that ends in label b, if the word before it had label a; what
        # another part follows is as long as a part can be, and so comes first
        whole = int(run.live[-1])
        through = np.zeros((whole, labels, labels))
        through[~run.first[:whole]] = np.where(np.eye(labels, dtype=bool), 0, -np.inf)
        for t, (_, at) in enumerate(run.forward()):
            switched = np.maximum(through, through.max(2, keepdims=True) - penalty)
            through = (switched if t else np.where(run.first[:whole, None, None], through, switched)) + scores[at[:whole]][:, None, :]
        for at, before in run.joins:
            entry = np.where(run.first[before, None], through[before, 0], (best[before][:, :, None] + through[before]).max(1))
            best[at] = entry - entry.max(1, keepdims=True)
    came, stayed = np.zeros(n, np.int16), np.ones((n, labels), bool)
    entering = ~run.first
    for t, (k, at) in enumerate(run.forward()):
        now = best[:k]
        moves = np.ones(k, bool) if t else entering[:k]
        top = now.argmax(1)
        switch = (now[np.arange(k), top] - penalty)[:, None]
        came[at], stayed[at] = top, (now >= switch) | ~moves[:, None]
        now = np.where(moves[:, None], np.maximum(now, switch), now)
        best[:k] = now - now.max(1, keepdims=True) + scores[at]
    last = best.argmax(1)
    if run.joins:
        # back[p, b]: the label of the word before part p if the part ends in label b
        back = np.tile(np.arange(labels), (len(run.starts), 1))
        for k, _, at in run.backward():
            now = back[:k]
            back[:k] = np.where(np.take_along_axis(stayed[at], now, 1), now, came[at][:, None])
        for at, before in reversed(run.joins):
            last[before] = back[at, last[at]]
    out, label = np.zeros(n, np.int16), last.astype(np.int16)
    for _, later, at in run.backward():
        if later:
            after = at[:later] + 1
            label[:later] = np.where(stayed[after, label[:later]], label[:later], came[after])
        out[at] = label[: len(at)]
    return out


def chain_odds(lead: np.ndarray, offsets: np.ndarray, start: float, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains of two labels, as odds of label 1 over label 0 at each word.

    lead: score of label 1 over label 0 of each word; start: of the first label; change[a, b]: score of label b after a.
    Returns the odds given the words so far, and the ratio of the likelihoods of the words to come; their product is
    the odds given all words.
    """
    run, weight = Lockstep(offsets), np.exp(np.clip(lead, -30, 30))
    step = np.exp(change)
    ahead, back = np.zeros(len(lead)), np.ones(len(lead))
    odds, ratio = np.full(len(run.starts), np.exp(start)), np.ones(len(run.starts))
    if run.joins:
        # through[p]: the product of transitions and words of part p; a first part starts with its word alone
        through = np.tile(np.eye(2), (len(run.starts), 1, 1))
        for t, (k, at) in enumerate(run.forward()):
            now = through[:k] @ step
            if not t:
                now[run.first[:k]] = np.eye(2)
            now[:, :, 1] *= weight[at][:, None]
            through[:k] = now / now.max((1, 2), keepdims=True)
        for at, before in run.joins:
            came = odds[before]
            m = through[before]
            odds[at] = (m[:, 0, 1] + came * m[:, 1, 1]) / (m[:, 0, 0] + came * m[:, 1, 0])
        for at, before in reversed(run.joins):
            m, after = through[at], ratio[at]
            ratio[before] = (m[:, 1, 0] + m[:, 1, 1] * after) / (m[:, 0, 0] + m[:, 0, 1] * after)
    bounded = lambda x: np.minimum(np.maximum(x, 1e-12), 1e12)
    entering = ~run.first
    for t, (k, at) in enumerate(run.forward()):
        before = odds[:k]
        moved = (step[0, 1] + before * step[1, 1]) / (step[0, 0] + before * step[1, 0])
        odds[:k] = bounded(weight[at] * (moved if t else np.where(entering[:k], moved, before)))
        ahead[at] = odds[:k]
    for _, later, at in run.backward():
        if later:
            after = ratio[:later] * weight[at[:later] + 1]
            ratio[:later] = bounded((step[1, 0] + step[1, 1] * after) / (step[0, 0] + step[0, 1] * after))
        back[at] = ratio[: len(at)]
    return ahead, back


def hashed_grams(words: list[str], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of every character n-gram of the lower-cased words with a space on each side."""
    padded = [f" {w.lower()} " for w in words]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(padded)), sizes)
    owners, hashes = [], []
    for n in orders:
        if len(chars) < n:
            continue
        k = len(chars) - n + 1
        h = np.full(k, n, np.uint64)
        for i in range(n):
            h = (h ^ chars[i : i + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = word[:k] == word[n - 1 :]
        owners.append(word[:k][whole])
        hashes.append((h[whole] >> np.uint64(64 - bits)).astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(hashes)
