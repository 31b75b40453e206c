"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces need not be built to be counted. The vocabulary's trie has, for each node, a failure
link and the number of pieces that are popped when it is followed; a word is read once, character by character. The
driver builds the automaton from the vocabulary and broadcasts its arrays, whose size the vocabulary bounds. Tasks
run all distinct words of a text slice through it in step, and add up the words of each text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ampline.llm.common import slices, sums_between, table, words_of

WORD_START = "▁"
#: Node ids: the roots of first and of later pieces; no node.
FIRST, LATER, NONE = 0, 1, -1
#: Characters beyond which words are read one by one, as few are that long.
LONG = 128


def piece_vocabulary(path: str | None = None) -> list[str]:
    """Pieces of a sentencepiece model; those that start a word carry WORD_START. Control and byte pieces are left out."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in odd)]


class Automaton:
    """keys (node << 21 | character, sorted) lead to ``target``; ``fail`` and ``popped`` are by node."""

    def __init__(self, vocabulary: Iterable[str]):
        edges: dict[tuple[int, str], int] = {}
        is_piece, above = [False, False], [(NONE, ""), (NONE, "")]
        alone = False  # whether WORD_START is a piece by itself, which the later pieces may follow
        for piece in vocabulary:
            node, rest = (FIRST, piece[1:]) if piece.startswith(WORD_START) else (LATER, piece)
            if not rest:
                alone |= node == FIRST
                continue
            for c in rest:
                if (node, c) not in edges:
                    edges[node, c] = len(is_piece)
                    is_piece.append(False)
                    above.append((node, c))
                node = edges[node, c]
            is_piece[node] = True
        below: list[list[int]] = [[] for _ in is_piece]
        for node, (parent, _) in enumerate(above):
            if parent != NONE:
                below[parent].append(node)
        fail, popped = [NONE] * len(is_piece), [0] * len(is_piece)
        if alone:
            fail[FIRST], popped[FIRST] = LATER, 1
        todo = deque(below[FIRST] + below[LATER])
        while todo:  # breadth first: links lead to nodes of lesser depth
            node = todo.popleft()
            todo.extend(below[node])
            parent, c = above[node]
            if is_piece[node]:
                fail[node], popped[node] = LATER, 1
                continue
            link, count = fail[parent], popped[parent]
            while link != NONE and (link, c) not in edges:
                link, count = fail[link], count + popped[link]
            if link != NONE:
                fail[node], popped[node] = edges[link, c], count
        keys = np.array([node << 21 | ord(c) for node, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.target = keys[order], np.fromiter(edges.values(), np.int32, len(edges))[order]
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        #: the same as dict and list, once a long word asks for them
        self.edges: dict[int, int] | None = None

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.target[at], NONE)

    def lengths(self, words: list[str]) -> np.ndarray:
        """Pieces of each word; 0 for a word that the vocabulary can't spell, as for an empty one."""
        if not len(self.keys) or not words:
            return np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if len(long := np.flatnonzero(sizes > LONG)):
            out = self.lengths(["" if n > LONG else w for w, n in zip(words, sizes.tolist(), strict=True)])
            out[long] = [self.length(words[k]) for k in long.tolist()]
            return out
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        longest_first = sizes[order]
        node, count = np.full(len(words), FIRST, np.int32), np.zeros(len(words), np.int64)
        for t in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(node[: np.searchsorted(-longest_first, -t, side="left")] != NONE)
            while len(live):
                there = self.step(node[live], chars[starts[live] + t])
                ok = there != NONE
                node[live[ok]] = there[ok]
                live = live[~ok]
                count[live] += self.popped[node[live]]
                node[live] = self.fail[node[live]]
                live = live[node[live] != NONE]
        live = np.flatnonzero((node != NONE) & (node != LATER))
        while len(live):  # at the word's end
            count[live] += self.popped[node[live]]
            node[live] = self.fail[node[live]]
            live = live[(node[live] != NONE) & (node[live] != LATER)]
        out = np.zeros(len(words), np.int64)
        out[order] = np.where((node == LATER) & (longest_first > 0), count, 0)
        return out


    def length(self, word: str) -> int:
        """As lengths, of one word."""
        if self.edges is None:
            self.edges = dict(zip(self.keys.tolist(), self.target.tolist(), strict=True))
            self.links = list(zip(self.fail.tolist(), self.popped.tolist(), strict=True))
        edges, links, node, count = self.edges, self.links, FIRST, 0
        for c in map(ord, word):
            while (there := edges.get(node << 21 | c)) is None:
                node, more = links[node]
                if node == NONE:
                    return 0
                count += more
            node = there
        while node not in (LATER, NONE):  # at the word's end
            node, more = links[node]
            count += more
        return count if node == LATER else 0


def _count(automaton) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(batches):
        for batch in slices(batches, "text"):
            offsets, codes, vocab = words_of(batch.column("text"))
            size = automaton.value.lengths(vocab)
            unknown = (size == 0).astype(np.int64)
            columns = [np.diff(offsets), sums_between((size + unknown)[codes], offsets), sums_between(unknown[codes], offsets)]
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, columns)], schema=schema)

    return run


def token_counts(docs: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens, n_unknown.

    Words are runs of characters other than ASCII white space; case and punctuation stay. A word that no piece with
    WORD_START begins has WORD_START as its first piece, where that is in the vocabulary. A word that the vocabulary
    can't spell counts as one unknown token. Null and empty texts have 0 of each; an empty table gives no rows;
    repeated rows and null ids give a row each; further columns are ignored.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(piece_vocabulary() if vocabulary is None else vocabulary))
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_count(automaton), "doc_id long, n_words long, n_tokens long, n_unknown long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
