"""Token counts where WORD_START is a piece by itself: against taking the longest piece each time."""

import random
import time

import pytest

from ampline.llm import token_counts
from ampline.llm.token_counts import WORD_START, Automaton, piece_vocabulary


def spelled(word, vocabulary):
    """Pieces of WORD_START and the word by taking the longest each time; 0 if it can't be spelled so."""
    n, rest = 0, WORD_START + word
    while rest:
        size = next((k for k in range(len(rest), 0, -1) if rest[:k] in vocabulary), 0)
        if not size:
            return 0
        rest, n = rest[size:], n + 1
    return n if word else 0


@pytest.mark.parametrize("long", [3, 128])
@pytest.mark.parametrize("alone", [True, False])
def test_lengths_are_those_of_the_longest_pieces(monkeypatch, alone, long):
    monkeypatch.setattr(token_counts, "LONG", long)
    rng = random.Random(6)
    say = lambda most: "".join(rng.choice("ab1東") for _ in range(rng.randint(1, most)))
    for _ in range(60):
        vocabulary = {say(4) for _ in range(8)} | {WORD_START + say(4) for _ in range(4)} | ({WORD_START} if alone else set())
        words = [say(9) for _ in range(80)] + [""]
        assert Automaton(sorted(vocabulary)).lengths(words).tolist() == [spelled(w, vocabulary) for w in words]


def test_digits_and_unspaced_scripts_are_spelled():
    vocabulary = piece_vocabulary()
    words = ["2024", "1999-2003", "3rd", "中国人民", "hello", ""]
    got = Automaton(vocabulary).lengths(words).tolist()
    assert got[:2] == [5, 10]
    assert got == [spelled(w, set(vocabulary)) for w in words]
    assert got[3] > 1


def test_a_very_long_word_is_read_in_time():
    automaton = Automaton(piece_vocabulary())
    word = "antidisestablishmentarianism2024" * 10_000
    start = time.perf_counter()
    got = automaton.lengths([word, "x", ""]).tolist()
    assert time.perf_counter() - start < 3
    assert got[0] > 50_000
    assert got[1:] == automaton.lengths(["x", ""]).tolist()


def test_odd_rows(spark):
    rows = [(1, None), (1, ""), (None, "x  y"), (1, "x y"), (2, "x" * 5000)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_words int")
    got = token_counts.token_counts(docs, [f"{WORD_START}x", "x", "xx"]).collect()
    assert sorted((r.n_words, r.n_tokens, r.n_unknown) for r in got) == [(0, 0, 0), (0, 0, 0), (1, 2501, 0), (2, 2, 1), (2, 2, 1)]
    assert got[0].__fields__ == ["doc_id", "n_words", "n_tokens", "n_unknown"]
