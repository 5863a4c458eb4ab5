"""Pieces are looked for no further back than some piece's ending goes, and the best segmentation is still found."""
import random

from measurekit.llm.token_counts import MARK, Trie


class Counted(dict):
    asked = 0

    def get(self, *a):
        Counted.asked += 1
        return super().get(*a)


def plain(scores, floor, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + width * floor, best[end - 1][1] - width)]
        ways += [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores]
        best.append(max(ways))
    return -best[-1][1]


def test_counts_equal_plain_segmentation():
    rng = random.Random(2)
    for _ in range(60):
        scores = {"".join(rng.choice("abé" + MARK) for _ in range(rng.randint(1, 4))): -rng.choice([0, 0, 1, 2, 3.5]) for _ in range(12)}
        trie = Trie(scores)
        for _ in range(10):
            word = "".join(rng.choice("abéz") for _ in range(rng.randint(1, 80)))
            assert trie.count(word.encode()) == plain(scores, trie.floor, MARK + word)


def test_a_search_ends_where_no_piece_goes_on():
    trie = Trie({"a": -1.0, "ba": -1.5, "c" * 20: -2.0})
    trie.endings = Counted(trie.endings)
    assert trie.count(b"dadadada") == 9 + 2      # the mark has three bytes
    assert Counted.asked <= 2 * 9
