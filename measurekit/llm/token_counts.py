"""Token counts under a unigram model by trie-shared dynamic programming.

Distinct pre-tokens (words, with the mark of a leading space) go into a trie. Every node holds the
forward score of its prefix, the best sum of piece scores over all segmentations, and that
segmentation's number of pieces; it is computed once from its ancestors, so words that share a
prefix share its work. A terminal's count is then read for every occurrence. Each task grows its
own trie from the documents it reads, up to a bound of nodes, so nothing is shuffled or broadcast.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
MAX_NODES = 1_000_000   # nodes of a task's trie; beyond it a new one is begun
LONG_WORD = 64          # longer words are scored the same way, but leave no nodes


def piece_scores(vocabulary: str = VOCABULARY) -> dict[str, float]:
    """Log probabilities of the pieces: the file ranks them, Zipf's law gives rank its frequency."""
    import public_tokenizers as public
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=public.path(vocabulary))
    usable = [i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    usable.sort(key=lambda i: (-model.get_score(i), i))
    norm = math.log(sum(1 / (r + 1) for r in range(len(usable))))
    return {model.id_to_piece(i): -math.log(r + 1) - norm for r, i in enumerate(usable)}


class Trie:
    """Forward scores by prefix. An unknown character is one token per UTF-8 byte, at ``floor`` each."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        self.scores, self.max_nodes = scores, max_nodes
        self.longest = max(map(len, scores))
        self.floor = min(scores.values()) - 10.0
        # every ending of a piece, with the score of those that are pieces: a piece is looked for no further back than these go
        self.endings: dict[str, float | None] = {p[i:]: None for p in scores for i in range(1, len(p))} | scores
        self.clear()

    def clear(self) -> None:
        self.root: dict = {}
        self.nodes = 0
        self.terminal: dict[bytes, int] = {}

    def step(self, word: str, end: int, forward: list[tuple[float, int]]) -> tuple[float, int]:
        """Best ``(score, -tokens)`` of ``word[:end]``; equal scores prefer fewer tokens."""
        width = 1 if word[end - 1] < "\x80" else len(word[end - 1].encode())
        score, tokens = forward[end - 1]
        score, tokens = score + width * self.floor, tokens - width
        endings = self.endings
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            s = endings.get(word[start:end], 0)
            if s == 0 and word[start:end] not in endings:
                break
            if s is not None:
                before, fewer = forward[start]
                if (total := before + s) > score or (total == score and fewer - 1 > tokens):
                    score, tokens = total, fewer - 1
        return score, tokens

    def count(self, raw: bytes) -> int:
        """Tokens of a word, its leading mark included."""
        known = self.terminal.get(raw)
        if known is not None:
            return known
        if self.nodes > self.max_nodes or len(self.terminal) > self.max_nodes:
            self.clear()
        word = MARK + raw.decode()
        forward, keep, node, state = [(0.0, 0)], len(word) <= LONG_WORD, self.root, None
        for end in range(1, len(word) + 1):
            below = node.get(word[end - 1]) if keep else None
            if below is None:
                state = self.step(word, end, forward)
                if keep:
                    node[word[end - 1]] = below = {"": state}
                    self.nodes += 1
            forward.append(below[""] if keep else state)
            if keep:
                node = below
            elif end > self.longest:
                forward[end - self.longest - 1] = None   # out of every piece's reach
        tokens = -forward[-1][1]
        if keep:
            self.terminal[raw] = tokens
        return tokens


def count_tokens(docs: DataFrame, text: str = "text", name: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with a struct ``name``: ``n_words, n_tokens`` of the whole text.

    Pre-tokens are the words of the text, each with a leading mark, as the vocabulary has it.
    Null and empty texts have no words and no tokens. Rows are counted one by one.
    """
    @F.arrow_udf("struct<n_words long, n_tokens long>")
    def counted(texts: pa.Array) -> pa.Array:
        trie = _trie(vocabulary)
        own = [(t or "").encode().split() for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(map(len, own), pa.int64()), pa.array((sum(map(trie.count, w)) for w in own), pa.int64())],
                                          ["n_words", "n_tokens"])

    t, = fresh([*docs.columns, name], "_text")
    return docs.withColumn(t, F.col(text)).withColumn(name, counted(t)).drop(t)


_TRIES: dict[str, Trie] = {}


def _trie(vocabulary: str) -> Trie:
    """The task's trie: it lives as long as the function that travelled to the task."""
    if vocabulary not in _TRIES:
        _TRIES[vocabulary] = Trie(piece_scores(vocabulary))
    return _TRIES[vocabulary]
