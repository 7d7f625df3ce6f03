"""Token counts by a unigram model, computed once for each distinct prefix of a word.

Distinct pre-tokens, words led by a mark, are inserted in a trie. A node holds the best score of any
segmentation of its prefix into pieces, and how many tokens that takes; a new node looks back along
its own path, so words with a common prefix share all work up to where they part. A word's count is
what its last node holds. The trie of a worker is bounded, and starts anew when it is full.
"""

from __future__ import annotations

import collections
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Nodes and words that a worker keeps before its trie starts anew; characters of the longest word that goes in the trie.
KEPT_NODES, KEPT_WORDS, LONG_WORD = 1_000_000, 1_000_000, 256
#: Log probability of each byte of a character that no piece has.
BYTE_SCORE = -20.0


def pieces(path: str) -> dict[str, float]:
    """The pieces of a public vocabulary file with log probabilities by Zipf's law over their rank: a tokenizer is never trained here."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(kind(i) for kind in kinds)]
    total = math.log(sum(1 / r for r in range(1, len(names) + 1)))
    return {name: -math.log(r) - total for r, name in enumerate(names, 1)}


class Trie(dict):
    """A word's token count by the word (its UTF-8 bytes)."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.next: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    def step(self, word: str, end: int, before: list[tuple[float, int]]) -> tuple[float, int]:
        """The best score of ``word[:end]`` and its tokens; ``before`` has those of the prefixes that are shorter by 1, 2, ... as far as pieces reach."""
        size = len(word[end - 1].encode())
        best, tokens = before[0][0] + size * BYTE_SCORE, before[0][1] + size
        for back, (found, count) in enumerate(before, 1):
            score = self.scores.get(word[end - back : end])
            if score is not None and (found + score > best or (found + score == best and count + 1 < tokens)):
                best, tokens = found + score, count + 1
        return best, tokens

    def node(self, path: list[int], word: str, end: int) -> int:
        """The new node of ``word[:end]``; ``path`` has the nodes of all shorter prefixes."""
        size, parent = len(word[end - 1].encode()), path[-1]
        best, tokens = self.best[parent] + size * BYTE_SCORE, self.tokens[parent] + size
        get = self.scores.get
        for begin in range(max(0, end - self.longest), end):
            score = get(word[begin:end])
            if score is not None:
                at = path[begin]
                found, count = self.best[at] + score, self.tokens[at] + 1
                if found > best or (found == best and count < tokens):
                    best, tokens = found, count
        self.best.append(best)
        self.tokens.append(tokens)
        self.next[path[-1] << 21 | ord(word[end - 1])] = made = len(self.best) - 1
        return made

    def alone(self, word: str) -> int:
        """The tokens of a word too long for the trie: the same steps, with as many prefixes kept as a piece is long."""
        last = collections.deque([(0.0, 0)], self.longest)
        for end in range(1, len(word) + 1):
            last.appendleft(self.step(word, end, last))
        return last[0][1]

    def __missing__(self, raw: bytes) -> int:
        if len(self.best) > KEPT_NODES or len(self) > KEPT_WORDS:
            self.start_anew()
        word, path = MARK + raw.decode(), [0]
        if len(word) > LONG_WORD:
            return self.alone(word)
        for end, c in enumerate(word, 1):
            at = path[-1]
            found = self.next.get(at << 21 | ord(c))
            path.append(self.node(path, word, end) if found is None else found)
        self[raw] = count = self.tokens[path[-1]]
        return count


def trie(path: str) -> Trie:
    return common.worker_table(("trie", path), lambda: Trie(pieces(path)))


def counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of every row of ``docs`` (doc_id, text).

    Words are runs of characters that are no ASCII white space. A null text has none. Of segmentations
    with the same score, one with fewest tokens counts. The scores are Zipf's law over ranks, so counts
    are no public tokenizer's. No shuffle, and no row needs another; a word longer than LONG_WORD is
    segmented outside the trie, in memory that doesn't grow with it. Other columns are ignored; rows
    that repeat stay; an empty table gives no row.
    """
    path = path or common.tokenizer_path("piece_bpe_32k.model")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = trie(path).__getitem__
        words = [(x or "").encode().split() for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array((sum(map(of, w)) for w in words), pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return common.map_texts(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"], "text", run, "doc_id long, n_words long, n_tokens long")
