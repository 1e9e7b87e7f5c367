"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie.

The best segmentation of a pre-token is the one with the greatest sum of piece scores. The best
score of a prefix does not depend on what follows, so pre-tokens go into a trie: each node keeps
its forward score and the number of tokens of its best path, made once when the node is made, and a
pre-token's count is stored at its terminal. Each task has a trie of the pre-tokens it meets and
starts a new one beyond MAX_NODES; pre-tokens of over LONG letters share no prefix worth keeping and go
through the same recurrence in a window as long as the longest piece. So memory is bounded whatever a
text holds, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.batches import map_batches, texts

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
MAX_NODES = 600_000
LONG = 2_000


def piece_scores(path: str) -> dict[str, float]:
    """Unigram scores of the pieces of a sentencepiece file: log of a Zipf weight of the rank that the file gives.

    Control, unknown and byte pieces are left out; bytes stand in for characters that no piece covers.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -log(rank + 2.0) for rank, i in enumerate(ranked)}


class CountTrie(dict):
    """pre-token -> number of tokens of its best segmentation (terminal counts)."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores
        self.longest = max(map(len, scores))
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        # which suffix lengths are worth trying for a last letter
        self.lengths: dict[str, tuple[int, ...]] = {}
        ends: dict[str, set[int]] = {}
        for piece in scores:
            ends.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: tuple(sorted(x)) for c, x in ends.items()}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]

    def long_count(self, word: str) -> int:
        """The count of one pre-token without nodes: scores and counts of the last prefixes only, in a ring."""
        ring, scores = self.longest + 1, self.scores
        score, tokens = [0.0] * ring, [0] * ring
        for end, letter in enumerate(word, 1):
            before = (end - 1) % ring
            best, count, single = float("-inf"), 0, False
            for length in self.lengths.get(letter, ()):
                if length > end:
                    break
                s = scores.get(word[end - length : end])
                if s is not None:
                    single = single or length == 1
                    at = (end - length) % ring
                    best, count = max((best, count), (s + score[at], tokens[at] + 1), key=lambda x: (x[0], -x[1]))
            if not single and (s := score[before] + self.unknown) > best:
                best, count = s, tokens[before] + len(letter.encode("utf-8", "replace"))
            score[end % ring], tokens[end % ring] = best, count
        return tokens[len(word) % ring]

    def __missing__(self, word: str) -> int:
        if len(word) > LONG:
            return self.long_count(word)
        if len(self.score) > MAX_NODES:
            self.reset()
        node, path = 0, [0]
        for end, letter in enumerate(word, 1):
            after = self.child.get((node, letter))
            if after is None:
                after = self.child[node, letter] = len(self.score)
                self._forward(word, end, letter, path)
            path.append(after)
            node = after
        self[word] = self.tokens[node]
        return self.tokens[node]

    def _forward(self, word: str, end: int, letter: str, path: list[int]) -> None:
        """Adds the node of word[:end]: its best last piece, the shorter count where scores tie."""
        scores, best, count, single = self.scores, float("-inf"), 0, False
        for length in self.lengths.get(letter, ()):
            if length > end:
                break
            s = scores.get(word[end - length : end])
            if s is not None:
                single = single or length == 1
                node = path[end - length]
                s += self.score[node]
                if s > best or s == best and self.tokens[node] + 1 < count:
                    best, count = s, self.tokens[node] + 1
        if not single:
            s = self.score[path[end - 1]] + self.unknown
            if s > best:
                best, count = s, self.tokens[path[end - 1]] + len(letter.encode("utf-8", "replace"))
        self.score.append(best)
        self.tokens.append(count)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_chars for each row of docs(doc_id, text), over whole texts.

    A pre-token is a run of characters outside [\\x20\\x09-\\x0D] with the mark of a space before it.
    Null and empty texts have no tokens; a pre-token of any length is walked once; other columns are
    ignored and repeated rows repeat.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        trie = CountTrie(piece_scores(path))
        for batch in batches:
            words, tokens, chars = [], [], []
            for text in texts(batch):
                found = [SPACE_MARK + w.decode("utf-8") for w in text.encode("utf-8", "replace").split()]
                words.append(len(found))
                tokens.append(sum(map(trie.__getitem__, found)))
                chars.append(len(text))
            yield {"doc_id": batch.column("doc_id"), "n_words": words, "n_tokens": tokens, "n_chars": chars}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count, "doc_id long, n_words long, n_tokens long, n_chars long")
