"""Language-model scores by a weighted backoff automaton over smoothed bigrams.

States are word histories: a root that knows nothing, the start of a text, and one per known word.
A seen bigram is an arc that carries log10 P(w | h) = log10((c(hw) + MU * P(w)) / (c(h) + MU)); the
failure arc of h leads to the root and carries log10(MU / (c(h) + MU)); the root's arcs carry
log10 P(w) = log10((c(w) + 0.5) / (N + 0.5 * (V + 1))). The distribution of every state sums to one,
unknown words share one part. Texts are read once from left to right, all texts of a block in step.

The model grows with the corpus, so no machine holds it. Texts are dealt into blocks of bounded
size. Each block sends the distinct n-grams it holds with its own training counts; the tasks that
add these up answer a block only where other blocks counted the same n-gram, and the block then has
the part of the automaton that its texts can reach. n-grams are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.batches import as_batch, map_batches, texts
from factorloom.llm.words import lower_words
from factorloom.session import Scratch, shuffles_dropped

#: Weight of the lower order in words; see the README for how held-out texts fare under others.
MU = 1000.0
#: Characters of text in a block, and distinct words that the first pass gathers before it sends them on.
BLOCK_CHARS = 12_000_000
FLUSH_WORDS = 400_000
SENT = "part int, block int, keys binary, counts binary"
ANSWERED = "block int, keys binary, extra binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def is_held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text leaves 1 by 5; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 0)


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """64-bit numbers (of a rising row the steps) by byte place, where the shuffle's compression finds their empty bytes."""
    steps = np.diff(values, prepend=values.dtype.type(0)) if rising else values
    return steps.astype(values.dtype).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: bytes, kind: type, rising: bool = False) -> np.ndarray:
    values = np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(8, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit name of the bigram h w from the names of its words."""
    x = (h * np.uint64(0x9FB21C651E98DF25)) ^ (w + np.uint64(0x632BE59BD9B4E019) + (h >> np.uint64(29)))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def corpus_size(docs: DataFrame) -> tuple[int, int, int]:
    """(characters of all texts, N training tokens, V distinct training tokens); ends count as a token.

    Tasks send the names of the words that they met, once for each FLUSH_WORDS of them; a native
    distinct counts those, with partial aggregates, so no group grows with the vocabulary.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[bytes] = set()
        sums = np.zeros(3, np.int64)

        def flush() -> dict:
            keys = np.fromiter(map(word_key, seen), dtype=np.uint64, count=len(seen)).view(np.int64)
            row = {"keys": pa.array([keys], type=pa.list_(pa.int64())), **{c: sums[i : i + 1].copy() for i, c in enumerate(("chars", "tokens", "n_texts"))}}
            seen.clear()
            sums[:] = 0
            return row

        for batch in batches:
            for text, held in zip(texts(batch), batch.column("held_out").to_pylist(), strict=True):
                sums[0] += len(text)
                if not held:
                    words = lower_words(text)
                    seen.update(words)
                    sums[1:] += len(words) + 1, 1
                    if len(seen) > FLUSH_WORDS:
                        yield flush()
        yield flush()

    scratch = Scratch(docs.sparkSession, "lm-size")
    with shuffles_dropped(docs.sparkSession):
        found = scratch.keep(map_batches(docs, gather, "keys array<long>, chars long, tokens long, n_texts long"))
        got = found.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("chars", "tokens", "n_texts")]).first()
        distinct = found.select(F.explode("keys").alias("k")).distinct().count()
        scratch.drop(found)
    return int(got[0]), int(got[1]), distinct + (1 if got[2] else 0)


class Block:
    """The texts of a block as word numbers, with its n-grams, their hashes and its own training counts."""

    def __init__(self, rows_of_text, held):
        numbers: dict[bytes, int] = {}
        rows = []
        for text in rows_of_text:
            words = lower_words(text)
            rows.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int32, count=len(words)))
        self.n_words = n = len(numbers)
        # numbers: words, then the end n, then the start n + 1
        self.names = np.array([*map(word_key, numbers), int(END), int(START)], dtype=np.uint64)
        self.lengths = np.array([len(r) + 1 for r in rows], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.words = np.concatenate([x for r in rows for x in (r, np.array([n], np.int32))]) if rows else np.zeros(0, np.int32)
        del rows
        before = np.roll(self.words, 1).astype(np.int64)
        before[self.starts] = n + 1
        train = np.repeat(~np.asarray(held, dtype=bool), self.lengths)
        self.width = n + 2
        before *= self.width
        before += self.words
        pairs, at = np.unique(before, return_inverse=True)
        self.pairs, at = pairs, at.astype(np.int32)
        del before
        self.own_pairs = np.bincount(at[train], minlength=len(pairs))
        self.own_words = np.bincount(self.words[train], minlength=n + 2)
        self.own_words[n + 1] = int((~np.asarray(held, dtype=bool)).sum())
        self.pair_names = pair_key(self.names[pairs // self.width], self.names[pairs % self.width])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, own training counts) of all words and pairs of the block."""
        return np.concatenate([self.names, self.pair_names]), np.concatenate([self.own_words, self.own_pairs])

    def totals(self, keys: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts of words, counts of pairs) with what other blocks counted added; keys are sorted."""

        def add(names, own):
            if not len(keys):
                return own
            at = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
            return own + np.where(keys[at] == names, extra[at], 0)

        return add(self.names, self.own_words), add(self.pair_names, self.own_pairs)


class Automaton:
    """Root and history states with seen arcs, failure arcs and their weights (log10)."""

    def __init__(self, block: Block, word_counts: np.ndarray, pair_counts: np.ndarray, tokens: int, distinct: int, mu: float):
        self.width = block.width
        self.known = word_counts > 0
        self.known[-1] = True
        p = (word_counts + 0.5) / (tokens + 0.5 * (distinct + 1))
        self.root = np.log10(p)
        # histories that training never saw have no state of their own
        self.fail = np.log10(mu / (word_counts + mu))
        self.fail = np.append(np.where(word_counts > 0, self.fail, 0.0), 0.0)
        self.start, self.no_history = block.width - 1, block.width
        seen = pair_counts > 0
        self.arcs = block.pairs[seen]
        h, w = self.arcs // self.width, self.arcs % self.width
        self.weights = np.log10((pair_counts[seen] + mu * p[w]) / (word_counts[h] + mu))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes the arc of word where there is one, else fails to the root and takes the root's."""
        want = state * self.width + word
        if len(self.arcs):
            at = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)
            hit = (self.arcs[at] == want) & (state != self.no_history)
            gained = np.where(hit, self.weights[at], self.fail[state] + self.root[word])
        else:
            gained = self.fail[state] + self.root[word]
        return gained, np.where(self.known[word], word, self.no_history)

    def traverse(self, block: Block) -> np.ndarray:
        """log10 probability of each text, end included."""
        order = np.argsort(-block.lengths, kind="stable")
        starts, lengths = block.starts[order], block.lengths[order]
        left = len(order) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1)) if len(order) else []
        state, score = np.full(len(order), self.start), np.zeros(len(order))
        for t, n in enumerate(left):  # texts longer than t come first
            gained, state[:n] = self.step(state[:n], block.words[starts[:n] + t])
            score[:n] += gained
        out = np.empty(len(order))
        out[order] = score
        return out


def lm_scores(docs: DataFrame, held_out: Column | None = None, mu: float = MU, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text).

    Learns from the rows that are not held out and scores all. Null and empty texts are one token,
    the end. With nothing to learn from, every token is unknown. Repeated rows count as often as they
    come; other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (is_held_out(F.col("doc_id")) if held_out is None else held_out).alias("held_out"))
    chars, tokens, distinct = corpus_size(docs.select("text", "held_out"))
    blocks = max(1, -(-chars // block_chars))
    parts = 1 << max(0, (blocks - 1).bit_length())
    shift = np.uint64(64 - (parts.bit_length() - 1)) if parts > 1 else None
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        keys, own = Block(texts(rows), rows["held_out"].to_numpy()).keys()
        order = np.argsort(keys, kind="stable")
        keys, own = keys[order], own[order]
        part = (keys >> shift).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)
        some, first = np.unique(part, return_index=True)  # parts that the block has n-grams of, no others
        ends = np.append(first, len(keys))[1:]
        return pa.Table.from_batches([as_batch({
            "part": some, "block": np.full(len(some), key[0].as_py()),
            "keys": [pack(keys[i:j], True) for i, j in zip(first, ends, strict=True)], "counts": [pack(own[i:j]) for i, j in zip(first, ends, strict=True)],
        }, SENT)])

    def answer(key: tuple, sent: pa.Table) -> pa.Table:
        packed = sent["keys"].to_pylist()
        keys = np.concatenate([unpack(k, np.uint64, True) for k in packed])
        own = np.concatenate([unpack(c, np.int64) for c in sent["counts"].to_pylist()])
        block = np.repeat(sent["block"].to_numpy(), [len(k) // 8 for k in packed])
        del packed
        order = np.argsort(keys, kind="stable")
        keys, own, block = keys[order], own[order], block[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.repeat(np.add.reduceat(own, first), np.diff(np.append(first, len(keys))))
        more = total > own
        keys, extra, block = keys[more], (total - own)[more], block[more]
        order = np.argsort(block, kind="stable")
        keys, extra = keys[order], extra[order]
        names, first = np.unique(block[order], return_index=True)
        ends = np.append(first, len(keys))[1:]
        return pa.Table.from_batches([as_batch({
            "block": names, "keys": [pack(keys[i:j], True) for i, j in zip(first, ends, strict=True)], "extra": [pack(extra[i:j]) for i, j in zip(first, ends, strict=True)],
        }, ANSWERED)])

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts(rows), rows["held_out"].to_numpy())
        keys = np.concatenate([np.zeros(0, np.uint64), *[unpack(k, np.uint64, True) for k in answers["keys"].to_pylist()]])
        extra = np.concatenate([np.zeros(0, np.int64), *[unpack(x, np.int64) for x in answers["extra"].to_pylist()]])
        order = np.argsort(keys)
        words, pairs = block.totals(keys[order], extra[order])
        model = Automaton(block, words, pairs, tokens, distinct, mu)
        seen = words > 0
        doc = np.repeat(np.arange(len(rows)), block.lengths)
        return pa.Table.from_batches([as_batch({
            "doc_id": rows["doc_id"],
            "held_out": rows["held_out"],
            "n_tokens": block.lengths,
            "n_known": np.bincount(doc, weights=seen[block.words], minlength=len(rows)).astype(np.int64),
            "train_tokens": np.full(len(rows), tokens, np.int64),
            "base_score": np.bincount(doc, weights=model.root[block.words], minlength=len(rows)).astype(np.float64),
            "score": model.traverse(block),
        }, SCORED)])

    sent = dealt.groupBy("block").applyInArrow(count, SENT)
    answers = sent.groupBy("part").applyInArrow(answer, ANSWERED)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORED)
