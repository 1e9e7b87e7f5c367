"""Byte-pair encoding with a contiguous rank array per word, and decoding.

A word is an array of part ids with the rank of each adjacent pair beside it. The smallest rank is
looked for, the boundary after it goes, and the ranks on either side are looked up again, until no
adjacent pair has a rank. Words repeat, so a task keeps the ids of those it has met, up to a bound
beyond which it starts over; results do not depend on that. There is no shuffle at all.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.batches import map_batches, texts

NO_RANK = 1 << 60
CACHE_WORDS = 300_000
#: The pre-tokenizer's pattern and the white space it knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = r"[\t-\r \x85\xa0  -     　]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes for themselves, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe(dict):
    """word -> (its ids as little-endian unsigned 32-bit integers, its tokens joined by spaces)."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        for t, i in self.special.items():
            self.names[i] = t
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.cut_words = regex.compile(PATTERN.replace(r"\s", SPACES[1:-2]))
        self.spaces = regex.compile(SPACES)

    def parts(self, word: str) -> list[int]:
        """Ids of one pre-token by the rank array."""
        letters = [self.letters[b] for b in word.encode("utf-8")]
        letters[-1] += self.suffix
        ids = [self.vocab[x] for x in letters]
        pairs = self.pairs
        ranks = [pairs.get(p, (NO_RANK,))[0] for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            ids[at] = pairs[ids[at], ids[at + 1]][1]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = pairs.get((ids[at], ids[at + 1]), (NO_RANK,))[0]
            if at:
                ranks[at - 1] = pairs.get((ids[at - 1], ids[at]), (NO_RANK,))[0]
        return ids

    def __missing__(self, word: str) -> tuple[bytes, str]:
        ids = self.parts(word) if len(word) < 400 else self.long_parts(word)
        made = pack(f"<{len(ids)}I", *ids), " ".join(map(self.names.__getitem__, ids))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = made
        return made

    def long_parts(self, word: str) -> list[int]:
        """The same merges for words of any length: places of each rank in a heap, neighbours in linked lists."""
        from heapq import heapify, heappop, heappush

        letters = [self.letters[b] for b in word.encode("utf-8")]
        letters[-1] += self.suffix
        ids, n = [self.vocab[x] for x in letters], len(letters)
        after, before, pairs = [*range(1, n), -1], [-1, *range(n - 1)], self.pairs
        heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = pairs[pair][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) >= 0 and (p := (ids[a], ids[b])) in pairs:
                    heappush(heap, (pairs[p][0], a, p))
        return [x for x in ids if x >= 0]

    def words(self, piece: str) -> list[str]:
        """Pre-tokens of text without special tokens: composed, spaces folded, each letter lower-cased alone."""
        from unicodedata import normalize

        piece = piece if piece.isascii() else normalize("NFC", piece)
        # lower() looks at a final sigma's neighbours, the library does not
        return self.cut_words.findall(self.spaces.sub(" ", piece).replace("Σ", "σ").lower())

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids, decoded text)."""
        found = []
        for piece in self.cut_special.split(text) if any(t in text for t in self.special) else [text]:
            if piece in self.special:
                found.append((pack("<I", self.special[piece]), piece))
            elif piece:
                found.extend(map(self.__getitem__, self.words(piece)))
        return b"".join([a for a, _ in found]), " ".join([b for _, b in found])


def bpe_codes(docs: DataFrame, path: str, keep_ids: bool = False, carry: dict | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and, with keep_ids, ids and decoded) for each row of docs(doc_id, text).

    path: the tokenizer's file, readable on every executor. A null text counts as empty: no tokens,
    the digests of nothing. Rows that repeat repeat in the result, null ids stay null. Columns in carry
    (name -> type) pass through, others are ignored.
    """
    carry = carry or {}
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if keep_ids else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = WordBpe(path)
        for batch in batches:
            made = [bpe.encode(t) for t in texts(batch)]
            out = {
                **{c: batch.column(c) for c in carry},
                "doc_id": batch.column("doc_id"),
                "n_tokens": [len(a) // 4 for a, _ in made],
                "ids_sha256": [hashlib.sha256(a).hexdigest() for a, _ in made],
                "decoded_sha256": [hashlib.sha256(b.encode("utf-8")).hexdigest() for _, b in made],
            }
            if keep_ids:
                out |= {"ids": [list(memoryview(a).cast("I")) for a, _ in made], "decoded": [b for _, b in made]}
            yield out

    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`").cast(k).alias(c) for c, k in carry.items()]]
    return map_batches(docs.select(*columns), encode, schema + "".join(f", {c} {k}" for c, k in carry.items()))
