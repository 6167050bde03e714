"""Encoding of a corpus with a public byte-level BPE tokenizer, by a pair occurrence index.

The distinct pretokens of a batch lie in one linked array of symbols. An index maps each mergeable pair to all positions
at which it stands; ranks that have positions are applied in ascending order, each to all its positions at once, and
only the pairs beside a merged position are looked up anew. A merge can only create pairs of higher rank, so one
ascending sweep gives what merging each word by itself gives.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caddis.session import filled

#: Where the public tokenizers' files are.
TOKENIZERS = os.environ.get("CADDIS_TOKENIZERS", "/opt/tokenizers")
#: Characters encoded at once; texts are never cut, so a batch ends with the text that reaches it.
BATCH_CHARS = 6_000_000
#: Bytes of distinct pretokens kept encoded between batches; beyond it the memory starts afresh.
KEPT_BYTES = 32_000_000
# Fixed value: the pretoken pattern of the vocabulary, with White_Space written out.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in the vocabulary file: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Byte ids and ranked merges of a byte-level BPE vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, letters = model["vocab"], _byte_letters()
        self.byte_id = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.byte_id[byte] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)].copy()
        n = len(symbols)
        if not n:
            return symbols, lengths
        ends = np.cumsum(lengths)
        after = np.arange(1, n + 1, dtype=np.int64)
        after[ends[lengths > 0] - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int64)
        starts = (ends - lengths)[lengths > 0]
        before[starts] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enters the pairs that start at these positions into the index."""
            ranks = self.rank(symbols[at], symbols[after[at]])
            known = ranks >= 0
            if not known.all():
                at, ranks = at[known], ranks[known]
            if not len(at):
                return
            if len(at) == 1 or (ranks[0] == ranks).all():
                groups = [(int(ranks[0]), at)]
            else:
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                groups = zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts))
            for r, positions in groups:
                held = index.get(r)
                if held is None:
                    index[r] = [positions]
                    heapq.heappush(heap, r)
                else:
                    held.append(positions)

        note(np.flatnonzero(after >= 0))
        while heap:
            rank = heapq.heappop(heap)
            held = index.pop(rank)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            a, b, new = self.left[rank], self.right[rank], self.merged[rank]
            ok = alive[at] & (symbols[at] == a)
            at = at[ok]
            following = after[at]
            ok = following >= 0
            ok &= symbols[following] == b
            at, following = at[ok], following[ok]
            if not len(at):
                continue
            if a == b:  # of overlapping pairs the leftmost ones merge
                order = np.argsort(at)
                at, following = at[order], following[order]
                chained = np.zeros(len(at), bool)
                chained[1:] = following[:-1] == at[1:]
                if chained.any():
                    run = np.flatnonzero(~chained)
                    place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                    keep = place % 2 == 0
                    at, following = at[keep], following[keep]
            symbols[at] = new
            alive[following] = False
            beyond = after[following]
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            previous = before[at]
            previous = previous[previous >= 0]
            fresh = previous[symbols[previous] != new]  # one that was itself merged just now enters as `at`
            at = at[after[at] >= 0]
            if len(fresh):
                note(fresh)
            if len(at):
                note(at)
        counts = np.zeros(len(words), np.int64)
        some = lengths > 0
        counts[some] = np.add.reduceat(alive.astype(np.int64), starts)
        return symbols[alive], counts


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts, keeping the ids of pretokens it has met."""

    def __init__(self, path: str):
        import regex

        self.vocabulary, self.find = vocabulary(path), regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.counts, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts in them)."""
        if self.size > KEPT_BYTES:
            self._forget()
        known, find, first = self.known, self.find, len(self.known)
        words: list[int] = []
        lengths = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            before = len(words)
            words.extend([known.setdefault(w, len(known)) for w in find(text)])
            lengths[i] = len(words) - before
        new = [w.encode("utf-8", "replace") for w in list(known)[first:]]
        if new:
            ids, counts = self.vocabulary.encode_words(new)
            self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
            self.size += sum(map(len, new))
        index = np.array(words, np.int64)
        starts = np.cumsum(self.counts) - self.counts
        counts = self.counts[index]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(starts[index] - (ends - counts), counts) + np.arange(total)
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths)))]
        return self.ids[take], bounds


def _encoded(df: DataFrame, key: str, text: str, path: str, counts_only: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            lengths = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0), dtype=np.int64))
            at = 0
            while at < batch.num_rows:
                base = lengths[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(lengths, base + BATCH_CHARS, side="right")))
                part = batch.slice(at, to - at)
                at = to
                ids, bounds = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                result = pa.array(np.diff(bounds).astype(np.int32)) if counts_only else pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), result], ["id", "result"])

    kind = df.schema[key].dataType.simpleString()
    out = filled(df.select(F.col(key), F.col(text).cast("string"))).mapInArrow(run, f"id {kind}, result {'int' if counts_only else 'array<int>'}")
    return out.select(F.col("id").alias(key), F.col("result").alias("tokens" if counts_only else "ids"))


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's text, without special tokens.

    A null text and an empty text both have the ids ``[]``; special tokens' strings are ordinary text. Every row gives
    one row, repeated keys and null keys too; other columns are ignored; an empty table gives no rows. Texts are
    encoded whole, whatever their length. The vocabulary file must lie at ``path`` on every executor. Each
    partition is encoded where it is read, without a shuffle unless there are fewer partitions than cores.
    """
    return _encoded(df, key, text, path or f"{TOKENIZERS}/byte_bpe_50k.json", False)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, tokens): the number of token ids of each row's text; 0 for null and empty texts."""
    return _encoded(df, key, text, path or f"{TOKENIZERS}/byte_bpe_50k.json", True)
