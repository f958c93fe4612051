"""SentencePiece encoding and decoding (operator 2) by a merge-type prefix table.

The encoding of a prefix is a prefix of token sequences: every prefix of a chunk has
one last token, the one that matches at its end and is compatible with the last token
of the prefix before it. Two tokens are compatible when merging their joined text gives
just those two, which their own last merges tell. The table keeps that one token per
prefix. It is filled from the chunk's start, with the longest match (found in a trie of
the tokens) before shorter ones, and taken back where no token follows; as a prefix
has one last token only, none is reached twice. Time is linear in the chunk's
length, whatever that is.

Edge cases: null and empty texts give the end id alone and decode to nothing;
repeated rows and null doc_ids each get their row; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import slices
from leadflow.llm.pieces import Memo, chunks, load

_NEVER = float("inf")


class PrefixTable:
    #: Bounds of what a worker remembers between texts: chunks, and pairs of tokens.
    CHUNKS = 200_000
    PAIRS = 200_000

    def __init__(self, path: str) -> None:
        self.pieces = load(path)
        rank = self.pieces.rank
        self.vocabulary = len(self.pieces.model)
        # Characters that only occur inside pieces get numbers of their own, after the model's ids.
        alone = sorted(set("".join(rank)) - set(rank))
        self.ids = {**self.pieces.ids, **{c: self.vocabulary + k for k, c in enumerate(alone)}}
        self.size = self.vocabulary + len(alone)
        self.texts = [""] * self.size
        self.lens = [0] * self.size
        #: A token's last merge: its rank (-1: one character) and the two tokens it joins.
        self.made = [-1.0] * self.size
        self.left, self.right = [-1] * self.size, [-1] * self.size
        #: Whether the merges inside a token come in order of their ranks.
        self.ordered = [True] * self.size
        #: The longest token that a token starts with, besides itself.
        self.shorter = [-1] * self.size
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        #: The longest token that each beginning of a token starts with.
        self.longest: dict[str, int] = {}
        for p in sorted(self.ids, key=len):
            i = self.ids[p]
            self.texts[i], self.lens[i] = p, len(p)
            if len(p) > 1:
                parts = self.merged(p, 2)
                if len(parts) > 2 or p not in rank:
                    continue  # merges never make it
                a, b = self.left[i], self.right[i] = self.ids[parts[0]], self.ids[parts[1]]
                self.made[i] = rank[p]
                self.ordered[i] = self.ordered[a] and self.ordered[b] and max(self.made[a], self.made[b]) <= rank[p]
            self.trie.add_word(p, i)
            known = -1
            for k in range(1, len(p)):
                known = self.longest.setdefault(p[:k], known)
            self.shorter[i], self.longest[p] = known, i
        self.reach = max(self.lens, default=0)
        self.fits: dict[int, bool] = {}
        self.decimal = [str(i) for i in range(self.vocabulary)]
        self.memo = Memo(self.encode_chunk, self.CHUNKS)

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Merges of a short text, best rank first and leftmost among equals, down to ``least`` parts."""
        parts, get = list(text), self.pieces.rank.get
        ranks = [get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while len(parts) > least and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], _NEVER)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two tokens gives just those two: their merges are
        taken back, latest first, and at no time may the two symbols that meet merge before the
        one taken back last. Of equal ranks the left one is first."""
        texts, made, get = self.texts, self.made, self.pieces.rank.get
        if not (self.ordered[a] and self.ordered[b]):
            return self.merged(texts[a] + texts[b]) == [texts[a], texts[b]]
        if texts[a] + texts[b] in self.pieces.rank:
            return False
        x, y = made[a], made[b]
        while x >= 0 or y >= 0:
            if x > y:
                last, a = x, self.right[a]
                x = made[a]
                if get(texts[a] + texts[b], _NEVER) < last:
                    return False
            else:
                last, b = y, self.left[b]
                y = made[b]
                if get(texts[a] + texts[b], _NEVER) <= last:
                    return False
        return True

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        lens, shorter, fits, size, reach = self.lens, self.shorter, self.fits, self.size, self.reach
        longest, matched = self.longest, self.trie.longest_prefix
        out: list[int] = []
        at, n, prior, odd = 0, len(chunk), -1, False
        while at < n:
            ahead = chunk[at:at + reach]
            if found := matched(ahead):
                token = longest[ahead[:found]]
                while True:
                    # At the chunk's start, or after a character that is in no piece, any token may stand.
                    while token >= 0 and prior >= 0:
                        key = prior * size + token
                        if (ok := fits.get(key)) is None:
                            if len(fits) >= self.PAIRS:
                                fits.clear()
                            ok = fits[key] = self.compatible(prior, token)
                        if ok:
                            break
                        token = shorter[token]
                    if token >= 0:
                        break
                    # No encoding of the chunk ends a token here: the last one was too long.
                    token = out.pop()
                    at -= lens[token]
                    token, prior = shorter[token], out[-1] if out else -1
                out.append(token)
                at += lens[token]
                prior = token
                odd = odd or token >= self.vocabulary
            else:
                out.append(-1 - ord(chunk[at]))
                at += 1
                prior, odd = -1, True
        return tuple(self._spelled(out) if odd else out)

    def _spelled(self, tokens: list[int]) -> Iterator[int]:
        """The same with characters that are no piece written in bytes."""
        for t in tokens:
            if 0 <= t < self.vocabulary:
                yield t
            else:
                yield from self.pieces.spelled(chr(-1 - t) if t < 0 else self.texts[t])

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text and the end id."""
        memo = self.memo
        ids = list(chain.from_iterable([memo[c] for c in chunks(text or "")]))
        ids.append(self.pieces.end_id)
        return ids

    def written(self, ids: list[int]) -> str:
        """Ids as decimal text, joined by single spaces."""
        return " ".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.pieces.model.decode(ids)


@lru_cache(maxsize=2)
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded): whole texts encoded, end id last, and decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = prefix_table(model_path)
        for b in (p for b in batches for p in slices(b)):
            ids = [t.encode(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([t.decode(x) for x in ids], pa.string())],
                ["doc_id", "ids", "decoded"])

    return _source(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the same encoding, made where
    the ids are, so they need not leave the worker; ``with_ids``: and the ids, as training data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = prefix_table(model_path)
        for b in (p for b in batches for p in slices(b)):
            n, one, two, all_ids = [], [], [], []
            for x in b.column(1):
                ids = t.encode(x.as_py())
                if with_ids:
                    all_ids.append(np.array(ids, np.int32))
                n.append(len(ids))
                one.append(hashlib.sha256(t.written(ids).encode("ascii")).hexdigest())
                two.append(hashlib.sha256(t.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            more = [pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string()), *more],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:4 + len(more)])

    return _source(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
