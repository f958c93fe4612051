"""Token counts (operator 3) by heap and linked list.

The symbols of a chunk form a doubly linked list; a heap holds its adjacent pairs by
rank (leftmost first among equals). Popping the lowest pair merges it, if both ends
are still as they were, and pushes the two new neighbour pairs. The count is the
number of initial symbols minus the merges; no ids are made. A character that is no
piece counts as its UTF-8 bytes, which never merge.

Edge cases: null and empty texts have no tokens and no bytes; repeated rows and null
doc_ids each get their row; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.pieces import Memo, chunks, load


class Counter:
    def __init__(self, path: str) -> None:
        self.rank = load(path).rank
        self.memo = Memo(self.count_chunk)

    def count_chunk(self, chunk: str) -> int:
        rank = self.rank
        symbols = list(chunk)
        n = len(symbols)
        count = n
        for c in symbols:
            if c not in rank:
                count += len(c.encode("utf-8", "surrogatepass")) - 1
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pair + symbols[k]
                if new in rank:
                    heappush(heap, (rank[new], i, new))
            if (h := before[i]) >= 0:
                new = symbols[h] + pair
                if new in rank:
                    heappush(heap, (rank[new], h, new))
        return count

    def count(self, text: str | None) -> int:
        memo = self.memo
        return sum([memo[c] for c in chunks(text or "")])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = np.fromiter(map(c.count, texts), np.int64, len(texts))
            size = np.fromiter((len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
