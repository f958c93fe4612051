"""Fill-in-the-middle transformation (operator 12).

A text's tokens (a word with the white space before it; white space at the end) form an
indexable skip list: lane 0 links token to token, each higher lane about a quarter of the nodes
of the lane below, and every link carries two widths, in tokens and in code points. To find a
cut, the search goes down from the top lane, follows links while their token widths fit into the
wanted rank, and adds up the code-point widths on its way: the sum is the exact place to cut.

Edge cases: a null text counts as empty; an empty text, or one holding a sentinel, stays
plain; a null id is hashed as the empty string; repeated rows give equal results (the cuts depend on
the id alone); texts are cut whole at any length (4 bytes a code point are held for
one text at a time); an empty table gives an empty result; further columns are ignored unless
named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentinels of the contract (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A node reaches the next lane with odds of one in so many.
SPREAD = 4
#: Texts of about so many code points go into one Arrow batch of results.
BATCH_CHARS = 1 << 22


def token_widths(text: str) -> np.ndarray:
    """Code points of each token of ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64)
    visible = ~((points == 0x20) | ((points >= 0x09) & (points <= 0x0D)))
    last = visible.copy()
    last[:-1] &= ~visible[1:]
    last[-1] = True                     # a word's end, or the end of the white space after the last word
    return np.diff(np.flatnonzero(last), prepend=-1)


class SkipList:
    """Indexable skip list over tokens of given code-point widths.

    ``units[l]`` and ``chars[l]`` are the two widths of the links of lane l; ``down[l][k]`` is the link
    of lane l - 1 at which link k of lane l starts. A node's height comes from a hash of its
    position, so equal texts always have equal lists.
    """

    def __init__(self, widths: np.ndarray):
        n = len(widths)
        self.units, self.chars, self.down = [np.ones(n, np.int64)], [widths.astype(np.int64)], [None]
        coins = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        coins ^= coins >> np.uint64(32)
        while True:
            tall = np.flatnonzero(coins % np.uint64(SPREAD) == 0)
            if not len(tall):
                return
            start = np.concatenate(([0], tall + 1))     # the last entry: where the lane ends
            end = start[-1]
            self.units.append(np.add.reduceat(self.units[-1][:end], start[:-1]))
            self.chars.append(np.add.reduceat(self.chars[-1][:end], start[:-1]))
            self.down.append(start)
            coins = coins[tall] // np.uint64(SPREAD)

    def place(self, rank: int) -> int:
        """Code points in the first ``rank`` tokens."""
        link = seen = at = 0
        for lane in range(len(self.units) - 1, -1, -1):
            units, chars = self.units[lane], self.chars[lane]
            while link < len(units) and seen + units[link] <= rank:
                seen += int(units[link])
                at += int(chars[link])
                link += 1
            if lane:
                link = int(self.down[lane][link])
        return at


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """h1 to h4: the first four 8-digit groups of the hash of seed and id."""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(d[8 * i:8 * i + 8], 16) for i in range(4))


def transform(text: str, doc_id: int | None, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    widths = token_widths(text)
    n = len(widths)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= fim_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    tokens = SkipList(widths)
    a, b = (tokens.place(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80,
                   keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, *keep): one map over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["n", "form", "prefix_chars", "middle_chars", "output"]
        for b in batches:
            first, rows, chars = 0, [], 0
            for i in range(b.num_rows):
                rows.append(transform(b.column(1)[i].as_py() or "", b.column(0)[i].as_py(), seed, fim_percent, spm_percent))
                chars += len(rows[-1][-1])
                if chars >= BATCH_CHARS or i == b.num_rows - 1:
                    part = b.slice(first, i + 1 - first)
                    made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *made, *part.columns[2:]],
                                                     ["doc_id", *names, *part.schema.names[2:]])
                    first, rows, chars = i + 1, [], 0

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    schema = src.select("doc_id").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    for f in src.select(*keep).schema.fields:
        schema = schema.add(f)
    return src.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts, found by the sentinels alone, put back in order."""

    def parts(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, 2 ** 31 - 1)
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, third, 1)
        return one, two, F.substr(rest, F.length(two) + len(third) + 1)

    p, s, m = parts(PREFIX, SUFFIX, MIDDLE)
    psm = F.concat(p, m, s)
    s, p, m = parts(SUFFIX, PREFIX, MIDDLE)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(p, m, s)).otherwise(output)
