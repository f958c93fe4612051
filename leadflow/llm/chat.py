"""Chat formatting (operator 10) with a prefix tree.

A turn is written ``<turn role>`` NEWLINE text ``</turn>`` NEWLINE. Within roles and
texts a backslash goes before every ``<``, ``>`` and backslash, so markers in texts are
never read as markers and the text can be recovered exactly.

Conversations are sorted by the hashes of their turns, so those sharing initial
turns are neighbours and reading them in order walks the prefix tree depth-first.
The sorted rows are cut into packs of bounded size. A turn shared by
neighbours is emitted once, also where a pack ends between them: the next pack begins with
its *base*, the nodes of earlier packs (pack id, node) that its first conversation shares, and hangs
its own nodes below them. So a task writes no turn of the tree twice, and a pack's size counts what it
writes itself. A pack holds its text and, for each tree node, where it
starts, its length, the position id of its first character, how many base nodes it follows, and the attention
intervals: the stretches of its ancestors in the pack. Those, the base nodes and the node itself are all
it may attend to. Tokens are characters here; position ids run on along the path, not the pack.

The sort is by range over (path, conv_id), so a common first turn, or one conversation
repeated very often, spreads over tasks; each of them writes it once.

Edge cases: a null text or role is empty; turns of equal number are ordered by role and
text; rows with a null conv_id form one conversation with a null id; conversations that
are equal share one leaf and each are listed; an empty table gives no packs (the added
conversation alone); further columns are ignored. One conversation is one sequence and is
held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A pack is closed when its text is this long or it lists this many conversations.
PACK_CHARS, PACK_CONVERSATIONS = 1 << 18, 512
_SAID = r"([^\\<>]*(?:\\.[^\\<>]*)*)"
_TURN = re.compile(rf"<turn {_SAID}>\n{_SAID}</turn>\n", re.S)
#: Turns, in rows of the added conversation of the contract (fixed values).
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: str) -> str:
    return re.sub(r"([\\<>])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def opening(role: str) -> str:
    return f"<turn {escape(role)}>\n"


def format_turn(role: str, text: str) -> str:
    return f"{opening(role)}{escape(text)}</turn>\n"


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, roles, texts, path): turns in order; path holds a hash of each turn."""
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("long").alias("n"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("r"),
                                                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))))
    return (rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns.alias("turns"))
            .select("conv_id", F.col("turns.r").alias("roles"), F.col("turns.t").alias("texts"),
                    F.transform("turns", lambda x: F.md5(F.concat(F.length(x["r"]).cast("string"), F.lit(" "), x["r"], x["t"]))).alias("path")))


@dataclass
class _Node:
    """A turn on the path: its pack, its number there, where its position ids end."""

    pack: int
    number: int
    end: int


@dataclass
class _Pack:
    pack_id: int
    base: list[_Node] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    size: int = 0
    starts: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    positions: list[int] = field(default_factory=list)
    bases: list[int] = field(default_factory=list)
    losses: list[list[int]] = field(default_factory=list)
    intervals: list[list[list[int]]] = field(default_factory=list)
    conv_ids: list[int | None] = field(default_factory=list)
    leaves: list[int] = field(default_factory=list)
    conv_bases: list[int] = field(default_factory=list)

    def add(self, path: list[_Node], role: str, text: str, loss_role: str) -> _Node:
        """Emit a node below the last of ``path`` (empty: a root)."""
        said = format_turn(role, text)
        parent = path[-1] if path else None
        above: list[list[int]] = []
        if parent is not None and parent.pack == self.pack_id:
            above = [list(x) for x in self.intervals[parent.number]]
            lo, hi = self.starts[parent.number], self.starts[parent.number] + self.lengths[parent.number]
            if above and above[-1][1] == lo:  # stretches that touch are one interval
                above[-1][1] = hi
            else:
                above.append([lo, hi])
        self.bases.append(sum(n.pack != self.pack_id for n in path))
        self.starts.append(self.size)
        self.lengths.append(len(said))
        self.positions.append(parent.end if parent else 0)
        self.intervals.append(above)
        lead = len(opening(role))
        self.losses.append([self.size + lead, self.size + lead + len(escape(text))] if role == loss_role else [])
        self.text.append(said)
        self.size += len(said)
        return _Node(self.pack_id, len(self.starts) - 1, self.positions[-1] + len(said))

    def hold(self, conv_id: int | None, path: list[_Node]) -> None:
        """List a conversation whose last turn is the last of ``path``; leaf -1: all of it is base."""
        self.conv_ids.append(conv_id)
        self.leaves.append(path[-1].number if path[-1].pack == self.pack_id else -1)
        self.conv_bases.append(sum(n.pack != self.pack_id for n in path))

    def row(self) -> dict:
        return {"pack_id": self.pack_id, "base": [{"pack": n.pack, "node": n.number} for n in self.base], "text": "".join(self.text), "node_start": self.starts,
                "node_length": self.lengths, "node_position": self.positions, "node_base": self.bases, "node_loss": self.losses, "node_attends": self.intervals,
                "conv_ids": self.conv_ids, "leaves": self.leaves, "conv_base": self.conv_bases}


PACK_SCHEMA = ("pack_id long, base array<struct<pack:long,node:int>>, text string, node_start array<int>, node_length array<int>, node_position array<int>, "
               "node_base array<int>, node_loss array<array<int>>, node_attends array<array<array<int>>>, conv_ids array<long>, leaves array<int>, conv_base array<int>")


def packs(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Packed prefix trees of all conversations (one row a pack)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = _Pack(TaskContext.get().partitionId() << 32)
        path: list[str] = []
        nodes: list[_Node] = []
        for pdf in frames:
            out = []
            for conv, roles, texts, new in zip(pdf["conv_id"], pdf["roles"], pdf["texts"], pdf["path"]):
                new = list(new)
                shared = 0
                while shared < min(len(path), len(new)) and path[shared] == new[shared]:
                    shared += 1
                path, nodes = new, nodes[:shared]
                if pack.size >= PACK_CHARS or len(pack.conv_ids) >= PACK_CONVERSATIONS:
                    out.append(pack.row())
                    pack = _Pack(pack.pack_id + 1, base=list(nodes))
                for k in range(shared, len(new)):
                    nodes.append(pack.add(nodes, roles[k], texts[k], loss_role))
                pack.hold(None if pd.isna(conv) else int(conv), nodes)
            if out:
                yield pd.DataFrame(out)
        if pack.conv_ids:
            yield pd.DataFrame([pack.row()])

    return (conversations(rows).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
            .mapInPandas(run, PACK_SCHEMA))


def with_base_texts(packed: DataFrame) -> DataFrame:
    """``packed`` with ``base_texts``, (whole turn, its text under the loss mask or null) of each base node. Only
    packs with a base, and the packs these name, are joined."""
    has_base = F.size("base") > 0
    refs = packed.filter(has_base).select("pack_id", F.posexplode("base").alias("at", "b")).select("pack_id", "at", F.col("b.pack").alias("from_pack"), F.col("b.node").alias("node"))
    named = refs.select("from_pack").distinct()
    source = packed.join(named, F.col("pack_id") == F.col("from_pack"), "left_semi").select(F.col("pack_id").alias("from_pack"), F.col("text").alias("_text"), "node_start", "node_length", "node_loss")
    start, loss = F.get("node_start", F.col("node")), F.get("node_loss", F.col("node"))
    parts = refs.join(source, "from_pack").select("pack_id", F.struct(
        "at", F.substr(F.col("_text"), start + 1, F.get("node_length", F.col("node"))).alias("said"),
        F.when(F.size(loss) > 0, F.substr(F.col("_text"), F.get(loss, F.lit(0)) + 1, F.get(loss, F.lit(1)) - F.get(loss, F.lit(0)))).alias("loss")).alias("part"))
    texts = parts.groupBy("pack_id").agg(F.sort_array(F.collect_list("part")).alias("base_texts"))
    none = F.lit(None).cast(texts.schema["base_texts"].dataType)
    return packed.filter(has_base).join(texts, "pack_id").unionByName(packed.filter(~has_base).withColumn("base_texts", none))


def read_back(packed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), recovered
    from the packs alone: a conversation is its base nodes, its leaf's attention intervals and the leaf.
    Reads ``packed`` more than once; store it."""

    def digest(parts: Iterator[str]) -> str:
        h = hashlib.sha256()
        for p in parts:
            h.update(p.encode("utf-8", "surrogatepass"))
        return h.hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p in pdf.itertuples(index=False):
                out = []
                base = [] if p.base_texts is None else [(x["said"], x["loss"]) for x in p.base_texts]
                losses = sorted((int(x[0]), int(x[1])) for x in p.node_loss if len(x))
                for conv, leaf, depth in zip(p.conv_ids, p.leaves, p.conv_base):
                    spans = []
                    if leaf >= 0:
                        spans = [(int(a), int(b)) for a, b in p.node_attends[leaf]]
                        spans.append((int(p.node_start[leaf]), int(p.node_start[leaf] + p.node_length[leaf])))
                    whole = "".join([t for t, _ in base[:depth]] + [p.text[a:b] for a, b in spans])
                    turns = [(unescape(r), unescape(t)) for r, t in _TURN.findall(whole)]
                    said = [unescape(x) for _, x in base[:depth] if x is not None]
                    said += [unescape(p.text[a:b]) for a, b in losses if any(lo <= a and b <= hi for lo, hi in spans)]
                    out.append((conv, len(turns), digest(x for r, t in turns for x in (r, "\n", t, "\n")), sum(map(len, said)), digest(iter(said)), len(whole)))
                yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    packed = with_base_texts(packed).select("text", "node_start", "node_length", "node_loss", "node_attends", "conv_ids", "leaves", "conv_base", "base_texts")
    return packed.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
