"""Embedding near-duplicates (operator 8) by a subspace pigeonhole join.

Unit vectors at cosine c are sqrt(2 - 2c) apart. Turned by a fixed random rotation
and split into ``BLOCKS`` subspaces, a linked pair is within its proportional share
of the squared distance in at least one block. Each block is range-joined: a grid over
its first coordinates deals every vector to its home cell and, as a guest, to all
cells within reach. In a cell, homes meet guests; pairs within the block's budget
are candidates, and the union over blocks is verified exactly: a pair is taken in
the first block it qualifies in only, by its cosine in double precision. Link counts and
a spanning forest of the links leave a cell, never its pairs.

Exact copies collapse to one vector first. A cell with over ``TILE`` homes is divided by
the block's further coordinates, then by finer grids, wherever that parts its homes; what
stays hot (near copies) is cut into salted tiles, each seeing all guests, so no task
holds a whole hot cell and cells get finer as the table grows.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components,
and rows with a null label, link with nothing and are their own component; so do rows
with a null vec_id, whose component is null and kept false; vectors of different
lengths are not compared; repeated rows count as other vectors; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import stored
from leadflow.llm.components import components

BLOCKS = 8
CELL = 0.2
#: The grids, one level inside the other: coordinates of a block and width of a cell.
#: All vectors are dealt by the first; only hot cells are divided by the next.
LEVELS = [((0, 1, 2), CELL), ((3, 4), CELL), ((5, 6, 7), CELL), ((0, 1, 2, 3), CELL / 2), ((4, 5, 6, 7), CELL / 2)]
TILE = 2048
_CHUNK = 512
#: A level divides a cell if no part keeps more than this share of its homes.
_MOST = 0.75
#: Stands for a grid number in cells that a level left undivided.
_FILL = np.iinfo(np.int16).min
#: Hot cells above this number are joined by a shuffle, not broadcast.
_BROADCAST_CELLS = 50_000
_PLACE = ["label", "dim", "block", "cell"]


@lru_cache(maxsize=8)
def _rotation(dim: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q


def _blocks(dim: int) -> list[tuple[int, int]]:
    n = min(BLOCKS, dim)
    return [(dim * i // n, dim * (i + 1) // n) for i in range(n)]


def _turned(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors; einsum works row by row, so a vector's result does not
    depend on the batch it is in."""
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.einsum("ij,kj->ik", unit, _rotation(x.shape[1]))


def _block_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance over the last axis, summed in a fixed order."""
    out = (a[..., 0] - b[..., 0]) ** 2
    for k in range(1, a.shape[-1]):
        out += (a[..., k] - b[..., k]) ** 2
    return out


def _reach(cosine: float, n_blocks: int) -> float:
    return (2 - 2 * cosine) / n_blocks * (1 + 1e-9) + 1e-12


def _cells(part: np.ndarray, width: float, reach: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) arrays: the home cell of every row or, given a reach, every cell
    within it. A cell is one grid number per coordinate."""
    rows, cells = np.arange(len(part)), np.empty((len(part), 0), np.int16)
    for x in part.T:
        low = np.floor((x[rows] - (reach or 0)) / width).astype(np.int64)
        times = np.floor((x[rows] + (reach or 0)) / width).astype(np.int64) - low + 1
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        cells = np.column_stack([np.repeat(cells, times, axis=0), (np.repeat(low, times) + step).astype(np.int16)])
        rows = np.repeat(rows, times)
    return rows, cells


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, key): key is the same for exact copies under one
    label, null for vectors that link with nothing. Single-precision vectors stay so
    until they are compared, which halves what is shuffled and changes no result."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    e = F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda v: v + F.lit(0.0).cast(kind))  # -0.0 is 0.0
    bad = F.lit(float("inf"))
    ok = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
          & ~F.exists("_e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == bad))
          & F.exists("_e", lambda v: v != 0))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
            .withColumn("_e", e)
            .select("vec_id", "label", F.col("_e").alias("embedding"),
                    F.when(ok, F.md5(F.to_json(F.struct("label", "_e")))).alias("key")))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a vector column, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _binary(cells: np.ndarray) -> pa.Array:
    size = cells.shape[1] * 2
    offsets = np.arange(len(cells) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(cells).tobytes())])


def _grid_reach(cosine: float, n_blocks: int) -> float:
    return float(np.sqrt(_reach(cosine, n_blocks))) * (1 + 1e-9) + 1e-12


def _columns(b: pa.RecordBatch, names: list[str], **new: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n) for n in names], names)


def _deal(cosine: float, roles: tuple[int, ...], names: list[str]):
    """Every vector goes to its cells of the first level, per block: its home (role 0) and
    all within reach (role 1)."""
    coordinates, width = LEVELS[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.diff(b.column("vec").offsets.to_numpy()) if b.num_rows else np.array([], int)
            for dim in np.unique(dims):
                sub = b.take(pa.array(np.flatnonzero(dims == dim)))
                turned, spans = _turned(_vectors(sub.column("vec"), dim)), _blocks(dim)
                for block, (lo, hi) in enumerate(spans):
                    part = turned[:, [lo + c for c in coordinates if lo + c < hi]]
                    for role in roles:
                        rows, cells = _cells(part, width, _grid_reach(cosine, len(spans)) if role else None)
                        n = len(rows)
                        yield _columns(sub.take(pa.array(rows)), names, dim=pa.array(np.full(n, dim, np.int32)), block=pa.array(np.full(n, block, np.int32)),
                                       cell=_binary(cells), role=pa.array(np.full(n, role, np.int8)))
    return run


def _refine(cosine: float, level: int, names: list[str]):
    """Rows of hot cells move on to cells of ``level`` inside them; ``split`` is null
    for rows that stay, and false where a level's cells would not divide the homes:
    those go on undivided, marked by a fill. ``parent`` is the cell before."""
    coordinates, width = LEVELS[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = np.array([-1 if x is None else int(x) for x in b.column("split").to_pylist()], np.int64)
            dim, block, role = (b.column(k).to_numpy() for k in ("dim", "block", "role"))
            kinds, kind = np.unique(np.column_stack([dim, block, role, split]), axis=0, return_inverse=True)
            for k, (d, at, r, how) in enumerate(kinds.tolist()):
                sub = b.take(pa.array(np.flatnonzero(kind.ravel() == k)))
                if how < 0:
                    yield _columns(sub, names, parent=sub.column("cell"))
                    continue
                spans = _blocks(d)
                lo, hi = spans[at]
                inner = [lo + c for c in coordinates if lo + c < hi]
                old = np.frombuffer(b"".join(sub.column("cell").to_pylist()), np.int16).reshape(sub.num_rows, -1)
                if how:
                    rows, new = _cells(_turned(_vectors(sub.column("vec"), d))[:, inner], width, _grid_reach(cosine, len(spans)) if r else None)
                else:
                    rows, new = np.arange(sub.num_rows), np.full((sub.num_rows, len(inner)), _FILL, np.int16)
                moved = sub.take(pa.array(rows))
                yield _columns(moved, names, cell=_binary(np.column_stack([old[rows], new])), parent=moved.column("cell"))
    return run


class _Tile:
    """Homes of one tile; guests are met in chunks as they stream by."""

    def __init__(self, block: int, cosine: float, x: np.ndarray, key: list, rep: np.ndarray) -> None:
        self.block, self.cosine, self.x, self.key, self.rep = block, cosine, x, np.array(key, object), rep
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        self.turned = _turned(x)
        self.spans = _blocks(x.shape[1])
        self.budget = _reach(cosine, len(self.spans))
        self.links = np.zeros(len(rep), np.int64)
        self.label = np.arange(len(rep))

    def meet(self, x: np.ndarray, key: list, rep: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
        """Count links to these guests; edges (guest, a linked home)."""
        lo, hi = self.spans[self.block]
        turned, norm = _turned(x), np.sqrt(np.einsum("ij,ij->i", x, x))
        near = _block_distance(self.turned[:, None, lo:hi], turned[None, :, lo:hi]) <= self.budget
        i, j = np.nonzero(near)
        differ = self.key[i] != np.array(key, object)[j]
        i, j = i[differ], j[differ]
        keep = np.ones(len(i), bool)
        for at in range(0, len(i), 1 << 15):
            p, q = i[at:at + (1 << 15)], j[at:at + (1 << 15)]
            ok = np.einsum("ij,ij->i", self.x[p], x[q]) / (self.norm[p] * norm[q]) >= self.cosine
            for lo, hi in self.spans[:self.block]:  # taken in the first block only
                ok &= _block_distance(self.turned[p, lo:hi], turned[q, lo:hi]) > self.budget
            keep[at:at + (1 << 15)] = ok
        i, j = i[keep], j[keep]
        np.add.at(self.links, i, weight[j])
        edges = []
        order = np.argsort(j, kind="stable")
        cuts = np.flatnonzero(np.diff(j[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            homes = i[group]
            edges.append((int(rep[j[group[0]]]), int(self.rep[homes[0]])))
            met = self.label[homes]
            if (met != met[0]).any():
                self.label[np.isin(self.label, np.unique(met))] = met.min()
        return edges

    def forest(self) -> list[tuple[int, int]]:
        return [(int(a), int(self.rep[m])) for a, m in zip(self.rep, self.label) if a != self.rep[m]]


def _match(cosine: float):
    names = ["a", "b", "n", "key"]

    def batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*edges)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(tile: _Tile) -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(tile.links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(tile.rep[some]), pa.nulls(len(some), pa.int64()), pa.array(tile.links[some]),
                                                  pa.array(tile.key[some].tolist(), pa.string())], names)
            if f := tile.forest():
                yield batch(f)

        at, homes, tile = None, [], None
        for b in batches:
            role = b.column("role").to_numpy()
            places = list(zip(*(b.column(k).to_pylist() for k in (*_PLACE, "salt")), role.tolist()))
            cuts = [k for k in range(1, len(places)) if places[k] != places[k - 1]]
            for lo, hi in zip([0, *cuts], [*cuts, len(places)]):
                if lo == hi:
                    continue
                here = places[lo][:-1]
                if here != at:
                    if tile:
                        yield from done(tile)
                    at, homes, tile = here, [], None
                part = b.slice(lo, hi - lo)
                x = _vectors(part.column("vec"), here[1])
                key, rep = part.column("key").to_pylist(), part.column("rep").to_numpy()
                if role[lo] == 0:
                    homes.append((x, key, rep))
                    continue
                if tile is None:
                    if not homes:  # guests of a cell where nobody lives
                        continue
                    tile = _Tile(here[2], cosine, np.concatenate([h[0] for h in homes]), [k for h in homes for k in h[1]], np.concatenate([h[2] for h in homes]))
                weight = part.column("weight").to_numpy()
                for k in range(0, hi - lo, _CHUNK):
                    s = slice(k, k + _CHUNK)
                    if edges := tile.meet(x[s], key[s], rep[s], weight[s]):
                        yield batch(edges)
        if tile:
            yield from done(tile)
    return run


def _sized(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` with the columns that ``cells`` (one row a hot cell) has of their cell, if any."""
    few = cells.limit(_BROADCAST_CELLS + 1).count() <= _BROADCAST_CELLS
    return rows.join(F.broadcast(cells) if few else cells, _PLACE, "left")


def _dealt(src: DataFrame, cosine: float) -> DataFrame:
    """Homes and guests of every cell; cells that more than ``TILE`` live in are divided
    level by level, and what is left of them is cut into salted tiles that each see all guests."""
    vec = src.schema["vec"].dataType.simpleString()
    spec = {"label": "string", "dim": "int", "block": "int", "cell": "binary", "role": "byte", "key": "string", "rep": "long", "weight": "long", "vec": vec}

    def schema(names: list[str]) -> str:
        return ", ".join(f"{n} {spec.get(n, 'binary')}" for n in names)

    full, home = list(spec), [*_PLACE, "role", "vec"]
    rows = src.mapInArrow(_deal(cosine, (0, 1), full), schema(full))
    homes = src.mapInArrow(_deal(cosine, (0,), home), schema(home))
    hot = stored(src.mapInArrow(_deal(cosine, (0,), _PLACE), schema(_PLACE)).groupBy(*_PLACE)
                 .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE), "hot-cells")
    for level in range(1, len(LEVELS)):
        if hot.isEmpty():
            break
        # What the level would make of each hot cell; it is used where no part keeps most of the homes.
        child = [*_PLACE, "parent"]
        homes = _sized(homes, hot).filter("n is not null").drop("n")
        parts = stored(homes.withColumn("split", F.lit(True)).mapInArrow(_refine(cosine, level, child), schema(child))
                       .groupBy(*child).agg(F.count(F.lit(1)).alias("n")), "cell-parts")
        plan = stored(parts.groupBy("label", "dim", "block", F.col("parent").alias("cell"))
                      .agg((F.max("n") <= _MOST * F.sum("n")).alias("split")), "cell-plan")
        rows = _sized(rows, plan).mapInArrow(_refine(cosine, level, full), schema(full))
        homes = _sized(homes, plan).mapInArrow(_refine(cosine, level, home), schema(home))
        hot = stored(homes.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE), "hot-cells")
    salts = F.coalesce(F.ceil(F.col("n") / TILE).cast("int"), F.lit(1))
    return (_sized(rows, hot).withColumn("salts", salts)
            .withColumn("salt", F.explode(F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")))
                                          .otherwise(F.sequence(F.lit(0), F.col("salts") - 1)))))


def embedding_dedup(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = classes(vectors)
    one = stored(rows.filter("key is not null").groupBy("key")
                 .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("vec")), "classes")
    dealt = _dealt(one.select("label", "key", "rep", "weight", "vec"), cosine)
    found = stored(dealt.repartition(*_PLACE, "salt").sortWithinPartitions(*_PLACE, "salt", "role")
                   .select(*_PLACE, "salt", "role", "key", "rep", "weight", "vec")
                   .mapInArrow(_match(cosine), "a long, b long, n long, key string"), "links")
    counts = found.filter("n is not null").groupBy("key").agg(F.sum("n").alias("n"))
    groups = components(found.filter("b is not null").select("a", "b"))
    label = (one.select("key", "rep", "weight").join(counts, "key", "left").join(groups, F.col("rep") == F.col("node"), "left")
             .select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    return (rows.select("vec_id", "key").join(label, "key", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
