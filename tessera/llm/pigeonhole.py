"""Embedding near-duplicates by a pigeonhole join over low-dimensional blocks of rotated vectors."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batch, connected_components, discard, map_arrow, parts, saved
from tessera.llm.vectors import as_bytes, dimension, from_bytes, rows_of, width

#: Dimensions of a block; its first GRID coordinates are laid on a grid whose cells are CELL times the range wide.
BLOCK_DIMS, GRID, CELL = 8, 2, 2.0
#: Vectors of a cell that are held against each other at once; fuller cells are dealt out in tiles of pairs of chunks, and
#: those of more than REFINE chunks are first cut by the next GRID coordinates, which copies less.
CHUNK, REFINE = 8192, 4
STEP = 512


class Rotation:
    """A fixed random rotation, the blocks of rotated unit vectors, and each block's share of the squared distance."""

    def __init__(self, dim: int, cosine: float):
        q, r = np.linalg.qr(np.random.default_rng(64).standard_normal((dim, dim)))
        self.matrix = q * np.sign(np.diag(r))
        self.blocks = np.array_split(np.arange(dim), max(1, round(dim / BLOCK_DIMS)))
        squared = 2 - 2 * cosine
        # a hair more than its share, so that rounding loses no pair
        self.budget = np.array([squared * len(b) / dim * (1 + 1e-9) + 1e-12 for b in self.blocks])
        self.reach = np.sqrt(self.budget)

    def turn(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.matrix

    def cells(self, y: np.ndarray, block: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell, by the coordinates of a depth, that a box of half the reach around each vector touches. The
        boxes of two vectors within reach overlap, so they share a cell."""
        at, reach = y[:, self.blocks[block][depth * GRID : (depth + 1) * GRID]], self.reach[block]
        return tuple(np.floor((at + s * reach / 2) / (CELL * reach)).astype(np.int64) for s in (-1, 1))

    def depths(self, block: int) -> int:
        return -(-len(self.blocks[block]) // GRID)

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distance of each pair of rows in each block."""
        d = (a - b) ** 2
        return np.stack([d[:, c].sum(axis=1) for c in self.blocks], axis=1)


def corners(low: np.ndarray, high: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, cell) for every cell between ``low`` and ``high``, inside the cells of ``code``."""
    for corner in range(1 << low.shape[1]):
        up = np.array([corner >> i & 1 for i in range(low.shape[1])], dtype=bool)
        rows = np.flatnonzero(((high != low) | ~up).all(axis=1))
        yield rows, cell_code(code[rows], np.where(up, high, low)[rows])


def places(turn: Rotation, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, row, cell) for every cell of every block that a row touches."""
    for b in range(len(turn.blocks)):
        for rows, cell in corners(*turn.cells(y, b), np.full(len(y), b, dtype=np.int64)):
            yield b, rows, cell


def cell_code(inside: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The number of a cell inside others (of a block, at first)."""
    code = inside.astype(np.uint64)
    for i in range(cell.shape[1]):
        code = (code ^ cell[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code.astype(np.int64)


def tile_links(turn: Rotation, x: np.ndarray, block: int, depth: int, code: int, left: np.ndarray, right: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows of ``left`` and ``right`` (of ``left`` itself if None) that belong to this cell: those whose
    first block within its budget is the cell's, and whose boxes' overlap begins in the cell. So each link is found once."""
    y = turn.turn(x)
    own = y[:, turn.blocks[block]]
    norm = (own**2).sum(axis=1)
    size = np.linalg.norm(x, axis=1)
    other = left if right is None else right
    firsts, seconds = [], []
    for at in range(0, len(left), STEP):
        rows = left[at : at + STEP]
        near = norm[rows][:, None] + norm[other][None, :] - 2 * own[rows] @ own[other].T <= turn.budget[block] * (1 + 1e-6) + 1e-9
        i, j = np.nonzero(near)
        a, b = rows[i], other[j]
        if right is None:
            a, b = a[keep := at + i < j], b[keep]
        if not len(a):
            continue
        own_cell = np.full(len(a), block, dtype=np.int64)
        for d in range(depth + 1):
            own_cell = cell_code(own_cell, np.maximum(turn.cells(y[a], block, d)[0], turn.cells(y[b], block, d)[0]))
        here = own_cell == code
        a, b = a[here], b[here]
        within = turn.distances(y[a], y[b]) <= turn.budget
        here = within[:, block] & ~within[:, :block].any(axis=1)
        a, b = a[here], b[here]
        linked = (x[a] * x[b]).sum(axis=1) / (size[a] * size[b]) >= cosine
        firsts.append(a[linked])
        seconds.append(b[linked])
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(firsts), np.concatenate(seconds)) if firsts else (none, none)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches by the pairs."""
    root = np.arange(n)
    while True:
        was = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == was).all():
            return root


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) for each row of ``vectors``.

    Two vectors link if their labels are equal and not null and their cosine in double precision is at least
    ``cosine``. Unit vectors at that cosine are at a squared distance of at most 2 - 2 cosine, so in one of the blocks
    they are within the block's share of it: blocks are range-joined on a grid, and what they find is verified exactly
    and counted in the one cell where it belongs. Equal vectors of a label are one node with a count, so copies are
    never paired; only cells of more than CHUNK nodes are cut smaller or dealt out in tiles. A tile returns counts and a forest, not pairs.

    A vector that is null, zero, of odd length or not finite, a null label and a null key link with nothing: no links
    and a component of its own, with ``kept`` true (false for a null key). Repeated rows link with each other, and rows
    of one key and different vectors are vectors of their own; the smallest key's rows are all kept. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
    dim, kind = dimension(rows, "v"), width(rows, "v")
    turn = Rotation(max(1, dim), cosine)
    ids = vectors.schema[key].dataType.simpleString()

    known = map_arrow(rows.withColumn("label", F.col("label").cast("string")), lambda b: named(b, dim, kind), f"id {ids}, label string, code binary, raw binary")
    usable = known.where("id is not null and label is not null and code is not null")
    # a node is a different vector of a label; its code is a digest of both
    nodes = saved(usable.groupBy("code").agg(F.min("id").cast("long").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("raw").alias("raw")), "nodes")
    found = saved(map_arrow(tiles(nodes.withColumnRenamed("code", "node"), turn, kind, dim), lambda b: tile_rows(b, turn, kind, dim, cosine), "node binary, links long, root binary"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = saved(connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "components")
    least = member.join(nodes.select(F.col("code").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("reached"))
    named_member = member.join(least, "component").select(F.col("node").alias("n"), "reached")
    out = nodes.select("code", "least", "copies").join(links, F.col("code") == F.col("node"), "left").join(named_member, F.col("code") == F.col("n"), "left")
    out = saved(out.select("code", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("reached", "least").alias("component")), "members")
    discard(nodes, found, member)
    all_rows = known.select("id", F.when(F.col("label").isNotNull(), F.col("code")).alias("code")).join(out, "code", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", F.col("id").cast("long")))
    linked = F.when(F.col("id").isNotNull(), F.col("n_links"))
    return all_rows.select(F.col("id").alias(key), F.coalesce(linked, F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def named(batches, dim: int, kind: str):
    """Rows with their vectors' bytes, and a digest of label and vector."""
    for batch in batches:
        mask, x = rows_of(batch.column("v"), dim)
        raw: list = [None] * batch.num_rows
        for i, r in zip(np.flatnonzero(mask).tolist(), as_bytes(x + 0.0, kind), strict=True):
            raw[i] = r
        labels = batch.column("label").to_pylist()
        code = [r and hashlib.blake2b(r + (label or "").encode(), digest_size=16).digest() for r, label in zip(raw, labels, strict=True)]
        yield arrow_batch([("id", batch.schema.field("id").type), ("label", pa.string()), ("code", pa.binary()), ("raw", pa.binary())], [batch.column("id"), batch.column("label"), code, raw])


PLACED = "label string, block int, cell long, node binary, copies long, raw binary"
PLACED_ARROW = [("label", pa.string()), ("block", pa.int32()), ("cell", pa.int64()), ("node", pa.binary()), ("copies", pa.int64()), ("raw", pa.binary())]


def _moved(batch: pa.RecordBatch, block: int, rows: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    at = pa.array(rows)
    return arrow_batch(PLACED_ARROW, [batch.column("label").take(at), np.full(len(rows), block), cell, *(batch.column(c).take(at) for c in ("node", "copies", "raw"))])


def placed(batches, turn: Rotation, kind: str, dim: int):
    """Each node in every cell of every block that its box touches."""
    for batch in batches:
        if batch.num_rows:
            for block, rows, cell in places(turn, turn.turn(from_bytes(batch.column("raw").to_pylist(), kind, dim))):
                yield _moved(batch, block, rows, cell)


def refined(batches, turn: Rotation, kind: str, dim: int, depth: int):
    """Each node of a cell in every cell inside it, by the coordinates of ``depth``, that its box touches."""
    for batch in batches:
        if batch.num_rows:
            y = turn.turn(from_bytes(batch.column("raw").to_pylist(), kind, dim))
            block, cell = batch.column("block").to_numpy(), batch.column("cell").to_numpy()
            for b in np.unique(block).tolist():
                own = np.flatnonzero(block == b)
                for rows, inner in corners(*turn.cells(y[own], b, depth), cell[own]):
                    yield _moved(batch, b, own[rows], inner)


def counted(batches, turn: Rotation, kind: str, dim: int):
    """Nodes by cell, summed up in the task a batch at a time."""
    for batch in batches:
        if batch.num_rows:
            label = np.array(batch.column("label").to_pylist(), dtype=object)
            sums: Counter = Counter()
            for _, rows, cell in places(turn, turn.turn(from_bytes(batch.column("raw").to_pylist(), kind, dim))):
                sums.update(zip(label[rows].tolist(), cell.tolist()))
            yield arrow_batch([("label", pa.string()), ("cell", pa.int64()), ("n", pa.int64())], [[k for k, _ in sums], [c for _, c in sums], list(sums.values())])


TILE = ["label", "block", "depth", "cell", "i", "j"]


def tiles(nodes: DataFrame, turn: Rotation, kind: str, dim: int) -> DataFrame:
    """The tiles of all cells. Cells are counted first: those of up to CHUNK nodes are a tile each; fuller ones are cut into
    chunks, with a tile for every two of them; those too full for that are cut into smaller cells and looked at again.
    Full cells are a table, whose size is known when rows meet it."""
    spark = nodes.sparkSession
    cells = map_arrow(nodes.select("label", "node", "copies", "raw"), lambda b: placed(b, turn, kind, dim), PLACED)
    sums = map_arrow(nodes.select("label", "raw"), lambda b: counted(b, turn, kind, dim), "label string, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    most = max(map(turn.depths, range(len(turn.blocks))))
    done = []
    for depth in range(most):
        full = saved(sums.where(F.col("n") > CHUNK).select("label", "cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "full")
        cells = cells.withColumn("depth", F.lit(depth))
        if not full.limit(1).count():
            done.append(cells.select(*TILE[:4], F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "copies", "raw"))
            break
        known = cells.join(full, ["label", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        last = depth == most - 1
        here = known if last else known.where(F.col("chunks") <= REFINE)
        own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        here = here.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        done.append(here.select(*TILE[:4], F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "copies", "raw"))
        over = known.where(F.col("chunks") > REFINE).select("label", "block", "cell", "node", "copies", "raw")
        if last or not full.where(F.col("chunks") > REFINE).limit(1).count():
            break
        cells = map_arrow(over, lambda b, d=depth + 1: refined(b, turn, kind, dim, d), PLACED)
        sums = cells.groupBy("label", "cell").agg(F.count("*").alias("n"))
    whole = done[0]
    for some in done[1:]:
        whole = whole.unionByName(some)
    return whole.repartition(max(parts(spark), 4), *TILE).sortWithinPartitions(*TILE)


def tile_rows(batches, turn: Rotation, kind: str, dim: int, cosine: float):
    """(node, number of links, root of its tree) for the nodes that link in each tile."""
    now, held = None, []

    def flush():
        if len(held) < 2:
            return
        held.sort()  # so that a tile's result does not hang on the order of its rows
        copies, side = (np.array([h[i] for h in held]) for i in (1, 2))
        x = from_bytes([h[3] for h in held], kind, dim)
        left, right = (np.arange(len(held)), None) if now[4] == now[5] else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        a, b = tile_links(turn, x, now[1], now[2], now[3], left, right, cosine)
        links = np.bincount(a, weights=copies[b], minlength=len(held)) + np.bincount(b, weights=copies[a], minlength=len(held))
        root, some = roots(len(held), a, b), np.flatnonzero(links)
        if len(some):
            yield arrow_batch([("node", pa.binary()), ("links", pa.int64()), ("root", pa.binary())], [[held[i][0] for i in some], pa.array(links[some].astype(np.int64)), [held[i][0] for i in root[some]]])

    for batch in batches:
        cols = (batch.column(c).to_pylist() for c in (*TILE, "node", "copies", "side", "raw"))
        for *at, node, copies, side, raw in zip(*cols, strict=True):
            if at != now:
                yield from flush()
                now, held = at, []
            held.append((node, copies, side, raw))
    yield from flush()
