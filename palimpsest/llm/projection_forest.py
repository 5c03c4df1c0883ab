"""Near-duplicate embeddings by a forest of random-projection trees.

A tree splits the vectors by the median of their projections on a random direction, again and again; vectors close to
a border go to both sides (spill overlap). The first splits are learned from at most `sample_rows` vectors, chosen by
hash; then every vector is dealt to its leaves in every tree. Leaves grow with the input, so a leaf that holds more
vectors of a label than `leaf_rows` grows a tree of its own, learned in a task from vectors of that leaf and label, with
directions that no other leaf has and the same spill; and so on until the leaves are small. A split that would spare
too few comparisons is not made; such leaves are compared whole.

How many trees there are follows from the pairs that they find: for vectors of the sample a partner is made at the
least similarity that links, half of them in any direction and half towards another vector. The partners are dealt like
all vectors, at the depth that the input has, and trees are added until hardly a pair shares no cell. If `MOST_TURNS`
turns do not get there, all vectors of a label are compared with each other.

Vectors that share a leaf and a label are compared, in tiles of a bounded number of rows, so a leaf full of near
copies is many small tasks. A tile does not give its pairs but a spanning forest of the links it found, one row for
each vector at most. Joined over all trees these give the components. As a link never leaves its component, the links
of a vector are then counted exactly by comparing it with its component, in tiles again; only counts are given.
Equal vectors of a label are one node with a count throughout.

Defined results: vectors that are null, zero or hold null or non-finite numbers, and rows with a null label, link with
nothing: no links, a component of their own. Vectors of different lengths link with nothing of another length. Rows
that repeat a vec_id count as vectors of their own. A component is named by its smallest vec_id (null if none has
one), and a row is kept if its vec_id is that. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import hashed_sample, stage, tiled
from palimpsest.llm.components import components

LEAST = 0.93
TREES = 6
SPILL = 0.02
SAMPLE_ROWS = 20_000
SAMPLE_LEAF = 256
LEAF_ROWS = 512
#: A leaf's own tree is learned from about so many of its vectors, and split while a part holds this many of them.
DEEP_ROWS, DEEP_LEAF = 1_024, 32
#: A split is made if it leaves less than this share of the comparisons; so many directions are tried.
SPARED, TRIES = 0.8, 4
#: Made pairs, the share of them that must share a cell, and the turns of TREES trees to get there.
PROBES, LEAST_MET, MOST_TURNS = 2_000, 0.9995, 16
TILE = 512
KEYS = ["leaf", "label", "size"]


class Forest:
    """Splits for vectors of one length. A node of a tree is (direction, threshold) and two children."""

    def __init__(self, sample: np.ndarray, seed: int, trees: int = TREES, spill: float = SPILL, leaf: int = SAMPLE_LEAF) -> None:
        self.seed, self.size, self.spill, self.tried, self.n_leaves = seed, sample.shape[1], spill, 0, 0
        self.used: list[int] = []
        self.trees = [self._split(sample, np.arange(len(sample)), leaf) for _ in range(trees)]

    def _direction(self, number: int) -> np.ndarray:
        found = np.random.default_rng([self.seed, self.size, number]).normal(size=self.size)
        return found / np.linalg.norm(found)

    @cached_property
    def directions(self) -> np.ndarray:
        return np.array([self._direction(k) for k in self.used]).reshape(-1, self.size)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "directions"}

    @classmethod
    def of(cls, state: bytes) -> Forest:
        forest = cls.__new__(cls)
        forest.__dict__.update(pickle.loads(state))
        return forest

    def state(self) -> bytes:
        return pickle.dumps(self.__getstate__())

    def _split(self, sample: np.ndarray, rows: np.ndarray, leaf: int):
        for _ in range(TRIES if len(rows) > leaf else 0):
            self.tried += 1
            along = sample[rows] @ self._direction(self.tried)
            border = float(np.median(along))
            left, right = rows[along < border + self.spill], rows[along >= border - self.spill]
            if len(left) ** 2 + len(right) ** 2 < SPARED * len(rows) ** 2:
                own = len(self.used)
                self.used.append(self.tried)
                return own, border, self._split(sample, left, leaf), self._split(sample, right, leaf)
        self.n_leaves += 1
        return self.n_leaves - 1

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): every leaf of every vector."""
        along = vectors @ self.directions.T
        found = []
        todo = [(tree, np.arange(len(vectors))) for tree in self.trees]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, tuple):
                own, border, left, right = node
                todo.append((left, rows[along[rows, own] < border + self.spill]))
                todo.append((right, rows[along[rows, own] >= border - self.spill]))
            elif len(rows):
                found.append((rows, np.full(len(rows), node)))
        if not found:
            return (np.zeros(0, int),) * 2
        return tuple(np.concatenate(c) for c in zip(*found))


def unit(blobs: list[bytes]) -> np.ndarray:
    vectors = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def vectors_of(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (binary of doubles, null if unusable) and node (digest of label and vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.array([n or 0 for n in lists.value_lengths().to_pylist()])
            edges = np.concatenate([[0], np.cumsum(sizes)])
            blobs = []
            for a, b in zip(edges, edges[1:]):
                own = values[a:b] + 0.0  # no negative zeros
                blobs.append(own.tobytes() if b > a and np.isfinite(own).all() and own.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["vec_id", "label", "vector"])

    read = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    read = read.mapInArrow(run, "vec_id long, label string, vector binary")
    node = F.unhex(F.md5(F.concat(F.encode(F.col("label"), "utf-8"), F.lit(b"\0"), "vector")))
    return read.withColumn("node", F.when(F.col("label").isNotNull() & F.col("vector").isNotNull(), node))


def sampled(nodes: DataFrame, sample_rows: int = SAMPLE_ROWS) -> pa.Table:
    """node, label and vector of the first nodes by hash."""
    return hashed_sample(nodes.select("node", "label", "vector"), sample_rows, "node").toArrow()


def fitted(nodes: DataFrame | pa.Table, seed: int, sample_rows: int = SAMPLE_ROWS, **settings) -> dict[int, Forest]:
    """A forest for each length of vector in the sample."""
    sample = nodes if isinstance(nodes, pa.Table) else sampled(nodes, sample_rows)
    by_size: dict[int, list[bytes]] = {}
    for blob in sample.column("vector").to_pylist():
        by_size.setdefault(len(blob) // 8, []).append(blob)
    return {n: Forest(unit(blobs), seed, **settings) for n, blobs in sorted(by_size.items())}


def probes(sample: pa.Table, least: float, seed: int) -> pa.Table:
    """The first nodes of the sample, each with the vector of a partner that is just similar enough to link."""
    sample = sample.slice(0, PROBES)
    blobs = sample.column("vector").to_pylist()
    sizes = np.array([len(b) // 8 for b in blobs])
    generator = np.random.default_rng(seed)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        own = unit([blobs[i] for i in rows])
        away = generator.normal(size=own.shape)
        away[::2] = np.roll(own, 1, axis=0)[::2]
        away -= (away * own).sum(1, keepdims=True) * own
        length = np.linalg.norm(away, axis=1, keepdims=True)
        away = np.divide(away, length, out=np.zeros_like(away), where=length > 1e-9)
        partners = least * own + (1 - least**2) ** 0.5 * away
        for i, partner in zip(rows, partners):
            blobs[i] = partner.tobytes()
    return sample.set_column(sample.column_names.index("vector"), "vector", pa.array(blobs, pa.binary()))


def _cell() -> Column:
    return F.struct(*KEYS).alias("cell")


def _deepened(placed: DataFrame, leaf_rows: int) -> DataFrame:
    """The nodes dealt on, until no leaf has more than so many of a label or none of the larger ones can be split."""

    def learn(table: pa.Table) -> pa.Table:
        leaf, label, size, n = (table.column(c)[0].as_py() for c in (*KEYS, "_n"))
        vectors = unit(table.column("vector").to_pylist())
        own = max(DEEP_LEAF, -(-leaf_rows * len(vectors) // n))
        tree = Forest(vectors, zlib.crc32(f"{leaf} {label}".encode("utf-8", "surrogatepass")), trees=1, leaf=own)
        rows = [{"leaf": leaf, "label": label, "size": size, "split": tree.state()}] if tree.used else []
        kinds = [("leaf", pa.string()), ("label", pa.string()), ("size", pa.int64()), ("split", pa.binary())]
        return pa.Table.from_pylist(rows, schema=pa.schema(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Forest] = {}
        for batch in batches:
            splits = batch.column(0).dictionary_encode()
            which = splits.indices.to_numpy(zero_copy_only=False)
            for k, split in enumerate(splits.dictionary.to_pylist()):
                if split not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[split] = Forest.of(split)
                part = batch.take(pa.array(np.flatnonzero(which == k)))
                at, leaf = known[split].leaves(unit(part.column(1).to_pylist()))
                part = part.take(pa.array(at))
                names = [f"{a}.{b}" for a, b in zip(part.column(2).to_pylist(), leaf.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:2], pa.array(names, pa.string()), *part.columns[3:]], names=columns)

    columns = ["vector", "leaf", "label", "size", "node", "probe"]
    placed, done = placed.select(*columns), []
    while True:
        real = placed.where(~F.col("probe"))
        counts = stage(real.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > leaf_rows), "large")
        if counts.isEmpty():
            break
        place = F.xxhash64("leaf", "node").bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))
        chosen = real.join(counts, KEYS).where(place * F.col("_n") <= F.lit(float(DEEP_ROWS))).select(*KEYS, "_n", "vector")
        splits = stage(chosen.groupBy(*KEYS).applyInArrow(learn, "leaf string, label string, size long, split binary"), "splits")
        if splits.isEmpty():
            break
        done.append(placed.join(splits, KEYS, "left_anti").select(*columns))
        rows = placed.join(splits, KEYS).select("split", *columns)
        placed = stage(rows.mapInArrow(run, "vector binary, leaf string, label string, size long, node binary, probe boolean"), "leaves")
    for rows in done:
        placed = placed.union(rows)
    return placed


def dealt(nodes: DataFrame, forests: dict[int, Forest], leaf_rows: int = LEAF_ROWS, name: str = "") -> DataFrame:
    """(cell, node, vector, probe): the nodes in every cell that they belong to; cells' names begin with the name."""
    shared = nodes.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(2).to_pylist()
            sizes = np.array([len(b) // 8 for b in blobs])
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                forest = shared.value.get(int(n))
                if forest:
                    at, leaf = forest.leaves(unit([blobs[i] for i in rows]))
                else:  # a length that the sample lacks
                    at, leaf = np.arange(len(rows)), np.full(len(rows), -1)
                part = batch.take(pa.array(rows[at]))
                extra = [pa.array([f"{name}{k}" for k in leaf.tolist()], pa.string()), pa.array(np.full(len(at), n), pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=["node", "label", "vector", "probe", "leaf", "size"])

    probe = "probe" if "probe" in nodes.columns else F.lit(False).alias("probe")
    fields = "node binary, label string, vector binary, probe boolean, leaf string, size long"
    placed = stage(nodes.select("node", "label", "vector", probe).mapInArrow(run, fields), "leaves")
    return _deepened(placed, leaf_rows).select(_cell(), "node", "vector", "probe")


def cells_of(nodes: DataFrame, least: float = LEAST, seed: int = 7, leaf_rows: int = LEAF_ROWS, trees: int = TREES) -> DataFrame:
    """(cell, node, vector): cells of as many trees as it takes for pairs at the least similarity to share one."""
    sample = sampled(nodes)
    pairs = probes(sample, least, seed)
    made = nodes.sparkSession.createDataFrame(pairs).select("node", "label", "vector", F.lit(True).alias("probe"))
    both = nodes.select("node", "label", "vector", F.lit(False).alias("probe")).union(made)
    cells, met = [], set()
    for turn in range(MOST_TURNS):
        found = stage(dealt(both, fitted(sample, seed + turn, trees=trees), leaf_rows, f"{turn}-"), "cells")
        real = found.where(~F.col("probe")).drop("probe")
        cells.append(real)
        shared = found.where("probe").select("cell", "node").join(real.select("cell", "node"), ["cell", "node"], "left_semi")
        met.update(bytes(r.node) for r in shared.select("node").distinct().collect())
        if len(met) >= LEAST_MET * len(pairs):
            break
    else:
        size = F.floor(F.octet_length("vector") / 8).cast("long").alias("size")
        return nodes.select("node", "label", "vector", size, F.lit("").alias("leaf")).select(_cell(), "node", "vector")
    for more in cells[1:]:
        cells[0] = cells[0].union(more)
    return cells[0]


def _spanning(close: np.ndarray) -> np.ndarray:
    """For each row the smallest row that it is linked with, over any number of links."""
    names = np.arange(len(close))
    while True:
        near = np.where(close, names[None, :], len(close)).min(1)
        lower = np.minimum(names, near)
        lower = lower[lower]
        if (lower == names).all():
            return names
        names = lower


def links_in_cells(cells: DataFrame, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """Links (a, b) of nodes that span what each tile found."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        vectors = unit(table.column("vector").to_pylist())
        names = _spanning(vectors @ vectors.T >= least)
        rows = np.flatnonzero(names != np.arange(len(names)))
        return pa.table({"a": pa.array([nodes[i] for i in rows], pa.binary()), "b": pa.array([nodes[names[i]] for i in rows], pa.binary())})

    tiles = tiled(cells, "cell", tile)
    return tiles.groupBy("cell", "low", "high").applyInArrow(run, "a binary, b binary").distinct()


def links_counted(members: DataFrame, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """(node, links) of the members (component, node, vector, copies), each compared with its whole component."""

    def run(table: pa.Table) -> pa.Table:
        vectors, copies = unit(table.column("vector").to_pylist()), table.column("copies").to_numpy()
        own = table.column("own").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        close = vectors @ vectors.T >= least
        np.fill_diagonal(close, False)
        if low != high:  # pairs inside a tile are counted where low = high
            close &= own[:, None] != own[None, :]
        return pa.table({"node": table.column("node"), "links": pa.array(close @ copies)})

    tiles = tiled(members, "component", tile)
    found = tiles.groupBy("component", "low", "high").applyInArrow(run, "node binary, links long")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, least: float = LEAST, seed: int = 7) -> DataFrame:
    """vec_id, label, n_links and component_id of every row."""
    vectors = stage(vectors_of(rows), "vectors")
    nodes = stage(
        vectors.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("_least")),
        "nodes",
    )
    found = stage(components(links_in_cells(cells_of(nodes, least, seed), least)), "components")
    members = nodes.join(found, "node").select("component", "node", "vector", "copies")
    counted = links_counted(members, least)
    named = nodes.select("node", "copies", "_least").join(found, "node", "left").join(counted, "node", "left")
    named = stage(named.withColumn("component", F.coalesce("component", "node")), "counted")
    names = named.groupBy("component").agg(F.min("_least").alias("component_id"))
    named = named.join(names, "component").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    alone = vectors.where(F.col("node").isNull()).select(
        "vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    linked = vectors.where(F.col("node").isNotNull()).select("vec_id", "label", "node").join(named, "node")
    return linked.select("vec_id", "label", "n_links", "component_id").unionByName(alone)
