"""Hard negatives by angular triangle filtering.

Each vector becomes whole numbers, floor(scale * x). A score is the integer inner product of two rows; higher scores come
first, ties by the smaller vec_id. An anchor's positives are its first rows of its own label, and for each of them its
negatives are the first rows of other labels whose score is within a window below the positive's.

Stored with each row are its norm and its angles to a few reference directions. For two rows with angles a and b to one
direction, the angle between them is at least |a - b| and at most a + b and 2 pi - a - b; the tightest of these over all
directions gives an interval for the cosine, and times the norms one for the score, rounded outwards by more than the
arithmetic can be off. Only pairs whose interval overlaps the window in question get an integer score: for positives
what may still be among the first, for negatives the windows of the anchor's positives. Tiles of rows near the same
direction and tiles of anchors have such intervals too, and pairs of tiles without an overlap never meet.

The anchors are a stated query set, compared with all rows in tiles of bounded size: (tile of rows, tile of anchors) is
one group of a cogroup, so no label and no crowd around a direction meets in one task. A tile returns the first few of
each anchor; what is merged afterwards is limited before the shuffle. Reference directions are chosen from at most
`SAMPLE_ROWS` rows, the first by hash; intervals are true for any directions, so the result does not depend on them.
Where vectors have hundreds of dimensions and no clusters, angles hardly differ, and nearly all pairs are scored.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. Rows that repeat
a vec_id are rows of their own; an anchor is not its own partner. A null vec_id comes last among ties (as does 2^63 - 1)
and is no anchor unless the caller's test says so. Vectors of different lengths have no score; empty vectors score 0. Numbers
beyond 32 bits after scaling count as the nearest of 32 bits, and scores beyond 64 bits as the nearest of 64 bits. An
anchor with fewer rows than asked for gets all; a positive with a negative score has no window. An empty table gives an
empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import hashed_sample, stage

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative's score is at least so many per cent of the positive's, and at most the positive's.
LEAST_PERCENT = 80
DIRECTIONS = 8
SAMPLE_ROWS = 2_048
ROW_TILE, ANCHOR_TILE = 1_024, 2_048
#: What angles may be off (an arc cosine near 1 is off by the root of the rounding), and products of norms and cosines.
ANGLE_SLACK, SCORE_SLACK = 1e-7, 1e-9
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Above this share of pairs left, a whole product is cheaper than single ones.
DENSE = 0.1


def whole_numbers(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -(2**31), 2**31 - 1).astype(np.int32)


def directions(vectors: np.ndarray, most: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors of rows that are far apart: each next one is the farthest from those before."""
    norms = np.linalg.norm(vectors, axis=1)
    units = vectors[norms > 0] / norms[norms > 0, None]
    chosen = units[:1]
    while 0 < len(chosen) < most:
        nearest = (units @ chosen.T).max(1)
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-6:
            break
        chosen = np.vstack([chosen, units[far]])
    return chosen


def _usable(rows: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)


def _by_size(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, vectors) for each length of vector."""
    lengths = column.value_lengths().to_numpy()
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield int(size), at, values[starts[at][:, None] + np.arange(size)[None, :]]


def references(rows: DataFrame, scale: float) -> dict[int, np.ndarray]:
    """Directions for each length of vector that the sample has."""
    sample = hashed_sample(rows, SAMPLE_ROWS, "vec_id", "label").select("embedding").toArrow().column(0).combine_chunks()
    return {size: directions(whole_numbers(vectors, scale).astype(float)) for size, _, vectors in _by_size(sample) if size}


def stored(rows: DataFrame, anchors: Column, scale: float = SCALE) -> DataFrame:
    """row (a number of its own), vec_id, label, anchor, size, ints, norm, angles and home, the nearest direction."""
    usable = _usable(rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", F.coalesce(anchors, F.lit(False)).alias("anchor")))
    shared = usable.sparkSession.sparkContext.broadcast(references(usable, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for size, at, vectors in _by_size(batch.column(2)):
                ints = whole_numbers(vectors, scale)
                norms = np.linalg.norm(ints.astype(float), axis=1)
                axes = known.get(size, np.zeros((0, size)))
                cosines = ints @ axes.T / np.where(norms > 0, norms, 1)[:, None]
                angles = np.arccos(np.clip(cosines, -1, 1))
                home = angles.argmin(1) if len(axes) else np.full(len(at), -1)
                part = batch.take(pa.array(at))
                edges = pa.array(np.arange(len(at) + 1) * len(axes), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + len(at))), part.column(0), part.column(1), part.column(3),
                        pa.array(np.full(len(at), size)), pa.array([r.tobytes() for r in ints.astype("<i4")], pa.binary()),
                        pa.array(norms), pa.ListArray.from_arrays(edges, pa.array(angles.ravel())), pa.array(home.astype(np.int32)),
                    ],
                    names=["row", "vec_id", "label", "anchor", "size", "ints", "norm", "angles", "home"],
                )
                number += len(at)

    fields = "row long, vec_id long, label long, anchor boolean, size long, ints binary, norm double, angles array<double>, home int"
    return stage(usable.mapInArrow(run, fields), "angles")


@dataclass
class Side:
    """The rows of one tile."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    ints: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Side:
        n, size = table.num_rows, table.column("size")[0].as_py()
        ints = np.frombuffer(b"".join(table.column("ints").to_pylist()), "<i4").reshape(n, size)
        angles = table.column("angles").combine_chunks().flatten().to_numpy().reshape(n, -1)
        ids = table.column("vec_id").combine_chunks().fill_null(HIGHEST).to_numpy()
        return Side(table.column("row").to_numpy(), ids, table.column("label").to_numpy(), ints, table.column("norm").to_numpy(), angles)


def score_bounds(anchors: Side, rows: Side) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that each anchor may have with each row."""
    nearest = np.zeros((len(anchors.norms), len(rows.norms)))
    farthest = np.full_like(nearest, np.pi)
    for a, b in zip(anchors.angles.T, rows.angles.T):
        np.maximum(nearest, np.abs(a[:, None] - b[None, :]), out=nearest)
        both = a[:, None] + b[None, :]
        np.minimum(farthest, np.minimum(both, 2 * np.pi - both), out=farthest)
    norms = anchors.norms[:, None] * rows.norms[None, :]
    slack = norms * SCORE_SLACK + 1
    low = norms * np.cos(np.minimum(np.pi, farthest + ANGLE_SLACK)) - slack
    return low, norms * np.cos(np.maximum(0, nearest - ANGLE_SLACK)) + slack


def integer_scores(anchors: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The exact scores of the wanted pairs, LOWEST elsewhere."""
    out = np.full(wanted.shape, LOWEST)
    if not wanted.any():
        return out
    size = anchors.shape[1]
    most = size * int(np.abs(anchors.astype(np.int64)).max(initial=0)) * int(np.abs(rows.astype(np.int64)).max(initial=0))
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
    a, b = anchors.astype(kind), rows.astype(kind)
    if kind is object:
        a, b = np.vectorize(int, otypes=[object])(anchors).reshape(anchors.shape), np.vectorize(int, otypes=[object])(rows).reshape(rows.shape)
    if wanted.mean() > DENSE:
        found = a @ b.T
        found = np.clip(found, LOWEST, HIGHEST).astype(np.int64) if kind is object else found.astype(np.int64)
        return np.where(wanted, found, LOWEST)
    at, of = np.nonzero(wanted)
    step = max(1, 4_000_000 // max(1, size))
    for low in range(0, len(at), step):
        x, y = at[low : low + step], of[low : low + step]
        found = (a[x] * b[y]).sum(1)
        out[x, y] = np.clip(found, LOWEST, HIGHEST).astype(np.int64) if kind is object else found.astype(np.int64)
    return out


def first_of_each(scores: np.ndarray, able: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, rows): positions of the first few able rows of each anchor, by score, ties by id."""
    if scores.shape[1] > most:
        able = able & (scores >= _kth(np.where(able, scores, LOWEST), most)[:, None])
    at, of = np.nonzero(able)
    order = np.lexsort((ids[of], ~scores[at, of], at))  # ~x falls as x grows, and cannot overflow
    at, of = at[order], of[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < most
    return at[kept], of[kept]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each line."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _tile_positives(rows: pa.Table, anchors: pa.Table, most: int) -> pa.Table:
    """The first rows of each anchor in a tile of its own label."""
    names = ["anchor_row", "positive_id", "positive_score"]
    if not rows.num_rows or not anchors.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    a, b = Side.of(anchors), Side.of(rows)
    low, high = score_bounds(a, b)
    other = a.rows[:, None] != b.rows[None, :]
    if other.shape[1] > most:  # what is certainly below the first few of this tile
        other &= high >= _kth(np.where(other, low, -np.inf), most)[:, None]
    scores = integer_scores(a.ints, b.ints, other)
    at, of = first_of_each(scores, other, b.ids, most)
    return pa.table({"anchor_row": a.rows[at], "positive_id": b.ids[of], "positive_score": scores[at, of]})


def _tile_negatives(rows: pa.Table, anchors: pa.Table, most: int) -> pa.Table:
    """For each anchor and positive the first rows of a tile that are inside the window and of another label."""
    names = ["anchor_row", "place", "negative_id", "negative_score"]
    if not rows.num_rows or not anchors.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    a, b = Side.of(anchors), Side.of(rows)
    windows = [w.to_pylist() for w in (anchors.column("lows"), anchors.column("highs"))]
    most_windows = max(len(w) for w in windows[0])
    lows, highs = (np.array([w + [empty] * (most_windows - len(w)) for w in side]) for side, empty in zip(windows, (HIGHEST, LOWEST)))
    low, high = score_bounds(a, b)
    other = (a.labels[:, None] != b.labels[None, :]) & (high >= lows.min(1)[:, None]) & (low <= highs.max(1)[:, None])
    scores = integer_scores(a.ints, b.ints, other)
    found = []
    for place in range(most_windows):
        inside = other & (scores >= lows[:, place, None]) & (scores <= highs[:, place, None])
        held = np.flatnonzero(inside.any(1))
        at, of = first_of_each(scores[held], inside[held], b.ids, most)
        at = held[at]
        found.append((a.rows[at], np.full(len(at), place), b.ids[of], scores[at, of]))
    return pa.table(dict(zip(names, (np.concatenate(x) for x in zip(*found)))))


def _first(rows: DataFrame, most: int, keys: list[str], score: str, vec_id: str) -> DataFrame:
    """The first rows of each key with their 1-based rank. Spark limits each task's rows before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(vec_id))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _chunk(of: str) -> Column:
    return F.pmod(F.xxhash64("row"), F.col(of))


def _chunks(of: Column, tile: int) -> Column:
    return F.ceil(of / F.lit(float(tile))).cast("long")


def _all_chunks(of: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))


def positives(rows: DataFrame, most: int = POSITIVES, row_tile: int = ROW_TILE, anchor_tile: int = ANCHOR_TILE) -> DataFrame:
    """anchor_row, positive_id, positive_score and rank of the stored rows' anchors."""
    cells = rows.groupBy("size", "label").agg(F.count(F.lit(1)).alias("_n"), F.count_if("anchor").alias("_m"))
    cells = stage(
        cells.where("_m > 0").select("size", "label", _chunks(F.col("_n"), row_tile).alias("_k"), _chunks(F.col("_m"), anchor_tile).alias("_j")), "labels"
    )
    keys = ["size", "label", "chunk", "anchors"]
    both = rows.join(cells, ["size", "label"])
    whole = both.select("*", _chunk("_k").alias("chunk"), _all_chunks("_j").alias("anchors"))
    asked = both.where("anchor").select("*", _chunk("_j").alias("anchors"), _all_chunks("_k").alias("chunk"))

    def run(rows_: pa.Table, anchors: pa.Table) -> pa.Table:
        return _tile_positives(rows_, anchors, most)

    columns = [*keys, "row", "vec_id", "ints", "norm", "angles"]
    found = _of_tiles(whole.select(*columns), asked.select(*columns), keys, run, "anchor_row long, positive_id long, positive_score long")
    return _first(found, most, ["anchor_row"], "positive_score", "positive_id")


def _of_tiles(whole: DataFrame, asked: DataFrame, keys: list[str], run, fields: str) -> DataFrame:
    # Both come from the same rows; new names for the columns tell the sides apart.
    whole, asked = whole.toDF(*whole.columns), asked.toDF(*asked.columns)
    return whole.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, fields)


def _tiles(rows: DataFrame, tile: int) -> DataFrame:
    """Rows with `tile`, a number for at most about so many rows of one length and home."""
    cells = rows.groupBy("size", "home").agg(_chunks(F.count(F.lit(1)), tile).alias("_k"))
    # One row for each direction and length.
    before = F.sum("_k").over(Window.orderBy("size", "home").rowsBetween(Window.unboundedPreceding, -1))
    cells = stage(cells.withColumn("_before", F.coalesce(before, F.lit(0))), "homes")
    return rows.join(cells, ["size", "home"]).withColumn("tile", F.col("_before") + _chunk("_k")).drop("_before", "_k")


def _extremes(rows: DataFrame, prefix: str, *more: Column) -> DataFrame:
    """For each tile the least and greatest norm, and those of the angle to each direction."""
    ends = [f("norm").alias(f"{prefix}_{n}_norm") for f, n in ((F.min, "low"), (F.max, "high"))]
    for k in range(DIRECTIONS):
        ends += [f(F.get("angles", F.lit(k))).alias(f"{prefix}_{n}_{k}") for f, n in ((F.min, "low"), (F.max, "high"))]
    return rows.groupBy("size", "tile").agg(*ends, *more).withColumnRenamed("tile", f"{prefix}_tile")


def _tile_pairs(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(tile, anchors): tiles of rows and of anchors where some score may be inside some window."""
    row_tiles = stage(_extremes(rows, "row"), "row-tiles")
    ends = _extremes(anchors, "anchor", F.min(F.array_min("lows")).alias("_low"), F.max(F.array_max("highs")).alias("_high"))
    count = (row_tiles.agg(F.max("row_tile")).first()[0] or 0) + 1
    pairs = ends.withColumn("row_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    pairs = pairs.join(row_tiles, ["size", "row_tile"])
    nearest, farthest = F.lit(0.0), F.lit(float(np.pi))
    for k in range(DIRECTIONS):
        a, b = [F.col(f"anchor_{n}_{k}") for n in ("low", "high")], [F.col(f"row_{n}_{k}") for n in ("low", "high")]
        nearest = F.greatest(nearest, a[0] - b[1], b[0] - a[1])  # nulls, of directions that are not there, are skipped
        most, least = a[1] + b[1], a[0] + b[0]
        farthest = F.least(farthest, F.when(most <= np.pi, most).when(least >= np.pi, 2 * np.pi - least))

    def reach(cosine: Column, up: bool) -> Column:
        widest, least = (F.col(f"anchor_{n}_norm") * F.col(f"row_{n}_norm") for n in ("high", "low"))
        norms = F.when((cosine > 0) == F.lit(up), widest).otherwise(least)
        return norms * cosine + (1 if up else -1) * (widest * 2 * SCORE_SLACK + 1)

    high = reach(F.cos(F.greatest(F.lit(0.0), nearest - ANGLE_SLACK)), True)
    low = reach(F.cos(F.least(F.lit(float(np.pi)), farthest + ANGLE_SLACK)), False)
    return stage(pairs.where((high >= F.col("_low")) & (low <= F.col("_high"))).select(F.col("row_tile").alias("tile"), F.col("anchor_tile").alias("anchors")), "tile-pairs")


def mine(
    rows: DataFrame, anchors: Column, *, scale: float = SCALE, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT, row_tile: int = ROW_TILE, anchor_tile: int = ANCHOR_TILE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `anchors` tests the rows' columns."""
    rows = stored(rows, anchors, scale)
    first = stage(positives(rows, n_positives, row_tile, anchor_tile), "positives")
    # The least whole number that is not below the share; decimals, as a long times the percentage may exceed a long.
    share = F.ceil(F.col("positive_score").cast("decimal(38,0)") * F.lit(least_percent) / F.lit(100)).cast("long")
    windows = first.where(F.col("positive_score") >= share).select(
        "anchor_row", F.struct(F.col("rank").alias("place"), share.alias("low"), F.col("positive_score").alias("high"), F.col("positive_id").alias("id")).alias("_w")
    )
    # An anchor has so few positives that its list is bounded.
    windows = windows.groupBy("anchor_row").agg(F.sort_array(F.collect_list("_w")).alias("_windows"))
    asked = rows.where("anchor").join(windows, F.col("row") == F.col("anchor_row")).select(
        "row", "vec_id", "label", "size", "ints", "norm", "angles", "home",
        F.col("_windows.low").alias("lows"), F.col("_windows.high").alias("highs"), F.col("_windows.id").alias("positive_ids"),
    )
    asked = stage(_tiles(asked, anchor_tile), "windows")
    whole = _tiles(rows, row_tile)
    pairs = _tile_pairs(whole, asked)

    def run(rows_: pa.Table, anchors_: pa.Table) -> pa.Table:
        return _tile_negatives(rows_, anchors_, n_negatives)

    columns, keys = ["row", "vec_id", "label", "size", "ints", "norm", "angles"], ["tile", "anchors"]
    left = whole.select("tile", *columns).join(pairs, "tile")
    right = asked.select(F.col("tile").alias("anchors"), *columns, "lows", "highs").join(pairs, "anchors")
    found = _of_tiles(left, right, keys, run, "anchor_row long, place long, negative_id long, negative_score long")
    found = _first(found, n_negatives, ["anchor_row", "place"], "negative_score", "negative_id")
    named = asked.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), "positive_ids", "highs")

    def real(vec_id: Column) -> Column:
        return F.when(vec_id != int(HIGHEST), vec_id)

    return found.join(named, "anchor_row").select(
        "anchor_id",
        real(F.get("positive_ids", F.col("place").cast("int"))).alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        real(F.col("negative_id")).alias("negative_id"),
        F.get("highs", F.col("place").cast("int")).alias("positive_score"),
        "negative_score",
    )
