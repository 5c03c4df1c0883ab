"""Near-duplicate documents by DartMinHash signatures, banded joining and exact checks.

A text is its set of five-word shingles (with `weighted`, each as often as it occurs). Every element owns a region as
large as its weight, cut into unit regions. Darts hit a unit region at hashed times, one after the other, each at a
hashed coordinate of the signature; a coordinate keeps its earliest dart. As darts depend on the region alone, two
texts agree at a coordinate with the probability of their (weighted) Jaccard similarity. About k ln k + 2k darts are
thrown for a text whatever its size; one with a coordinate still empty gets more.

Signatures are cut into bands, and texts that agree on a band are in one bucket. At similarity 0.8, thirty bands of
five coordinates miss one pair in 150,000. No bucket is expanded into its pairs:
1. equal sets are one node with a count, found by their digest;
2. in turns, each bucket has a pivot, chosen by hash, and each node whose component differs from the pivot's gets
   one pivot to be checked against. Accepted pairs join components. This goes on until few nodes move;
3. what is left is exact: buckets that hold several components are compared in tiles of bounded size, each pair of
   nodes of different components in the first band that they share. Only accepted pairs leave a task.
A comparison of signatures, three bits a coordinate, precedes each check and passes all but one in a million of the
pairs that are similar enough.
A check reads both whole sets. So two documents end in one class only along links that were checked.

Defined results: a text of one to four words is one shingle; a text without words (null, empty) is a class of its own,
for each row. Rows that repeat a doc_id count by their texts. A class is named by its smallest doc_id, which is kept;
rows with a null doc_id are kept only if nobody in their class has an id, and such a class has a null name. Other
columns pass unchanged. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE, as_row, partitions, stage, tiled
from palimpsest.llm.components import components
from palimpsest.llm.packing import by_size

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 30, 5
COORDINATES = BANDS * ROWS
PLANES, LANES = 3, -(-COORDINATES // 64)
#: Coordinates whose three bits differ: at similarity 0.8 the mean is 26.3 and the deviation 4.7; this is five above.
MOST_APART = 50
#: Turns with pivots go on while more than one node in so many moves.
FEW = 20
#: A task holds two tiles of a bucket at a time: about so many nodes each, and so many bytes of their sets, but one
#: set more at most.
TILE = 2048
TILE_BYTES = 32 << 20
KEPT_WORDS = 200_000
BATCH_BYTES = 2_000_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle hashes of many texts at a time."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.hashes: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self.hashes) >= KEPT_WORDS:
            self.hashes.clear()
        if len(word) <= 64:
            self.hashes[word] = value
        return value

    def of(self, texts: list[str], weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(elements, edges): the sorted distinct elements of each text laid end to end."""
        kept, slow, n = self.hashes.get, self._hash, self.words
        flat, lengths = [], []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").split()
            lengths.append(len(words))
            flat.extend([kept(w) or slow(w) for w in words])
            if 0 < len(words) < n:  # filled up to one shingle
                flat.extend([0] * (n - len(words)))
                lengths[-1] = n
        words = np.array(flat, np.uint64)
        starts = np.cumsum([0, *lengths])
        shingles = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for i in range(n):
            shingles = shingles * _GOLDEN + mixed(words[i : len(words) - n + 1 + i])
        shingles = mixed(shingles)
        owner = np.repeat(np.arange(len(texts)), lengths)
        whole = owner[: len(shingles)] == owner[n - 1 :] if len(shingles) else np.zeros(0, bool)
        shingles, owner = shingles[whole], owner[: len(whole)][whole]
        order = np.lexsort((shingles, owner))
        shingles, owner = shingles[order], owner[order]
        if len(shingles):
            first = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])])
            if weighted:  # the second, third, ... unit region of an element
                runs = np.arange(len(shingles)) - np.maximum.accumulate(np.where(first, np.arange(len(shingles)), 0))
                shingles = mixed(shingles + runs.astype(np.uint64) * _GOLDEN)
                order = np.lexsort((shingles, owner))
                shingles, owner = shingles[order], owner[order]
            else:
                shingles, owner = shingles[first], owner[first]
        return shingles, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(elements: np.ndarray, edges: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """For each text and coordinate the time of the earliest dart. Texts without elements keep infinite times."""
    sizes = np.diff(edges)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(divide="ignore"):
        until = np.where(sizes > 0, (k * np.log(k) + 2 * k) / sizes, -1.0)
    best = np.full(len(sizes) * k, np.inf)
    throws = np.zeros(len(elements), np.uint64)
    darts = mixed(elements + _GOLDEN)

    def wait(x: np.ndarray) -> np.ndarray:
        return -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)

    times = wait(mixed(darts))
    open_ = np.arange(len(elements))
    while len(open_):
        flying = open_[times[open_] <= until[owner[open_]]]
        while len(flying):
            at = (mixed(darts[flying] ^ _MIX[0]) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, owner[flying] * k + at, times[flying])
            throws[flying] += np.uint64(1)
            darts[flying] = mixed(elements[flying] + (throws[flying] + np.uint64(1)) * _GOLDEN)
            times[flying] += wait(mixed(darts[flying]))
            flying = flying[times[flying] <= until[owner[flying]]]
        lacking = np.isinf(best.reshape(-1, k)).any(1) & (sizes > 0)
        until = np.where(lacking, until * 2, until)
        open_ = np.flatnonzero(lacking[owner])
    return best.reshape(-1, k)


def described(texts: list[str], shingler: Shingler, weighted: bool) -> dict[str, pa.Array]:
    """node (digest of the set, null without words), size, sketch and bands of each text, and its elements."""
    elements, edges = shingler.of(texts, weighted)
    times = signatures(elements, edges)
    bits = mixed(times.view(np.uint64))
    bands = np.zeros((len(texts), BANDS), np.uint64)
    for r in range(ROWS):
        bands = mixed(bands * _GOLDEN + bits[:, r::ROWS])
    bands = mixed(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN)
    padded = np.zeros((len(texts), LANES * 64), np.uint64)
    padded[:, :COORDINATES] = bits
    sketch = [
        ((padded >> np.uint64(40 + p) & np.uint64(1)).reshape(len(texts), LANES, 64) << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64)
        for p in range(PLANES)
    ]
    sketch = np.concatenate(sketch, 1).view(np.int64)
    nodes = [
        hashlib.blake2b(elements[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(edges, edges[1:])
    ]

    def lists(matrix: np.ndarray) -> pa.Array:
        width = matrix.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, width), pa.int32()), pa.array(matrix.ravel()))

    return {
        "node": pa.array(nodes, pa.binary()),
        "size": pa.array(np.diff(edges), pa.int64()),
        "sketch": lists(sketch),
        "bands": lists(bands.view(np.int64)),
    }


def signed(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """doc_id, copy (hash of the text), node, size, sketch, bands of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in by_size(batch, BATCH_BYTES):
                found = described([t or "" for t in part.column(1).to_pylist()], shingler, weighted)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *found.values()], names=["doc_id", "copy", *found]
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("copy"))
    return rows.mapInArrow(run, "doc_id long, copy long, node binary, size long, sketch array<long>, bands array<long>")


def _sets(docs: DataFrame, members: DataFrame, weighted: bool) -> DataFrame:
    """(node, elements) of the nodes (node, copy, doc_id), from the text of one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in by_size(batch, BATCH_BYTES):
                elements, edges = shingler.of([t or "" for t in part.column(1).to_pylist()], weighted)
                short = (elements >> np.uint64(32)).astype(np.uint32)
                sets = [np.sort(short[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "elements"])

    wanted = members.select("node", F.col("copy").alias("_copy"), F.col("doc_id").alias("_id"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("copy"))
    rows = rows.join(wanted, (F.col("copy") == F.col("_copy")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return rows.select("node", "text").mapInArrow(run, "node binary, elements binary").dropDuplicates(["node"])


def _apart(a: str, b: str) -> Column:
    """How many coordinates differ in the sketches."""
    lanes = []
    for i in range(LANES):
        planes = [F.get(a, F.lit(p * LANES + i)).bitwiseXOR(F.get(b, F.lit(p * LANES + i))) for p in range(PLANES)]
        some = planes[0]
        for plane in planes[1:]:
            some = some.bitwiseOR(plane)
        lanes.append(F.bit_count(some))
    return sum(lanes[1:], lanes[0])


def _alike(pairs: DataFrame, state: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes in different components whose sizes and sketches allow the similarity."""

    def side(x: str) -> DataFrame:
        return state.select(*[F.col(c).alias(f"{n}{x}") for c, n in (("node", ""), ("component", "c"), ("size", "n"), ("sketch", "s"))])

    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(F.col("ca") != F.col("cb"))
        .where(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb"))
        .where(_apart("sa", "sb") <= MOST_APART)
        .select("a", "b", "ca", "cb")
    )


def _sets_in(column: pa.Array) -> list[np.ndarray]:
    """The set in each value, read in the column's own memory."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, places, values = column.buffers()
    places = np.frombuffer(places, width)[column.offset : column.offset + len(column) + 1] // 4
    values = np.frombuffer(values, np.uint32, int(places[-1])) if places[-1] else np.zeros(0, np.uint32)
    return [values[a:b] for a, b in zip(places.tolist(), places[1:].tolist())]


def _similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is large enough."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (len(both) - common)


def checked(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b, ...) whose sets are similar enough. The comparison is of whole sets."""
    kept = pairs.columns
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            pairs_ = zip(_sets_in(batch.column(len(kept))), _sets_in(batch.column(len(kept) + 1)))
            alike = [_similar(x, y, least) for x, y in pairs_]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(kept)], names=kept).filter(pa.array(alike, pa.bool_()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.join(left, "a").join(right, "b").select(*kept, "_a", "_b").mapInArrow(run, fields)


def _joined(state: DataFrame, links: DataFrame) -> DataFrame:
    """The state after the components on either side of each link are one."""
    merged = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("_new"))
    state = state.join(merged, "component", "left")
    return stage(state.withColumn("component", F.coalesce("_new", "component")).drop("_new"), "state")


def _turn(buckets: DataFrame, state: DataFrame, sets: DataFrame, least: float, turn: int) -> DataFrame:
    """Accepted pairs of a node and the pivot of one of its buckets."""
    order = F.xxhash64("node", F.lit(turn))
    pivots = buckets.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "node")).alias("p"))
    # Written first: a join with a plain shuffle on either side is split where a bucket is large.
    pivots = stage(pivots.select("bucket", F.col("p.node").alias("b")), "pivots")
    stars = (
        buckets.join(pivots, "bucket").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()
    )
    able = _alike(stars, state, least)
    one = able.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("o"), "b", "ca", "cb")).alias("p"))
    return stage(checked(one.select("a", "p.b", "p.ca", "p.cb"), sets, least), "accepted")


def _links_of_group(parts: list[pa.RecordBatch], least: float) -> list[tuple[bytes, bytes, bytes, bytes]]:
    """Accepted pairs of nodes of one bucket in different components, no more than join what they join.

    The sets stay in the batches that they came in.
    """
    table = pa.Table.from_batches([part.drop_columns(["elements"]) for part in parts]).combine_chunks()
    nodes, named = table["node"].to_pylist(), table["component"].to_pylist()
    names: dict[bytes, int] = {}
    component = np.array([names.setdefault(c, len(names)) for c in named])
    if len(names) < 2:
        return []

    def matrix(name: str, *shape: int) -> np.ndarray:
        return table[name].combine_chunks().flatten().to_numpy().reshape(len(component), *shape)

    size, own = table["size"].to_numpy(), table["own"].to_numpy()
    # Unsigned: numpy counts the bits of absolute values.
    sketch = matrix("sketch", PLANES, LANES).view(np.uint64)
    bands = matrix("bands", BANDS)
    bucket, low_tile, high_tile = (table[c][0].as_py() for c in ("bucket", "low", "high"))
    band = int(np.flatnonzero(bands[0] == bucket)[0])
    two_tiles = low_tile != high_tile
    joined = list(range(len(names)))

    def root(c: int) -> int:
        while joined[c] != c:
            c = joined[c] = joined[joined[c]]
        return c

    sets = [x for part in parts for x in _sets_in(part.column("elements"))]
    found = []
    for low in range(0, len(component), 256):
        block = slice(low, low + 256)
        able = (component[block, None] != component[None, :]) & (np.arange(len(component))[None, :] > np.arange(len(component))[block, None])
        if two_tiles:
            able &= own[block, None] != own[None, :]
        able &= np.minimum(size[block, None], size[None, :]) >= least * np.maximum(size[block, None], size[None, :])
        i, j = np.nonzero(able)
        i += low
        # A pair is looked at in the first band that both share.
        first = ~(bands[i, :band] == bands[j, :band]).any(1)
        i, j = i[first], j[first]
        apart = np.bitwise_count(np.bitwise_or.reduce(sketch[i] ^ sketch[j], axis=1)).sum(1)
        for x, y in zip(i[apart <= MOST_APART], j[apart <= MOST_APART]):
            a, b = root(component[x]), root(component[y])
            if a != b and _similar(sets[x], sets[y], least):
                joined[max(a, b)] = min(a, b)
                found.append((nodes[x], nodes[y], named[x], named[y]))
    return found


def _rest(buckets: DataFrame, state: DataFrame, profiles: DataFrame, least: float) -> DataFrame:
    """Accepted pairs among all pairs in a bucket that are in different components still.

    Pairs are looked at in tiles of a bucket, in tasks that stream over sorted rows, and only accepted ones leave.
    """
    named = stage(buckets.join(state.select("node", "component", F.col("size").alias("_size")), "node"), "named")
    mixed_ = named.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    named = named.join(mixed_.where(F.col("_low") != F.col("_high")).select("bucket"), "bucket")
    held = F.greatest(F.col("_size") * 4, F.lit(TILE_BYTES // TILE))
    tiles = tiled(stage(named, "mixed-buckets"), "bucket", TILE_BYTES, held).drop("_size").join(profiles, "node")
    keys = ["bucket", "low", "high"]
    columns = [*keys, "own", "node", "component", "size", "sketch", "bands", "elements"]
    tiles = tiles.select(*columns).repartition(partitions(tiles.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[pa.RecordBatch] = []
        held: tuple[int, ...] | None = None

        def given() -> Iterator[pa.RecordBatch]:
            links = _links_of_group(group, least) if group else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links)], names=["a", "b", "ca", "cb"])

        for batch in batches:
            ids = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)]
            for low, high in zip(edges, edges[1:]):
                if high == low:
                    continue
                key = tuple(ids[low].tolist())
                if key != held:
                    yield from given()
                    group, held = [], key
                group.append(batch.slice(low, high - low))
        yield from given()

    return stage(tiles.mapInArrow(run, "a binary, b binary, ca binary, cb binary"), "accepted")


def near_duplicates(docs: DataFrame, least: float = LEAST, weighted: bool = False) -> DataFrame:
    """doc_id, copy, component, class_id (smallest doc_id of the class) and n_shingles of every row of the documents.

    `component` is a key of the class, null for a text without words.
    """
    rows = stage(signed(docs, weighted), "signed")
    nodes = stage(
        rows.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "copy", "size", "sketch", "bands")).alias("r"))
        .select("node", "least", "r.*"),
        "nodes",
    )
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("bucket")
    buckets = stage(banded.join(shared, "bucket"), "buckets")
    members = stage(nodes.join(buckets.select("node").distinct(), "node"), "members")
    profiles = stage(members.select("node", "size", "sketch", "bands").join(_sets(docs, members, weighted), "node"), "profiles")
    sets = profiles.select("node", "elements")
    state = members.select("node", "size", "sketch", F.col("node").alias("component"))
    n, turn = members.count(), 0
    while True:
        accepted = _turn(buckets, state, sets, least, turn)
        moved = accepted.count()
        if moved:
            state = _joined(state, accepted)
        if moved * FEW <= n:
            break
        turn += 1
    accepted = _rest(buckets, state, profiles, least)
    state = _joined(state, accepted)
    owned = nodes.select("node", "least").join(state.select("node", "component"), "node", "left")
    owned = owned.withColumn("component", F.coalesce("component", "node"))
    names = stage(owned.groupBy("component").agg(F.min("least").alias("class_id")), "names")
    classes = owned.join(names, "component").select("node", "component", "class_id")
    without = rows.where(F.col("node").isNull()).withColumns({"component": F.col("node"), "class_id": F.col("doc_id")})
    classed = rows.where(F.col("node").isNotNull()).join(classes, "node")
    return classed.unionByName(without).select("doc_id", "copy", "component", "class_id", F.col("size").alias("n_shingles"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The documents, one row of each class: the smallest doc_id, then the smallest hash of its text. Texts without
    words all stay."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    kept = near_duplicates(docs, **settings).where(F.col("component").isNotNull()).groupBy("component").agg(F.min(first).alias("r"))
    kept = stage(kept.select(F.col("r.doc_id").alias("_id"), F.col("r.copy").alias("_key")), "kept")
    keyed = docs.select(as_row(docs).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_copy"))
    wordless = F.coalesce(F.btrim(F.col("_row")["text"], F.lit(SPACE)), F.lit("")) == ""
    chosen = keyed.where(~wordless).join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_copy") == F.col("_key")))
    chosen = chosen.dropDuplicates(["_doc", "_copy"]).select("_row")
    return chosen.unionByName(keyed.where(wordless).select("_row")).select("_row.*")
