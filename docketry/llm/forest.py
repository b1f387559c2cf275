"""Approximate nearest neighbours of every vector: a forest of random-projection trees.

The trees are fitted on a bounded sample (``sample`` vectors, a documented parameter) and sent
to all tasks; every vector is placed in all of them. A node cuts its vectors by a random
direction at the sample's median there. The depth follows from the number of vectors and
``leaf``, so leaves keep their size as the collection grows; below the sample's resolution
nodes cut at the centre of the last part of the sample known above them. A query walks all trees with one shared priority queue: the
branch not taken waits with the smallest margin on its path, and the nearest branch over all
trees is opened next, until ``probes`` leaves are found. Leaves are joined with their visitors by
one shuffle of 8-bit vectors; within a leaf all candidates are ranked by matrix products in
blocks. A candidate is dropped only if k others are nearer whatever the 8-bit vectors are off by
(each carries its error); the rest are merged over all leaves and reranked by their exact
cosines. Queries with more than ``CROWD`` such candidates in a block, as in a group of near
copies, go to their leaves again with full vectors and are ranked exactly there.

A leaf with more than ``FULL`` vectors, as in a dense place below the sample's resolution, is cut
into blocks by print; its visitors go to every block, so no task holds more than a block of it.

Vectors travel as they were delivered, packed without loss, and the exact cosines are those of
64-bit floats. Vectors whose directions agree to 32-bit floats, whatever their norm, are copies:
one representative stands for them until the end, so copies fill no leaf; of a class of copies only the ``k + 1`` smallest ids can be among anyone's k nearest, ties going to
the smaller id, and only those travel. Different directions at exactly equal cosines may be cut by
their prints within a leaf.

Defined cases: unusable vectors (null, undecodable, wrong length, not finite, all zero) take
no part; ids that are null are left out; repeated deliveries of an id count once; fewer than k
other vectors give fewer neighbours.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.shingles import mix
from docketry.session import cut, spread

BLOCK = 2048
#: Vectors in one block of an exhaustive search, about.
HOME = 16384
#: Most rows that a task hands on at once when every block is visited.
HANDED = 65536
#: Most candidates of a query in one block that wait for the exact rerank outside the leaf.
CROWD = 64
#: Pairs whose exact cosines are taken at once.
PAIRS = 32768
#: Most vectors of a leaf that one task holds, about, and most such leaves that are sent to the
#: tasks (16 bytes each); with more of them blocks grow instead.
FULL = 8192
FULL_LEAVES = 1_000_000


def decode_compressed(text: str | None, width: int) -> np.ndarray | None:
    """The vector in base64 of gzip of a JSON array of exactly ``width`` numbers, or None."""
    if not text:
        return None
    try:
        inflate = zlib.decompressobj(31)
        raw = inflate.decompress(base64.b64decode(text, validate=True))
        if not inflate.eof:
            return None
        found = json.loads(raw)
        if not isinstance(found, list) or len(found) != width or any(type(x) not in (int, float) for x in found):
            return None
        vector = np.array(found, np.float64)
    except (ValueError, zlib.error, OverflowError, RecursionError):
        return None
    return vector if np.isfinite(vector).all() and vector.any() else None


def _print(vector: np.ndarray) -> int:
    """A 64-bit print of a direction's values."""
    import xxhash

    return xxhash.xxh64_intdigest((vector + 0.0).tobytes()) - (1 << 63)


def _directions(vectors: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """(prints of directions to 32-bit floats, packed vectors) of usable vectors."""
    if not vectors:
        return pa.array([], pa.int64()), pa.array([], pa.binary())
    found = np.stack(vectors)
    return pa.array([_print(v) for v in _unit(found).astype(np.float32)], pa.int64()), _packed(found)


#: Decimal places under which a vector is held as whole numbers of so many bits, if nothing is lost.
DECIMALS = [(4, np.int16), (4, np.int32), (6, np.int32)]


def _packed(vectors: np.ndarray) -> pa.Array:
    """Vectors without loss: a byte for the form, then whole numbers or 64-bit floats."""
    out: list[bytes | None] = [None] * len(vectors)
    left = np.arange(len(vectors))
    for form, (places, kind) in enumerate(DECIMALS, 1):
        part = vectors[left]
        with np.errstate(over="ignore"):
            whole = np.rint(part * 10.0**places)
        fits = (np.abs(whole) <= np.iinfo(kind).max).all(axis=1) & (whole / 10.0**places == part).all(axis=1)
        for i, row in zip(left[fits].tolist(), whole[fits].astype(kind)):
            out[i] = bytes([form]) + row.tobytes()
        left = left[~fits]
    for i in left.tolist():
        out[i] = b"\0" + vectors[i].tobytes()
    return pa.array(out, pa.binary())


def _vectors(column: pa.Array) -> np.ndarray:
    """The vectors in a packed column."""
    rows = column.to_pylist()
    if not rows:
        return np.empty((0, 0))
    forms = np.array([row[0] for row in rows])
    width = (len(rows[0]) - 1) // (8 if forms[0] == 0 else np.dtype(DECIMALS[forms[0] - 1][1]).itemsize)
    out = np.empty((len(rows), width))
    for form in np.unique(forms).tolist():
        here = np.flatnonzero(forms == form)
        places, kind = (0, np.float64) if form == 0 else DECIMALS[form - 1]
        out[here] = np.frombuffer(b"".join([rows[i][1:] for i in here]), kind).reshape(len(here), width)
        if form:
            out[here] /= 10.0**places
    return out


def compressed_vectors(rows: DataFrame, id_column: str, column: str, width: int) -> DataFrame:
    """(id, print, vector): the usable vectors, packed without loss."""
    source = spread(rows.filter(F.col(id_column).isNotNull() & F.col(column).isNotNull()).select(F.col(id_column).alias("id"), F.col(column).alias("text")), "id")
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, vectors = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                vector = decode_compressed(text, width)
                if vector is not None:
                    take.append(i)
                    vectors.append(vector)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *_directions(vectors)], names=["id", "print", "vector"])

    return source.mapInArrow(run, f"id {kind}, print long, vector binary")


def array_vectors(rows: DataFrame, id_column: str, column: str, width: int) -> DataFrame:
    """The same from an array column."""
    source = rows.filter(F.col(id_column).isNotNull() & F.col(column).isNotNull()).select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, vectors = [], []
            for i, values in enumerate(batch.column(1).to_pylist()):
                if len(values) == width and None not in values:
                    vector = np.array(values, np.float64)
                    if np.isfinite(vector).all() and vector.any():
                        take.append(i)
                        vectors.append(vector)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *_directions(vectors)], names=["id", "print", "vector"])

    return source.mapInArrow(run, f"id {kind}, print long, vector binary")


def _matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    if not len(column):
        return np.empty((0, 0), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    # Scaled first, so that squares of very large or small values stay finite.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


#: More than rounding moves a cosine of 32-bit vectors.
ROUNDING = 1e-5


def _pack(unit: np.ndarray) -> pa.Array:
    """Unit vectors as a 32-bit scale, the norm of the error and 8-bit values each."""
    scale = (np.abs(unit).max(axis=1, keepdims=True) / 127).astype(np.float32)
    values = np.rint(unit / scale).astype(np.int8)
    error = np.linalg.norm(unit - values * scale, axis=1, keepdims=True).astype(np.float32)
    packed = np.concatenate([scale.view(np.int8), error.view(np.int8), values], axis=1)
    return pa.array([row.tobytes() for row in packed], pa.binary())


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, norms of their errors)."""
    packed = _matrix(column, np.int8)
    head = np.ascontiguousarray(packed[:, :8]).view(np.float32)
    return packed[:, 8:].astype(np.float32) * head[:, :1], head[:, 1]


@dataclass
class Forest:
    """Directions (trees, depth, width) and the cuts of all nodes.

    ``cuts`` has one per node of the upper levels, where the sample resolves nodes. Below, a
    node cuts at the projected centre of the sample in its lowest such ancestor (``deep``), so
    that dense places are cut in the middle too.
    """

    directions: np.ndarray
    cuts: np.ndarray
    deep: np.ndarray
    depth: int

    @staticmethod
    def fit(sample: np.ndarray, trees: int, depth: int, seed: int = 7, most_known: int = 12) -> Forest:
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        directions = rng.standard_normal((trees, depth, width))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        known = min(depth, most_known)
        cuts = np.zeros((trees, (1 << known) - 1), np.float32)
        centres = np.zeros((trees, 1 << known if depth > known else 0, width))
        for tree in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(known):
                value = sample @ directions[tree, level]
                first = (1 << level) - 1
                for here in range(1 << level):
                    inside = value[node == here]
                    cuts[tree, first + here] = np.median(inside) if len(inside) else 0.0
                node = node * 2 + (value >= cuts[tree, first + node])
            if depth > known:
                held = np.bincount(node, minlength=1 << known)
                for axis in range(width):
                    centres[tree, :, axis] = np.bincount(node, sample[:, axis], 1 << known) / np.maximum(held, 1)
        deep = np.einsum("tnw,tdw->tnd", centres, directions[:, known:]).astype(np.float32)
        return Forest(directions.astype(np.float32), cuts, deep, depth)

    def cut_of(self, tree: np.ndarray | int, level: np.ndarray | int, node: np.ndarray) -> np.ndarray:
        """Where the node cuts. Nodes are places within their level."""
        known = int(math.log2(self.cuts.shape[1] + 1))
        above = (1 << np.minimum(level, known - 1)) - 1 + (node >> np.maximum(level - known + 1, 0))
        upper = self.cuts[tree, above]
        if self.depth == known:
            return upper
        below = np.maximum(level - known, 0)
        return np.where(np.asarray(level) < known, upper, self.deep[tree, node >> below, below])

    def values(self, vectors: np.ndarray) -> np.ndarray:
        """Projections (vectors, trees, depth)."""
        trees, depth, width = self.directions.shape
        return (vectors @ self.directions.reshape(-1, width).T).reshape(len(vectors), trees, depth)

    def leaves(self, values: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        node = np.zeros(values.shape[:2], np.int64)
        trees = np.arange(values.shape[1])[None, :]
        for level in range(self.depth):
            node = node * 2 + (values[:, :, level] >= self.cut_of(trees, level, node))
        return node

    def search(self, values: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(tree, leaf) of the first ``probes`` leaves that the shared queue opens, per query.

        The queue is one row per query; all queries take their step together. The first
        entries are the roots, so every tree's own leaf comes first.
        """
        n, trees, depth = values.shape
        rows = np.arange(n)
        probes = min(probes, trees << depth)
        room = trees + probes * depth
        margin = np.full((n, room), -np.inf, np.float32)  # smallest margin on the path, negated when crossed
        tree = np.zeros((n, room), np.int16)
        level = np.zeros((n, room), np.int16)
        node = np.zeros((n, room), np.int64)
        margin[:, :trees] = np.inf
        tree[:, :trees] = np.arange(trees)
        used = trees
        out_tree = np.zeros((n, probes), np.int16)
        out_leaf = np.full((n, probes), -1, np.int64)
        for step in range(probes):
            best = np.argmax(margin[:, :used], axis=1)
            have = margin[rows, best] > -np.inf
            m, t, v, p = margin[rows, best], tree[rows, best].astype(np.int64), level[rows, best].astype(np.int64), node[rows, best]
            margin[rows, best] = -np.inf
            while True:
                going = v < depth
                if not going.any():
                    break
                at = np.minimum(v, depth - 1)
                side = values[rows, t, at] - self.cut_of(t, at, np.where(going, p, 0))
                right = side >= 0
                other = np.minimum(m, -np.abs(side))
                margin[:, used] = np.where(going & have, other, -np.inf)
                tree[:, used], level[:, used] = t, v + 1
                node[:, used] = p * 2 + ~right
                used += 1
                p = np.where(going, p * 2 + right, p)
                v = np.where(going, v + 1, v)
                if used >= room:
                    margin, tree, level, node = (np.concatenate([x, np.full((n, depth), fill, x.dtype)], axis=1) for x, fill in ((margin, -np.inf), (tree, 0), (level, 0), (node, 0)))
                    room += depth
            out_tree[:, step], out_leaf[:, step] = t, np.where(have, p, -1)
        return out_tree, out_leaf


def _full_leaves(bodies: DataFrame, forest, trees: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(leaf keys in rising order, blocks) of the leaves with more than FULL vectors, counted over all vectors."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                leaf = forest.value.leaves(forest.value.values(_unit(_vectors(part.column(0))).astype(np.float32)))
                key, n = np.unique((np.arange(trees, dtype=np.int64)[None, :] << 48) | leaf, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["leaf", "n"])

    sizes = cut(bodies.select("vector").mapInArrow(homes, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).filter(F.col("n") > FULL))
    most = FULL
    while sizes.filter(F.col("n") > most).count() > FULL_LEAVES:
        most *= 2
    found = sorted((r["leaf"], -(-r["n"] // most)) for r in sizes.filter(F.col("n") > most).collect())
    return (np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)) if found else None


def _in_blocks(full: tuple[np.ndarray, np.ndarray], rows: np.ndarray, key: np.ndarray, visits: np.ndarray, prints: np.ndarray, everyone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, keys, visits) with full leaves in blocks: a vector lives in the block of its print and,
    where everyone asks, visits the others; visitors go to every block."""
    leaves, blocks = full
    at = np.minimum(np.searchsorted(leaves, key), len(leaves) - 1)
    many = np.where(leaves[at] == key, blocks[at], 1)
    if not len(many) or many.max() == 1:
        return rows, key, visits
    each = np.repeat(np.arange(len(key)), many)
    block = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    split, own = many[each] > 1, np.mod(prints[rows[each]], many[each]) == block
    met = np.where(split, mix(key[each].view(np.uint64) ^ mix(block.astype(np.uint64) + np.uint64(1))).view(np.int64) & np.int64(2**63 - 1), key[each])
    kept = ~split | own | visits[each] | everyone
    return rows[each][kept], met[kept], (visits[each] | (split & ~own))[kept]


def neighbours(
    vectors: DataFrame, k: int = 5, trees: int = 5, leaf: int = 1024, probes: int = 10, least_cosine: float = -1.0,
    queries: DataFrame | None = None, sample: int = 16384, seed: int = 7, exhaustive: bool = False,
) -> DataFrame:
    """(id_a, id_b, cosine, rank): the k nearest other ids of every id, or of every id in
    ``queries`` (one column, id). With ``least_cosine`` only neighbours that reach it are sought:
    a neighbour's rank depends on nearer ones alone, so ranks stay what they are.

    ``exhaustive`` compares with all vectors instead, in blocks of about ``HOME`` of them that
    every query visits; nothing is then lost, whatever the size, and the work is the product of
    both numbers.

    ``vectors`` has (id, print, vector) as the readers above give them.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()
    vectors = cut(vectors)
    members = vectors.groupBy("id").agg(F.min("print").alias("print"))
    bodies = cut(vectors.groupBy("print").agg(F.first("vector").alias("vector")))
    count = bodies.count()
    if count == 0:
        return spark.createDataFrame([], f"id_a {kind}, id_b {kind}, cosine double, rank int")
    blocks = math.ceil(count / HOME) if exhaustive else 0
    depth = 0 if exhaustive else max(0, math.ceil(math.log2(max(1, count / leaf))))
    fitted = None
    if depth:
        # A bounded sample, the same in every run: prints are hashes, so those below a line hold
        # about ``sample`` vectors wherever they lie.
        line = min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, sample / count)))
        picked = bodies.filter(F.col("print") <= line).select("vector").limit(2 * sample).collect() or bodies.select("vector").limit(1).collect()
        fitted = _unit(_vectors(pa.array([bytes(r[0]) for r in picked], pa.binary()))).astype(np.float32)
    forest = spark.sparkContext.broadcast(Forest.fit(fitted, trees, depth, seed) if depth else None)
    everyone = queries is None and not exhaustive

    opened = max(probes, trees) if everyone else probes
    full_leaves = _full_leaves(bodies, forest, trees) if depth else None

    def place(visit: bool, skip: int, full: bool = False):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = max(1, min(BLOCK, HANDED // blocks)) if visit and exhaustive else BLOCK
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    unit = _unit(_vectors(part.column(1))).astype(np.float32)
                    if exhaustive and visit:
                        keys = np.broadcast_to(np.arange(blocks), (len(part), blocks))
                    elif exhaustive:
                        keys = np.mod(part.column(0).to_numpy(), blocks)[:, None]
                    elif forest.value is None:
                        keys = np.zeros((len(part), 1 - min(skip, 1)), np.int64)
                    else:
                        values = forest.value.values(unit)
                        if visit:
                            tree, leaf_no = (x[:, skip:] for x in forest.value.search(values, opened))
                        else:
                            leaf_no = forest.value.leaves(values)
                            tree = np.broadcast_to(np.arange(trees), leaf_no.shape)
                        keys = np.where(leaf_no < 0, -1, (tree.astype(np.int64) << 48) | leaf_no)
                    rows, columns = np.nonzero(keys >= 0)
                    key, visits = keys[rows, columns], np.full(len(rows), visit)
                    if full_leaves is not None:
                        rows, key, visits = _in_blocks(full_leaves, rows, key, visits, part.column(0).to_numpy(), everyone)
                    index = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(visits), part.column(0).take(index), (part.column(1) if full else _pack(unit)).take(index)],
                        names=["leaf", "visits", "print", "packed"],
                    )

        return run

    shape = "leaf long, visits boolean, print long, packed binary"
    met = bodies.mapInArrow(place(False, 0), shape)
    if everyone:
        # A vector is at home in the first leaf of each tree that its queue opens; there it
        # needs no visit.
        visiting = bodies.mapInArrow(place(True, trees), shape) if probes > trees else None
    elif queries is None:
        visiting = bodies.mapInArrow(place(True, 0), shape)
    else:
        wanted = members.join(queries.select(F.col(queries.columns[0]).alias("id")).distinct(), "id", "left_semi").select("print").distinct()
        visiting = bodies.join(wanted, "print", "left_semi").mapInArrow(place(True, 0), shape)
    if visiting is not None:
        met = met.unionByName(visiting)
    met = met.repartition("leaf").sortWithinPartitions("leaf", "visits")

    def rank(batches: Iterator[pa.RecordBatch], full: bool = False) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names: list[np.ndarray] = []

        def answer(prints: np.ndarray, query: np.ndarray, error: np.ndarray) -> pa.RecordBatch:
            # The leaf's own vectors may lie in several blocks.
            rows, others, scores, offs = [], [], [], []
            crowded = np.zeros(len(query), np.bool_)
            for (block, block_error), own in zip(held, names):
                for at in range(0, len(own), BLOCK):
                    part, name = block[at : at + BLOCK], own[at : at + BLOCK]
                    cosines = query @ part.T
                    most = block_error[at : at + BLOCK].max()
                    off = (error + most + error * most + ROUNDING)[:, None]
                    near = cosines >= least_cosine - off
                    if cosines.shape[1] > k + 1 and np.count_nonzero(near) > k * len(query):
                        # One of the k + 1 best may be the query itself.
                        best = np.partition(cosines, -(k + 1), axis=1)[:, -(k + 1)][:, None]
                        near &= cosines >= best - 2 * off
                    row, column = np.nonzero(near)
                    other = prints[row] != name[column]
                    row, column = row[other], column[other]
                    if full:
                        score = np.concatenate([np.einsum("ij,ij->i", query[row[i : i + PAIRS]], part[column[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)] or [np.empty(0)])
                        order = np.lexsort((name[column], -score, row))
                        row, column, score = row[order], column[order], score[order]
                        few = np.arange(len(row)) - np.searchsorted(row, row) < k
                        row, column, score = row[few], column[few], score[few]
                    else:
                        many = np.bincount(row, minlength=len(query)) > CROWD
                        crowded |= many
                        row, column = row[~many[row]], column[~many[row]]
                        score = cosines[row, column]
                    rows.append(row)
                    others.append(name[column])
                    scores.append(score)
                    offs.append(off[row, 0])
            row, other, score, off = (np.concatenate(c) for c in (rows, others, scores, offs))
            alone = np.flatnonzero(crowded)
            stays = ~crowded[row]
            # A crowded query is its own neighbour here: it is asked again.
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([prints[row[stays]], prints[alone]])), pa.array(np.concatenate([other[stays], prints[alone]])),
                 pa.array(np.concatenate([score[stays], np.ones(len(alone))]).astype(np.float64)), pa.array(np.concatenate([off[stays], np.zeros(len(alone))]).astype(np.float64))],
                names=["print_a", "print_b", "near", "off"],
            )

        def at_home() -> Iterator[pa.RecordBatch]:
            if everyone and not full:
                for (block, error), own in zip(list(held), list(names)):
                    for at in range(0, len(own), BLOCK):
                        yield answer(own[at : at + BLOCK], block[at : at + BLOCK], error[at : at + BLOCK])

        current, greeted = None, True
        for batch in batches:
            leaf_no = batch.column(0).to_numpy()
            visitor = batch.column(1).to_numpy(zero_copy_only=False)
            prints = batch.column(2).to_numpy()
            edges = np.flatnonzero((leaf_no[1:] != leaf_no[:-1]) | (visitor[1:] != visitor[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(batch)]):
                if a == b:
                    continue
                if not greeted and (leaf_no[a] != current or visitor[a]):
                    yield from at_home()
                    greeted = True
                if leaf_no[a] != current:
                    current, greeted = leaf_no[a], True
                    held.clear()
                    names.clear()
                packed = batch.column(3).slice(a, b - a)
                vectors_here, error_here = (_unit(_vectors(packed)), np.zeros(b - a, np.float32)) if full else _unpack(packed)
                if not visitor[a]:
                    held.append((vectors_here, error_here))
                    names.append(prints[a:b])
                    greeted = False
                elif held:
                    for at in range(0, b - a, BLOCK):
                        yield answer(prints[a:b][at : at + BLOCK], vectors_here[at : at + BLOCK], error_here[at : at + BLOCK])
        if not greeted:
            yield from at_home()

    shape_near = "print_a long, print_b long, near double, off double"
    near = cut(met.mapInArrow(rank, shape_near))
    crowded = cut(near.filter("print_a = print_b").select("print_a").distinct())
    some = not crowded.isEmpty()
    settled = near.join(crowded, "print_a", "left_anti") if some else near
    once = settled.groupBy("print_a", "print_b").agg(F.max("near").alias("near"), F.max("off").alias("off"))
    sure = Window.partitionBy("print_a").orderBy(F.desc(F.col("near") - F.col("off"))).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    few = once.withColumn("__k", F.nth_value(F.col("near") - F.col("off"), k).over(sure)).filter("__k is null or near + off >= __k").select("print_a", "print_b")
    pairs = few.join(bodies.select(F.col("print").alias("print_a"), F.col("vector").alias("vector_a")), "print_a").join(bodies.select(F.col("print").alias("print_b"), F.col("vector").alias("vector_b")), "print_b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            cosine = np.einsum("ij,ij->i", _unit(_vectors(batch.column("vector_a"))), _unit(_vectors(batch.column("vector_b"))))
            yield pa.RecordBatch.from_arrays([batch.column("print_a"), batch.column("print_b"), pa.array(np.clip(cosine, -1, 1))], names=["print_a", "print_b", "cosine"])

    ranked = pairs.select("print_a", "print_b", "vector_a", "vector_b").mapInArrow(exact, "print_a long, print_b long, cosine double").filter(F.col("cosine") >= least_cosine)
    if some:
        again = bodies.join(crowded.withColumnRenamed("print_a", "print"), "print", "left_semi").mapInArrow(place(True, 0, True), shape)
        home = bodies.mapInArrow(place(False, 0, True), shape).join(again.select("leaf").distinct(), "leaf", "left_semi")
        met_again = home.unionByName(again).repartition("leaf").sortWithinPartitions("leaf", "visits")
        found_again = met_again.mapInArrow(lambda batches: rank(batches, True), shape_near).groupBy("print_a", "print_b").agg(F.max("near").alias("cosine"))
        ranked = ranked.unionByName(found_again.withColumn("cosine", F.least("cosine", F.lit(1.0))).filter(F.col("cosine") >= least_cosine))
    # From classes back to ids: each class speaks through its k + 1 smallest ids, found with
    # salt so that no task orders a whole class.
    by_id = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    part = members.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("__n", by_id("print", "__salt")).filter(F.col("__n") <= k + 1)
    speakers = part.withColumn("__n", by_id("print")).filter(F.col("__n") <= k + 1).select("print", "id")
    several = speakers.join(speakers.groupBy("print").agg(F.count("*").alias("__c")).filter("__c > 1").select("print"), "print", "left_semi")
    other = ranked.join(speakers.select(F.col("print").alias("print_b"), F.col("id").alias("id_b")), "print_b").select("print_a", "id_b", "cosine")
    same = several.select(F.col("print").alias("print_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("cosine"))
    nearest = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cosine"), "id_b"))
    around = other.unionByName(same).withColumn("__n", nearest("print_a")).filter(F.col("__n") <= k + 1).select("print_a", "id_b", "cosine")
    asking = members if queries is None else members.join(queries.select(F.col(queries.columns[0]).alias("id")).distinct(), "id", "left_semi")
    found = asking.select(F.col("id").alias("id_a"), F.col("print").alias("print_a")).join(around, "print_a").filter("id_a <> id_b")
    return found.withColumn("rank", nearest("id_a")).filter(F.col("rank") <= k).select("id_a", "id_b", "cosine", "rank")
