"""Near-duplicate texts by the pigeonring principle, without loss.

The sets of word shingles x and y are near duplicates when ``|x & y| / |x | y| >= t``, which
is a bound on their Hamming distance as 0/1 vectors over all shingles:
``H = |x ^ y| <= tau = floor((1 - t) / (1 + t) * (|x| + |y|))``. The shingles are cut by hash
into a ring of ``SEGMENTS`` segments; b_i is the difference in segment i and the b_i add up to
H. By the pigeonring principle some start i has, for every length l, a chain with
``b_i + ... + b_(i+l-1) <= l * tau / SEGMENTS``. Pairs without such a chain are pruned.

Steps, each a Spark job over all rows:

1. a histogram of shingle hashes (bins by the size of the corpus, see ``bin_bits``) gives one
   global order of shingles, rare ones first; any order is exact, a rare-first one is fast;
2. each set emits its first ``|x| - ceil(t |x|) + 1`` shingles as keys (two sets with the
   wanted similarity share one of them), with a ring of parity bits, BITS per segment. The
   bits in which two rings differ in a segment never outnumber b_i, so a chain that is too
   long in bits is too long in truth and nothing is lost;
3. rows meet by key, sorted, and are paired in numpy passes over whole batches: sizes and
   positions, then chains that grow segment by segment and die as soon as they exceed their
   budget; a pair without a living chain is never written. The chains are the only test of the
   rings: no sum over a whole ring is taken. Keys in bins that are full are counted exactly;
   those with more than GROUP rows are spread over blocks that meet block by block, so that
   no task gets an unbounded group;
4. the surviving pairs get the full Hamming check on the sets themselves. The sets are made
   again from the texts, only for documents that pass a bitmap sized by the pairs.

Documents with the same set are one representative until the end. Per task each set emits
its keys once, however many copies there are.

Defined cases: null, empty and short texts (fewer than ``least_words`` words, or than k) pair
with nothing; in groups those with the same words are copies of each other, null being a text
without words; repeated deliveries of one id count once; ids that are null are left out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.components import connected
from docketry.llm.shingles import set_prints, shingle_sets, slices
from docketry.session import cut, spread

SEGMENTS = 8
BITS = 32
#: Length of the chains that a pair must have; the last segment is left to the full check.
CHAIN = 7
#: The ring as 64-bit words of two segments each.
RING = [f"ring{i}" for i in range(SEGMENTS * BITS // 64)]
SLICES = 64
#: Most rows of a key that meet in one group, about; hotter keys are spread over blocks.
GROUP = 4096
#: Most hot keys that are broadcast (16 bytes each); more are joined by a shuffle.
HOT_KEYS = 1_000_000
#: Rows that are paired in one go.
ROWS = 100_000
#: Most members of a class of equal texts that meet in one task to be written as pairs.
MEMBERS = 1024
WORD = re.compile("[a-z0-9]+")


def bin_bits(texts: DataFrame) -> int:
    """Bits of the histogram: a bin for about ten shingles, 2^16 bins at least and 2^22 (16 MB) at most.

    Beyond some 250 million characters bins hold more shingles each; the order gets coarser, no
    result changes, and keys of full bins are counted one by one.
    """
    characters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(22, max(16, (characters // 64).bit_length()))


def _packed(cells: np.ndarray) -> bytes:
    """Counts as a compressed array of the smallest whole numbers that hold them."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if cells.max(initial=0) <= np.iinfo(t).max or t is np.uint32)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(np.minimum(cells, np.iinfo(kind).max).astype(kind).tobytes(), 1)


def _counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), f"u{packed[0]}").astype(np.int64)


def token_histogram(texts: DataFrame, k: int, least_words: int, bits: int) -> np.ndarray:
    """How often each of 2^bits hash bins occurs over all texts.

    Every task counts in one array and hands on its slices, compressed; slices are summed one at
    a time, so memory does not grow with the number of tasks.
    """
    bins = 1 << bits
    width = bins // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int64)
        for batch in batches:
            for part in slices(batch):
                _, _, hashes = shingle_sets(part.column(0), k, least_words, distinct=False)
                total += np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([_packed(c) for c in total.reshape(SLICES, width)], pa.binary())], names=["slice", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[at] = sums[at] + _counts(cells) if at in sums else _counts(cells)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_packed(c) for c in sums.values()], pa.binary())], names=["slice", "cells"])

    shape = "slice int, cells binary"
    total = np.zeros(bins, np.uint32)
    for row in texts.mapInArrow(count, shape).repartition(16, "slice").mapInArrow(add, shape).collect():
        total[row["slice"] * width : (row["slice"] + 1) * width] = _counts(bytes(row["cells"]))
    return total


def _rings(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Parity bits of each set, SEGMENTS x BITS, as signed 64-bit words."""
    documents = len(offsets) - 1
    owner = np.repeat(np.arange(documents), np.diff(offsets))
    slot = ((hashes >> np.uint64(40)) % np.uint64(SEGMENTS * BITS)).astype(np.int64)
    parity = (np.bincount(owner * (SEGMENTS * BITS) + slot, minlength=documents * SEGMENTS * BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(documents, -1), axis=1, bitorder="little").view(np.int64)


def _prefixes(offsets: np.ndarray, hashes: np.ndarray, counts: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, rank, full): the rarest ``n - ceil(t n) + 1`` shingles of each set, without those
    that no other set can hold (their bin was counted once); full tells whether the bin holds more than GROUP."""
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size)
    often = counts[(hashes & np.uint64(len(counts) - 1)).astype(np.int64)]
    # Within a set: rare first, equally rare ones as they stand (the same order in all sets).
    order = np.argsort((owner.astype(np.uint64) << np.uint64(32)) | often.astype(np.uint64), kind="stable")
    rank = np.arange(len(hashes)) - np.repeat(offsets[:-1], size)
    length = size - (-(-size * t.numerator // t.denominator)) + 1
    chosen = (rank < np.repeat(length, size)) & (often[order] > 1)
    picked = order[chosen]
    return owner[picked], hashes[picked], rank[chosen], often[picked] > GROUP


def in_blocks(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of hot keys (key, blocks) repeated for every pair of blocks, under keys of their own.

    A row of block i goes to the meetings of i with every other block and to that of i alone;
    blocks follow the prints, so any two rows of a key meet exactly once.
    """
    own = F.pmod(F.shiftrightunsigned("print", 17), F.col("blocks"))
    met = rows.join(hot, "key", "left").withColumn("__i", own).withColumn("__j", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))))
    key = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("__i", "__j"), F.greatest("__i", "__j")))
    return met.select(key.alias("key"), *(c for c in rows.columns if c != "key"))


def _chains(x: np.ndarray, y: np.ndarray, tau: np.ndarray, length: int) -> tuple[np.ndarray, list[int]]:
    """(places of the pairs that have a chain of ``length``, pairs left after each length).

    x and y hold parity bits (rows, words of two segments). Chains of length 1 are tried at
    every start; those within budget grow by one segment at a time, and a pair whose last chain
    has died is dropped before the next step.
    """
    left = np.arange(len(x))
    differ = np.bitwise_count((x ^ y).view(np.uint32)).astype(np.int32)  # rows x SEGMENTS
    sums, alive = np.zeros_like(differ), np.ones(differ.shape, np.bool_)
    counts = []
    for step in range(length):
        sums += np.roll(differ, -step, axis=1)
        alive &= sums * SEGMENTS <= (tau * (step + 1))[:, None]
        some = alive.any(axis=1)
        if not some.all():
            left, differ, sums, alive, tau = left[some], differ[some], sums[some], alive[some], tau[some]
        counts.append(len(left))
    return left, counts


#: What the counts of the pairing stand for, in order.
STEPS = ["met", "position", *(f"chain{i}" for i in range(1, SEGMENTS + 1))]


def _pairing(t: Fraction, length: int, counting: bool = False):
    """A mapInArrow function over rows sorted by key, size and print: pairs that pass all filters, or
    with ``counting`` how many pass each of them."""
    rest = (1 - t) / (1 + t)
    up, down = (1 + t).numerator * t.denominator, t.numerator * (1 + t).denominator

    def pairs_of(key: np.ndarray, prints: np.ndarray, size: np.ndarray, rank: np.ndarray, ring: np.ndarray, tally: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Copies of a set that lay in several tasks.
        new = np.ones(len(key), np.bool_)
        new[1:] = (key[1:] != key[:-1]) | (prints[1:] != prints[:-1])
        key, prints, size, rank, ring = key[new], prints[new], size[new], rank[new], ring[new]
        firsts, seconds = [], []
        # Position: a key at rank r leaves at most size - r shared shingles if it is the first
        # one that both share. There a similar pair always passes, so none is lost. Rows of a key
        # rise in size, so what the smaller set leaves bounds a stretch of larger ones at once.
        left = size - rank
        group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) << 32
        end = np.searchsorted(group + size, group + np.clip(left * up // down - size, 0, 2**32 - 1), side="right")
        at, apart = np.arange(len(key) - 1), 1
        while len(at):
            at = at[at + apart < end[at]]
            tally[0] += len(at)
            total = size[at] + size[at + apart]
            near = at[left[at + apart] * up >= total * down]
            tally[1] += len(near)
            if len(near):
                tau = (size[near] + size[near + apart]) * rest.numerator // rest.denominator
                kept, counts = _chains(ring[near], ring[near + apart], tau, length)
                tally[2 : 2 + length] += np.array(counts, np.int64)
                near = near[kept]
                firsts.append(prints[near])
                seconds.append(prints[near + apart])
            apart += 1
        if not firsts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        tally = np.zeros(2 + length, np.int64)

        def meet(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            a, b = pairs_of(*(np.concatenate(c) for c in zip(*parts)), tally)
            if not counting:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["print_a", "print_b"])

        for batch in batches:
            if not len(batch):
                continue
            key, prints, size, rank = (batch.column(i).to_numpy() for i in range(4))
            ring = np.stack([batch.column(4 + i).to_numpy() for i in range(len(RING))], axis=1)
            part = (key, prints, size.astype(np.int64), rank.astype(np.int64), ring)
            held.append(part)
            rows += len(key)
            if rows < ROWS or key[0] == key[-1]:
                continue
            # The last key may go on in the next batch; it waits.
            last = int(np.searchsorted(key, key[-1]))
            held[-1] = tuple(c[:last] for c in part)
            yield from meet(held)
            held = [tuple(c[last:] for c in part)]
            rows = len(key) - last
        if held:
            yield from meet(held)
        if counting:
            yield pa.RecordBatch.from_arrays([pa.array(STEPS[: len(tally)]), pa.array(tally)], names=["stage", "pairs"])

    return run


def _stub_print(text: str | None) -> int:
    """A 64-bit print of the words of a text that has no shingles."""
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(WORD.findall(text.lower())) if text else "", seed=1) - (1 << 63)


def similar_pairs(documents: DataFrame, id_column: str, text_column: str, similarity: float = 0.8, k: int = 5, least_words: int = 1, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of near-duplicate texts.

    ``pairs`` has one row (print_a, print_b, shared, size_a, size_b) for each two different
    sets with at least the similarity; ``members`` has (print, id) for each distinct id.
    """
    pairs, made = _pairs_and_prints(documents, id_column, text_column, similarity, k, least_words, chain)
    return pairs, _members(made)


def similar_groups(documents: DataFrame, id_column: str, text_column: str, similarity: float = 0.8, k: int = 5, least_words: int = 1, chain: int = CHAIN) -> DataFrame:
    """``groups`` of all ids, those of texts without shingles too: texts with the same few
    words are one group without links."""
    pairs, made = _pairs_and_prints(documents, id_column, text_column, similarity, k, least_words, chain)
    members = _members(made)
    stubs = made.filter("stub").join(members.select("id"), "id", "left_anti").groupBy("id").agg(F.min("print").alias("print"))
    return groups(pairs, cut(members.unionByName(stubs)))


def pruning(documents: DataFrame, text_column: str, similarity: float = 0.8, k: int = 5, least_words: int = 1, chain: int = SEGMENTS) -> DataFrame:
    """(stage, pairs): how many pairs meet under a key within the sizes that the smaller set's
    position allows, and how many are left after the other set's position and after chains of each length; a pair counts once for every key that it shares."""
    t = Fraction(similarity).limit_denominator(1000)
    rows = _meetings(documents.select(F.col(text_column).alias("text")), t, k, least_words)
    return rows.mapInArrow(_pairing(t, chain, counting=True), "stage string, pairs long").groupBy("stage").agg(F.sum("pairs").alias("pairs"))


def _members(made: DataFrame) -> DataFrame:
    return made.filter("not stub").select("print", "id").distinct()


def _meetings(texts: DataFrame, t: Fraction, k: int, least_words: int) -> DataFrame:
    """(key, print, size, rank, ring words) of every set under each of its keys, partitioned and sorted by key."""
    spark = texts.sparkSession
    histogram = token_histogram(texts, k, least_words, bin_bits(texts))
    crowded = bool((histogram > GROUP).any())
    counts = spark.sparkContext.broadcast(histogram)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                _, offsets, hashes = shingle_sets(part.column(0), k, least_words)
                prints = set_prints(offsets, hashes)
                fresh = np.zeros(len(prints), np.bool_)
                for i, p in enumerate(prints.tolist()):
                    if p not in done:
                        done.add(p)
                        fresh[i] = True
                if not fresh.any():
                    continue
                owner, key, rank, full = _prefixes(offsets, hashes, counts.value, t)
                rings = _rings(offsets, hashes)
                use = fresh[owner]
                owner, key, rank, full = owner[use], key[use], rank[use], full[use]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(prints[owner].view(np.int64)), pa.array(np.diff(offsets)[owner].astype(np.int32)), pa.array(rank.astype(np.int32))]
                    + [pa.array(rings[owner, i]) for i in range(len(RING))] + [pa.array(full)],
                    names=["key", "print", "size", "rank", *RING, "full"],
                )

    every = texts.mapInArrow(keys, "key long, print long, size int, rank int, " + ", ".join(f"{r} long" for r in RING) + ", full boolean")
    rows = every.drop("full")
    if crowded:
        # A full bin may hold one hot key or many rare ones: its keys are counted exactly.
        hot = cut(every.filter("full").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("key", F.ceil(F.col("n") / GROUP).alias("blocks")))
        found = hot.count()
        if found:
            rows = in_blocks(rows, F.broadcast(hot) if found <= HOT_KEYS else hot)
    return rows.repartition("key").sortWithinPartitions("key", "size", "print")


def _pairs_and_prints(documents: DataFrame, id_column: str, text_column: str, similarity: float, k: int, least_words: int, chain: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, made): the pairs and (id, print, hashes, stub) of every text; a stub has no shingles."""
    t = Fraction(similarity).limit_denominator(1000)
    rest = (1 - t) / (1 + t)
    source = spread(documents.filter(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "id")
    spark = documents.sparkSession
    met = _meetings(source.select("text"), t, k, least_words).mapInArrow(_pairing(t, chain), "print_a long, print_b long")
    candidates = cut(met.distinct())
    marks = spark.sparkContext.broadcast(_bitmap(candidates))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in (part for whole in batches for part in slices(whole)):
            places, offsets, hashes = shingle_sets(batch.column(1), k, least_words)
            prints = set_prints(offsets, hashes)
            slot = (prints & np.uint64(8 * len(marks.value) - 1)).astype(np.int64)
            wanted = (marks.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            held: list[bytes | None] = []
            for i, p in enumerate(prints.tolist()):
                if wanted[i] and p not in done:
                    done.add(p)
                    held.append(hashes[offsets[i] : offsets[i + 1]].tobytes())
                else:
                    held.append(None)
            few = np.setdiff1d(np.arange(len(batch)), places)
            index = pa.array(np.concatenate([places, few]), pa.int64())
            stubs = np.array([_stub_print(t) for t in batch.column(1).take(pa.array(few, pa.int64())).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), pa.array(np.concatenate([prints.view(np.int64), stubs])), pa.array(held + [None] * len(few), pa.binary()), pa.array(np.arange(len(index)) >= len(places))],
                names=["id", "print", "hashes", "stub"],
            )

    made = cut(source.mapInArrow(sets, f"id {source.schema['id'].dataType.simpleString()}, print long, hashes binary, stub boolean"))
    bodies = made.filter("hashes is not null").groupBy("print").agg(F.first("hashes").alias("hashes"))
    joined = (
        candidates.join(bodies.select(F.col("print").alias("print_a"), F.col("hashes").alias("hashes_a")), "print_a")
        .join(bodies.select(F.col("print").alias("print_b"), F.col("hashes").alias("hashes_b")), "print_b")
    )

    def full_check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, shared, size_a, size_b = [], [], [], []
            for i, (x, y) in enumerate(zip(batch.column("hashes_a").to_pylist(), batch.column("hashes_b").to_pylist())):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                difference = len(np.setxor1d(a, b, assume_unique=True))
                if difference <= math.floor(rest * (len(a) + len(b))):
                    keep.append(i)
                    shared.append((len(a) + len(b) - difference) // 2)
                    size_a.append(len(a))
                    size_b.append(len(b))
            index = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("print_a").take(index), batch.column("print_b").take(index), pa.array(shared, pa.int32()), pa.array(size_a, pa.int32()), pa.array(size_b, pa.int32())],
                names=["print_a", "print_b", "shared", "size_a", "size_b"],
            )

    pairs = joined.select("print_a", "print_b", "hashes_a", "hashes_b").mapInArrow(full_check, "print_a long, print_b long, shared int, size_a int, size_b int")
    return cut(pairs), made


def _bitmap(candidates: DataFrame) -> np.ndarray:
    """A bitmap that marks the prints in the candidates, made by tasks.

    It has 16 bits for each pair, 2^16 at least and 2^28 (32 MB) at most; beyond that it lets
    more sets through than are asked for, at worst every set once, and never one too few.
    """
    size = 1 << min(28, max(16, (16 * candidates.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.bool_)
        for batch in batches:
            for column in batch.columns:
                bits[(column.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(size - 1)).astype(np.int64)] = True
        if bits.any():
            parts = np.packbits(bits, bitorder="little").reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["slice", "bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(bits), np.uint8)
                held[at] = held[at] | part if at in held else part
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(b.tobytes(), 1) for b in held.values()], pa.binary())], names=["slice", "bits"])

    shape = "slice int, bits binary"
    width = (size >> 3) // SLICES
    total = np.zeros(size >> 3, np.uint8)
    for row in candidates.mapInArrow(mark, shape).repartition(16, "slice").mapInArrow(either, shape).collect():
        total[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(bytes(row["bits"])), np.uint8)
    return total


def id_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of different ids, the smaller first: links between sets spread over their members,
    and the members of one set among themselves.

    A class is cut into blocks of about MEMBERS ids, and blocks meet blocks, so that no task
    writes more than MEMBERS squared pairs for one key however many copies a text has.
    """
    blocks = members.groupBy("print").agg(F.count("*").alias("copies"), F.ceil(F.count("*") / MEMBERS).alias("blocks"))
    placed = members.join(blocks.filter("blocks > 1").select("print", "blocks"), "print", "left").select("print", "id", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).alias("block"))
    each = lambda name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1))
    side = lambda x: blocks.select(F.col("print").alias(f"print_{x}"), F.col("blocks").alias(f"blocks_{x}"))
    across = pairs.select("print_a", "print_b").join(side("a"), "print_a").join(side("b"), "print_b").withColumn("block_a", each("blocks_a")).withColumn("block_b", each("blocks_b"))
    within = blocks.filter("copies > 1").select(F.col("print").alias("print_a"), F.col("print").alias("print_b"), "blocks").withColumn("block_a", each("blocks")).withColumn("block_b", F.explode(F.sequence(F.col("block_a"), F.col("blocks") - 1)))
    columns = ["print_a", "block_a", "print_b", "block_b"]
    met = across.select(columns).unionByName(within.select(columns))
    met = met.join(placed.select(F.col("print").alias("print_a"), F.col("block").alias("block_a"), F.col("id").alias("x")), ["print_a", "block_a"])
    met = met.join(placed.select(F.col("print").alias("print_b"), F.col("block").alias("block_b"), F.col("id").alias("y")), ["print_b", "block_b"])
    # Inside one block of one class every two ids meet twice.
    inside = (F.col("print_a") == F.col("print_b")) & (F.col("block_a") == F.col("block_b"))
    both = met.filter((F.col("x") != F.col("y")) & (~inside | (F.col("x") < F.col("y"))))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per id: its group (the smallest print reached by links), the number of links of
    its set to other sets and the number of ids with the very same set."""
    edges = pairs.select(F.col("print_a").alias("a"), F.col("print_b").alias("b"))
    labels = connected(edges)
    links = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "print")
    copies = members.groupBy("print").agg(F.count("*").alias("copies"))
    return (
        members.join(copies, "print").join(links, "print", "left").join(labels.withColumnRenamed("node", "print"), "print", "left")
        .select("id", F.coalesce("label", "print").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    )
