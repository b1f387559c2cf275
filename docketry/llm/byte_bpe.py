"""Encoding of a corpus with a public byte-level BPE vocabulary, vectorised.

Pre-tokenisation uses no regular expression. All texts of a batch become one array of code
points; a table gives each its class (letter, number, white space, other), and a scan with an
associative operator settles what depends on the left: each code point stands for a function
from state to state (how far a contraction such as ``'re`` still reaches), functions compose
by table look-up, and log2 doubling steps give every prefix at once. Boundaries then follow
from comparisons of neighbouring entries. The pattern matched is that of the public rank
files: contractions, letters, numbers and other marks, each with one space before them, and
white space of which the last one goes to what follows.

The slices between boundaries are looked up in a cache of merged pieces; a new piece is
merged pair by pair in rank order. Offsets of tokens in the text's UTF-8 bytes are kept on
request, so that any stretch of ids decodes to its place.

Defined cases: null and empty texts give an empty list; blank text is encoded as it stands;
text that looks like a special token is ordinary text; lone surrogates cannot occur in
Spark strings.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import spread

#: Where the public vocabulary file lies on the driver; a parameter of every operator below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Most pieces that a worker's cache holds; when full it starts anew.
CACHE = 1 << 20


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    for point in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[point] = SPACE
    return table


def _scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive scan of small functions (rows: position, columns: value per state) under
    composition, by doubling; composition is associative, so any grouping is right."""
    out = functions.copy()
    step = 1
    while step < len(out):
        head = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
        done = (out == out[:, :1]).all()
        if done:
            break
        out[step:] = head
        step *= 2
    return out


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where a piece begins. ``points`` are the code points of texts laid end to end;
    ``first`` marks each text's first code point."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = _classes()[np.minimum(points, sys.maxunicode)]
    last = np.ones(n, np.bool_)
    last[:-1] = first[1:]

    def ahead(array: np.ndarray, by: int, fill: int) -> np.ndarray:
        out = np.full(n, fill, array.dtype)
        out[:-by] = array[by:]
        return out

    one, two = ahead(points, 1, 0), ahead(points, 2, 0)
    same1 = ~last
    same2 = same1 & ~ahead(last.astype(np.uint8), 1, 1).astype(np.bool_)
    quote = points == ord("'")
    short = quote & same1 & ((one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d")))
    long = quote & same2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    # A quote may begin a contraction only where a piece can begin: not after another mark or a
    # single space that has taken it up. The left neighbour's class decides, and the state says
    # how many code points of a contraction are still to come.
    before = np.full(n, SPACE, np.uint8)
    before[1:] = kind[:-1]
    point_before = np.zeros(n, points.dtype)
    point_before[1:] = points[:-1]
    free = first | (before == LETTER) | (before == NUMBER) | ((before == SPACE) & (point_before != 0x20))
    # States: 0 outside, 1 and 2 code points to come, 3 just inside the last one.
    functions = np.zeros((n, 4), np.uint8)
    functions[:, 1] = 3
    functions[:, 2] = 1
    begins_short, begins_long = short & free & ~long, long & free
    # Right after a contraction a quote is free whatever its neighbour's class says.
    after_short, after_long = short & ~long, long
    for state in (0, 3):
        functions[:, state] = 0
    functions[begins_short, 0] = 1
    functions[begins_long, 0] = 2
    functions[after_short, 3] = 1
    functions[after_long, 3] = 2
    functions[first] = functions[first][:, :1]
    marked = np.flatnonzero(quote)
    state = np.zeros(n, np.uint8)
    if len(marked):
        state = _scan(functions)[:, 0]
    entered = np.zeros(n, np.uint8)
    entered[1:] = state[:-1]
    entered[first] = 0
    begins = ((entered == 0) | (entered == 3)) & ((state == 1) | (state == 2))
    inside = (entered == 1) | (entered == 2)
    closed = entered == 3  # the code point right after a contraction
    # A space joins what follows if it is a plain space and what follows is no white space.
    joined = np.zeros(n, np.bool_)
    joined[1:] = (points[:-1] == 0x20) & (kind[1:] != SPACE) & ~first[1:]
    start = first | closed | begins
    start |= (kind != SPACE) & ~joined & (kind != before)
    # White space: a run is one piece, but its last one is cut off if text follows.
    run_start = (kind == SPACE) & (before != SPACE)
    follows = np.zeros(n, np.bool_)
    follows[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:]
    start |= run_start | follows
    start &= ~inside
    return np.flatnonzero(start)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Cached pair merging over the slices between boundaries."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self.ranks = load_ranks(path)
        self.cache: dict[bytes, np.ndarray] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: neighbouring parts merge in order of rank, leftmost first."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and linked neighbours, for very long pieces."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n

        def pair(i: int) -> tuple[int, int, int] | None:
            j = right[i]
            if j >= n:
                return None
            rank = ranks.get(piece[i : end[j]])
            return None if rank is None else (rank, i, end[j])

        heap = [p for i in range(n) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], right[i] = end[j], right[j]
            if right[i] < n:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids of all texts end to end and where each text's ids begin."""
        joined = "".join(texts)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        begin = np.cumsum(lengths) - lengths
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), np.bool_)
        first[begin[lengths > 0]] = True
        cuts = boundaries(points, first)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        data = joined.encode("utf-8")
        edges = at[np.append(cuts, len(points))].tolist() if len(points) else [0]
        cache, merge = self.cache, self.merge
        if len(cache) > CACHE:
            cache.clear()
        ids: list[int] = []
        counts = np.empty(len(cuts), np.int64)
        extend, append = ids.extend, ids.append
        for i in range(len(cuts)):
            piece = data[edges[i] : edges[i + 1]]
            found = cache.get(piece)
            if found is None:
                found = tuple(merge(piece))
                if len(piece) <= 64:
                    cache[piece] = found
            if len(found) == 1:
                append(found[0])
            else:
                extend(found)
            counts[i] = len(found)
        upto = np.zeros(len(cuts) + 1, np.int64)
        np.cumsum(counts, out=upto[1:])
        offsets = np.zeros(len(texts) + 1, np.int64)
        offsets[:-1] = upto[np.searchsorted(cuts, begin, side="left")]
        offsets[-1] = upto[-1]
        return np.array(ids, np.int32), offsets

    @lru_cache(maxsize=1)
    def tokens(self) -> list[bytes]:
        back = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            back[rank] = token
        return back

    def token_offsets(self, ids: list[int]) -> list[int]:
        """Where each token begins in the text's UTF-8 bytes."""
        tokens, out, at = self.tokens(), [], 0
        for i in ids:
            out.append(at)
            at += len(tokens[i])
        return out

    def decode(self, ids: list[int]) -> str:
        tokens = self.tokens()
        return b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def _sent(documents: DataFrame, path: str) -> str:
    """Send the vocabulary along with the job, so that only the driver needs its path; the name to find it by."""
    context = documents.sparkSession.sparkContext
    key = (context.applicationId, path)
    if key not in _SENT:
        context.addFile(path)
        _SENT.add(key)
    return os.path.basename(path)


_SENT: set[tuple[str, str]] = set()


#: Code points laid end to end at a time; bounds a worker's memory whatever the batch holds.
CHUNK = 1 << 20


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """(id, ids[, starts]) of every document; ``starts`` are the byte places of the tokens."""
    source = spread(documents.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text")), "__id")
    kind = source.schema["__id"].dataType.simpleString()
    name = _sent(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(SparkFiles.get(name))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            done = 0
            for part in _chunks(texts):
                ids, begin = code.encode_batch(part)
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(0).slice(done, len(part)), lists]
                if offsets:
                    columns.append(pa.array([code.token_offsets(x) for x in lists.to_pylist()], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "ids"] + (["starts"] if offsets else []))
                done += len(part)

    return source.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>" + (", starts array<int>" if offsets else ""))


def count_tokens(documents: DataFrame, keep: list[str], text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns and the number of tokens of each text; the ids stay in the worker."""
    source = documents.select(*keep, F.col(text_column).alias("__text"))
    types = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep)
    name = _sent(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(SparkFiles.get(name))
        for batch in batches:
            counts = []
            for part in _chunks([t or "" for t in batch.column(len(keep)).to_pylist()]):
                _, begin = code.encode_batch(part)
                counts.append(np.diff(begin))
            tokens = np.concatenate(counts) if counts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(tokens, pa.int64())], names=[*keep, "tokens"])

    return source.mapInArrow(run, f"{types}, tokens bigint")
