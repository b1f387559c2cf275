"""Splitting oversized texts at natural boundaries by dynamic programming.

A text of more than ``limit`` characters becomes pieces of at most ``limit`` characters;
each piece begins ``overlap`` characters before the end of the piece before it. Places where
a piece may end are boundaries of falling strength: blank line, line break, end mark, white
space, any character. The dynamic programme over all these places minimises the sum of the cut
penalties and of the squared deviation from the even piece size. Any character is a place only
where no natural boundary can be reached: in stretches without one that are longer than the
limit less the overlap, and there every character is. Elsewhere a piece can always end at a
natural boundary, so the programme always finds pieces.

Defined cases: null, empty and short texts are not split (``pieces`` gives none for null and
one whole piece for the others if ``keep_short``); characters are Unicode code points; one
endless word is cut anywhere. Repeated deliveries of an id count once, the latest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["blank_line", "line", "sentence", "space", "hard"]
PENALTY = [0.0, 0.3, 0.6, 2.0, 50.0]
IMBALANCE = 4.0

#: The end marks at which a text may be cut.
END_MARKS = ".!?;。！？；।"
_BOUNDARY = re.compile(rf"(?P<blank>\n[^\S\n]*\n\s*)|(?P<line>\n)|(?P<mark>[{END_MARKS}]+[\"'”’»）)」』\]]*[^\S\n]?)|(?P<space>\s+)")
_FREE_RUN = re.compile(rf"[^\s{END_MARKS}]+")


def longest_run(text: str) -> int:
    """The most consecutive characters that are neither white space nor an end mark."""
    return max((m.end() - m.start() for m in _FREE_RUN.finditer(text)), default=0)


def _boundaries(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, kinds) in rising order, the strongest kind of each place; kinds index KINDS."""
    number = {"blank": 0, "line": 1, "mark": 2, "space": 3}
    found = [(m.end(), number[m.lastgroup]) for m in _BOUNDARY.finditer(text)]
    places, kinds = np.array([p for p, _ in found], np.int64), np.array([k for _, k in found], np.int64)
    edges = np.concatenate([[0], places, [len(text)]])
    # From the start a piece reaches the limit; behind a cut it begins with the overlap.
    wide = np.flatnonzero(np.diff(edges) > np.where(edges[:-1] == 0, limit, limit - overlap))
    more = [np.arange(edges[w] + 1, edges[w + 1]) for w in wide]
    places, kinds = np.concatenate([places, *more]), np.concatenate([kinds, *(np.full(len(x), 4) for x in more)])
    inside = (places > overlap) & (places < len(text))
    order = np.argsort(places[inside], kind="stable")
    return places[inside][order], kinds[inside][order]


#: Places within so many characters are decided together.
STRETCH = 1024


def _least(x: np.ndarray, first: np.ndarray, places: np.ndarray, best: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """(value, index) of the least ``best + weight * (x - place) ** 2`` from index ``first`` on, for
    rising x and first; infinite where there is none.

    The cost is convex, so the index never falls as x rises: the middle one halves the search
    of all others, and all middles of a round are found in one pass.
    """
    value, index = np.full(len(x), np.inf), np.full(len(x), -1, np.int64)
    r0, r1, c0, c1 = (np.array([k]) for k in (0, len(x) - 1, 0, len(places) - 1))
    while len(r0):
        mid = (r0 + r1) // 2
        low = np.maximum(c0, first[mid])
        size = np.maximum(c1 - low + 1, 0)
        some = size > 0
        start = np.cumsum(size) - size
        node = np.repeat(np.arange(len(mid)), size)
        k = np.arange(len(node)) + np.repeat(low - start, size)
        cost = best[k] + weight * (x[mid][node] - places[k]) ** 2
        least, at = np.full(len(mid), np.inf), np.where(some, low, -1)
        if len(k):
            least[some] = np.minimum.reduceat(cost, start[some])
            hits = np.flatnonzero(cost == least[node])
            at[node[hits[::-1]]] = k[hits[::-1]]
        value[mid], index[mid] = least, at
        left, right = r0 < mid, mid < r1
        r0, r1, c0, c1 = (
            np.concatenate(pair)
            for pair in ((r0[left], mid[right] + 1), (mid[left] - 1, r1[right]), (c0[left], np.where(some, at, c0)[right]), (np.where(some, at, c1)[left], c1[right]))
        )
    return value, index


def cut_places(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """(place, kind) of the ends of all pieces but the last."""
    n = len(text)
    if n <= limit:
        return []
    places, kinds = _boundaries(text, limit, overlap)
    penalty = np.append(np.array(PENALTY)[kinds], 0.0)
    places, kinds = np.append(places, n), np.append(kinds, 0)
    count = -(-(n - overlap) // (limit - overlap))
    even = (n + (count - 1) * overlap) / count
    weight = IMBALANCE / limit**2
    # The first piece begins at 0, every other one `overlap` before the end of the one before.
    best = np.where(places <= limit, penalty + weight * (places - even) ** 2, np.inf)
    via = np.full(len(places), -1, np.int64)
    earliest = np.searchsorted(places, places - limit + overlap)
    wanted = places + overlap - even

    def relax(a: int, b: int, c: int) -> None:
        """Pieces that end at places a to b behind a cut before c."""
        value, index = _least(wanted[a:b], earliest[a:b], places[:c], best[:c], weight)
        value += penalty[a:b]
        better = value < best[a:b]
        best[a:b], via[a:b] = np.where(better, value, best[a:b]), np.where(better, index, via[a:b])

    a = 0
    while a < len(places):
        b = int(np.searchsorted(places, places[a] + STRETCH, side="right"))
        if earliest[a] < a:
            relax(a, b, a)
        # A piece between two cuts of this stretch is short; mostly that cannot pay.
        short = max(0.0, even - (places[b - 1] - places[a] + overlap))
        if (best[a:b].min() + penalty[a:b] + weight * short**2 < best[a:b]).any():
            for i in range(a + 1, b):
                relax(i, i + 1, i)
        a = b
    out, i = [], int(via[-1])
    while i >= 0:
        out.append((int(places[i]), KINDS[int(kinds[i])]))
        i = int(via[i])
    return out[::-1]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of every piece; the last one ends with ``end``."""
    cuts = cut_places(text, limit, overlap)
    starts = [0] + [p - overlap for p, _ in cuts]
    ends = cuts + [(len(text), "end")]
    return [(s, e, kind) for s, (e, kind) in zip(starts, ends)]


def pieces(
    texts: DataFrame, keep: list[str], text_column: str = "content", limit: int = 8000, overlap: int = 400, keep_short: bool = False
) -> DataFrame:
    """The pieces of every text over the limit: the ``keep`` columns, piece_no (from 1), pieces,
    piece_start and piece_end (0-based, end exclusive, within the text), cut (kind of the
    boundary at its end), hard_cuts and longest_run of the whole text, and piece (its text)."""
    if not 0 <= overlap * 2 <= limit:
        raise ValueError("the overlap must be at most half the limit")
    source = texts.select(*keep, F.col(text_column).alias("__text")).filter("__text is not null")
    if not keep_short:
        source = source.filter(F.length("__text") > limit)
    schema = T.StructType([source.schema[k] for k in keep] + [
        T.StructField("piece_no", T.IntegerType()), T.StructField("pieces", T.IntegerType()), T.StructField("piece_start", T.IntegerType()),
        T.StructField("piece_end", T.IntegerType()), T.StructField("cut", T.StringType()), T.StructField("hard_cuts", T.IntegerType()), T.StructField("longest_run", T.IntegerType()), T.StructField("piece", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                parts = split_text(text, limit, overlap)
                hard, longest = sum(kind == "hard" for *_, kind in parts), longest_run(text)
                for no, (a, b, kind) in enumerate(parts, 1):
                    take.append(i)
                    rows.append((no, len(parts), a, b, kind, hard, longest, text[a:b]))
            index = pa.array(take, pa.int64())
            kinds = [pa.int32()] * 4 + [pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(index) for k in range(len(keep))] + [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)],
                names=[*keep, "piece_no", "pieces", "piece_start", "piece_end", "cut", "hard_cuts", "longest_run", "piece"],
            )

    return source.mapInArrow(run, schema)


def oversized_chunks(chunks: DataFrame, limit: int = 8000, overlap: int = 400) -> DataFrame:
    """Pieces of every oversized chunk_id of document_chunk.

    start_position and end_position of a piece continue the chunk's own start_position, or
    count from 0 where that is null.
    """
    large = chunks.filter((F.length("content") > limit) & F.col("chunk_id").isNotNull())
    once = large.groupBy("chunk_id").agg(F.max_by(F.struct("content", "start_position"), F.struct("ingested_at", "load_id")).alias("c")).select("chunk_id", "c.*")
    found = pieces(once, ["chunk_id", "start_position"], "content", limit, overlap)
    base = F.coalesce("start_position", F.lit(0))
    return found.select("chunk_id", "piece_no", "pieces", (base + F.col("piece_start")).alias("start_position"), (base + F.col("piece_end")).alias("end_position"), "piece_start", "piece_end", "cut", "hard_cuts", "longest_run", "piece")
