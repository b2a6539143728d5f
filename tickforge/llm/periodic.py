"""Periodic runs of words: found in tiles by octaves of the period, stitched over tiles, and collapsed to one period.

A run is a maximal stretch with a smallest period q (words q apart are identical) of at least max(LEAST, 3 q) words.

* `tiles`: a document's words, numbered by value, go into tiles.  Periods under BASE share tiles of 4 BASE words; each octave [P, 2P)
  above has tiles of 8 P words.  Tiles overlap by the longest period they are for, so each pair (i, i + q) is in one tile's own part.
  A document that fits is one tile for all its periods.
* `fragments`: each tile is solved by itself.  Where words i and i + q are equal for 2q places or more, one of the blocks on the grid of
  P words lies inside, so windows of P words equal to such a block one octave of distance on are the candidates; prefix sums of hashes
  give them for all tiles of a batch at once, and their ends by bisection; words are compared in the end.  What touches a tile's border is
  found for every period by Z-functions from that border, at any length, as the next tile has the rest.
* `runs`: fragments are shuffled by document and period, those that touch are stitched, short ones go, and of periods with the same
  stretch the smallest is the run's.
* `collapse`: of each run only the words of its first period stay, unless another run takes them too.

Defined cases
* A null or empty text has no words and no runs, and collapses to the empty text.  Whole texts are read, whatever their length.
* Repeated rows: rows are told apart by id and text, and equal rows have equal results.  A null id is an id.
* Ties: runs of the same exponent go by start, then period.  An empty table gives an empty table.
* Extra columns pass through `collapse`; runs and collapsed (behind `prefix`) replace columns of these names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, materialize, table, words_of
from .textbytes import _power, mixed, segments

LEAST = 24
BASE = 4096
#: Words that a task works on at once, unless a tile has more.
GROUP = 1 << 19
#: Documents with runs are broadcast up to so many bytes of runs; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
_RUNS = "array<struct<start:long,length:long,period:long>>"


def needed(q: np.ndarray | int, least: int = LEAST):
    """Places i with words i and i + q equal that a run of period q has at least."""
    return np.maximum(least - q, 2 * q)


def z_values(s: list[int], upto: int) -> list[int]:
    """For each place under `upto`, how many elements from it on are those from the start on."""
    n, z = len(s), [0] * min(upto, len(s))
    if z:
        z[0] = n
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def border_fragments(words: list[int], own: int, low: int, high: int, first: bool, last: bool) -> set[tuple[int, int, int]]:
    """(period, start, end) of equal places at the border of a tile's own part, for all periods from low to below high."""
    out = set()
    n = len(words)
    if not first:
        for q, k in enumerate(z_values(words, high)):
            if q >= low and k:
                out.add((q, 0, min(k, own, n - q)))
    if not last:
        # From the border back: the own part reversed, against the tile reversed from each period behind the border.
        tail = words[: own + high]
        both = [*reversed(words[:own]), -1, *reversed(tail)]
        z = z_values(both, len(both))
        for q in range(low, min(high, n - own + 1)):
            k = z[own + 1 + len(tail) - own - q]
            if k:
                out.add((q, own - min(k, own), own))
    return {x for x in out if x[2] > x[1]}


def inner_fragments(tiles: list[np.ndarray], lows: np.ndarray, highs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tile, period, start, end) of the long stretches of equal places inside each tile; of those with the same words, the smallest period's."""
    size = np.fromiter(map(len, tiles), np.int64, len(tiles))
    found: list[tuple[np.ndarray, ...]] = []
    octave = 1
    while True:
        # Periods under 16 are tried one by one, then octaves.
        top = 16 if octave == 1 else 2 * octave
        live = np.flatnonzero((lows < top) & (highs > octave) & (size >= np.maximum(3 * octave, least)))
        if len(live):
            # One array of all tiles; a value of its own behind each, which equals nothing.
            begin = np.cumsum(np.append(0, size[live] + 1))
            v = np.concatenate([x for i, t in enumerate(live) for x in (tiles[t], [-1 - i])]).astype(np.int64)
            q, a, e = _short(v, least) if octave == 1 else _octave(v, octave, least)
            k = np.searchsorted(begin, a, side="right") - 1
            good = (q >= lows[live[k]]) & (q < highs[live[k]])
            found.append((live[k][good], q[good], (a - begin[k])[good], (e - begin[k])[good]))
        if not (size >= 3 * top).any():
            break
        octave = top
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    t, q, a, e = (np.concatenate(x) for x in zip(*found, strict=True))
    # The same words with several periods: e - a + q is the stretch's length.
    order = np.lexsort((q, e + q, a, t))
    t, q, a, e = t[order], q[order], a[order], e[order]
    new = np.append(True, (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | ((e + q)[1:] != (e + q)[:-1]))[: len(t)]
    t, q, a, e = t[new], q[new], a[new], e[new]
    parts = []
    for i in range(len(t)):
        w = tiles[t[i]]
        b, c = int(a[i]), int(e[i])
        if not np.array_equal(w[b:c], w[b + q[i] : c + q[i]]):
            # Hashes met that the words don't bear out: the true stretches between b and c.
            same = np.append(np.append(False, w[b:c] == w[b + q[i] : c + q[i]]), False)
            turn = np.flatnonzero(same[1:] != same[:-1])
            parts += [(t[i], q[i], b + x, b + y) for x, y in zip(turn[::2], turn[1::2], strict=True) if y - x >= needed(q[i], least)]
        else:
            parts.append((t[i], q[i], b, c))
    rows = np.array(parts, np.int64).reshape(-1, 4)
    return rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]


def _short(v: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = []
    for q in range(1, 16):
        if len(v) <= q:
            break
        same = np.zeros(len(v) - q + 2, bool)
        np.equal(v[:-q], v[q:], out=same[1:-1])
        turn = np.flatnonzero(same[1:] != same[:-1])
        a, e = turn[::2], turn[1::2]
        long = e - a >= needed(q, least)
        out.append((np.full(long.sum(), q), a[long], e[long]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))


def _octave(v: np.ndarray, p: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of equal places for periods from p to below 2p."""
    n = len(v)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(v.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    windows = (sums[p:] - sums[:-p]) * down[: n - p + 1]
    blocks = len(windows) // p
    padded = np.append(windows, np.zeros(-len(windows) % p, np.uint64)).reshape(-1, p)
    # Row k of padded starts block k: what equals block k lies in row k + 1.
    lead = padded[:blocks, 0]
    k, off = np.nonzero(padded[1:] == lead[: len(padded) - 1, None])
    x, q = k * p, p + off
    fits = x + q + p <= n
    x, q = x[fits], q[fits]
    if not len(x):
        return x, x, x
    # Blocks next to each other with one period are one chain, and less than p words are left on its sides.
    order = np.lexsort((x, q))
    x, q = x[order], q[order]
    start = np.append(True, (q[1:] != q[:-1]) | (x[1:] != x[:-1] + p))
    first = np.flatnonzero(start)
    stop = np.append(first[1:], len(x)) - 1
    a, e, q = x[first], x[stop] + p, q[first]
    long = e - a + 2 * (p - 1) >= needed(q, least)
    a, e, q = a[long], e[long], q[long]

    def equal(i: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (sums[i + m] - sums[i]) * down[i] == (sums[j + m] - sums[j]) * down[j]

    def furthest(most: np.ndarray, fits) -> np.ndarray:
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = fits(mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    left = furthest(np.minimum(a, p - 1), lambda m: equal(a - m, a - m + q, m))
    right = furthest(np.minimum(n - e - q, p - 1), lambda m: equal(e, e + q, m))
    a, e = a - left, e + right
    long = e - a >= needed(q, least)
    return q[long], a[long], e[long]


def numbered(text: bytes, number: defaultdict) -> np.ndarray:
    """The words of a text as numbers, a megabyte of text at a time."""
    parts = [np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in (s.split() for s in segments(text))]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def tiling(n: int, base: int = BASE, least: int = LEAST) -> Iterator[tuple[int, int, int, int]]:
    """(start, own part, lowest period, highest and one) of the tiles of n words."""
    most = n // 3 + 1
    if n < least:
        return
    if n <= 5 * base:
        yield 0, n, 1, most
        return
    low, high, own = 1, base, 4 * base
    while low < most:
        if n <= own + high:
            yield 0, n, low, min(high, most)
        else:
            for start in range(0, n, own):
                yield start, min(own, n - start), low, high
        low, high, own = high, 2 * high, 8 * high


def tiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: int = BASE, least: int = LEAST) -> DataFrame:
    """(_id, _key, start, own, low, high, last, words): the tiles of every document, words as packed 32-bit numbers."""
    arrow_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    names = ("start", "own", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number: defaultdict = defaultdict()
            number.default_factory = number.__len__
            rows, packed, held = [], [], 0

            def made() -> pa.RecordBatch:
                at = pa.array([r[0] for r in rows], pa.int64())
                own = [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 5)]
                return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *own, pa.array([r[5] for r in rows], pa.bool_()), pa.array(packed, pa.binary())], names=["_id", "_key", *names, "last", "words"])

            for i, text in enumerate(b.column(2)):
                w = numbered((text.as_py() or "").encode(), number)
                for start, own, low, high in tiling(len(w), base, least):
                    part = w[start : start + own + high]
                    rows.append((i, start, own, low, high, start + own >= len(w)))
                    packed.append(part.tobytes())
                    held += part.nbytes
                    if held > 4 * GROUP:
                        yield made()
                        rows, packed, held = [], [], 0
            if rows:
                yield made()

    schema = T.StructType([d.schema["_id"], d.schema["_key"], *(T.StructField(n, T.LongType()) for n in names), T.StructField("last", T.BooleanType()), T.StructField("words", T.BinaryType())])
    return d.mapInArrow(run, schema)


def fragments(tiles: DataFrame, least: int = LEAST) -> DataFrame:
    """(_id, _key, period, start, end): equal places, whole or cut at a tile's border; each tile is solved alone."""

    def solved(b: pa.RecordBatch) -> pa.RecordBatch:
        start, own, low, high = (b.column(i).to_numpy() for i in range(2, 6))
        words = [np.frombuffer(x, np.int32) for x in b.column(7).to_pylist()]
        t, q, a, e = inner_fragments(words, low, high, least)
        # Past its own part the next tile has it.
        keep = a < own[t]
        t, q, a, e = t[keep], q[keep], a[keep], np.minimum(e, own[t])[keep]
        more = [(i, *x) for i, last in enumerate(b.column(6).to_pylist()) if start[i] or not last for x in border_fragments(words[i].tolist(), int(own[i]), int(low[i]), int(high[i]), start[i] == 0, last)]
        if more:
            t, q, a, e = (np.append(x, y) for x, y in zip((t, q, a, e), np.array(more, np.int64).T, strict=True))
        at = pa.array(t)
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(q), pa.array(a + start[t]), pa.array(e + start[t])], names=["_id", "_key", "period", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield solved(b)

    schema = T.StructType([tiles.schema["_id"], tiles.schema["_key"], *(T.StructField(n, T.LongType()) for n in ("period", "start", "end"))])
    return tiles.mapInArrow(run, schema)


def runs(fragments: DataFrame, least: int = LEAST) -> DataFrame:
    """(_id, _key, runs): the runs of each document that has any, by start and period."""
    by = ["_id", "_key", "period"]
    f = fragments.repartition(*by).dropDuplicates([*by, "start", "end"])
    # A cut stretch may be found whole by one tile and in parts by others: what touches or overlaps is one.
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("_new", (F.coalesce(F.max("end").over(before), F.lit(-1)) < F.col("start")).cast("int"))
    f = f.withColumn("_part", F.sum("_new").over(Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    whole = f.groupBy(*by, "_part").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("length", F.col("end") - F.col("start") + F.col("period"))
    whole = whole.where(F.col("length") >= F.greatest(F.lit(least), 3 * F.col("period")))
    whole = whole.groupBy("_id", "_key", "start", "length").agg(F.min("period").alias("period"))
    return whole.groupBy("_id", "_key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: int = BASE, least: int = LEAST, prefix: str = "") -> DataFrame:
    """docs with runs (start, length and period in words) and collapsed: the words kept, joined by one space."""
    names = [prefix + "runs", prefix + "collapsed"]
    docs = docs.drop(*(c for c in names if c not in (id_col, text_col)))
    found = materialize(runs(fragments(tiles(docs, id_col, text_col, base, least), least), least), "periodic-runs")
    size = found.agg(F.coalesce(F.sum(F.size("runs") * 24 + 64), F.lit(0)).alias("n")).first()["n"]
    found = found.toDF("_id", "_key", "_found")
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    keyed = docs.withColumn("_text_key", F.xxhash64(docs[text_col]))
    joined = keyed.join(found, keyed[id_col].eqNullSafe(found["_id"]) & (keyed["_text_key"] == found["_key"]), "left").select(*(docs[c] for c in docs.columns), F.coalesce("_found", F.array().cast(_RUNS)).alias("_runs"))
    at, n, own, kind = docs.columns.index(text_col), len(docs.columns), docs.columns, joined.schema["_runs"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [without(text.as_py() or "", x) for text, x in zip(b.column(at), b.column(n), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*own, *names])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], kind), T.StructField(names[1], T.StringType())]))


def without(text: str, found: pa.ListScalar) -> str:
    """The words of a text without those that a run takes after its first period, joined by one space."""
    words = text.encode().split()
    if found.is_valid and len(found):
        start, length, period = (found.values.field(i).to_numpy() for i in range(3))
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, start + period, 1)
        np.add.at(drop, start + length, -1)
        words = [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d]
    return b" ".join(words).decode()


def strongest(found: Column) -> Column:
    """The run of the greatest length / period, compared exactly; ties by start, then period; null without runs."""
    ahead = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    # Runs come by start and period, so a later one must be ahead.
    return F.when(F.size(found) > 0, F.aggregate(found, F.element_at(found, 1), lambda best, r: F.when(ahead(r, best), r).otherwise(best)))


def planted(docs: DataFrame) -> DataFrame:
    """documents with the repeats that the query's contract puts into every tenth of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    w = words_of(F.col("text"))
    d = docs.withColumn("_w", F.when(h % 10 == 0, w)).withColumn("_n", F.size("_w").cast("long")).withColumn("_g", F.floor(h / 10))
    a = F.when(F.col("_n") > 0, F.pmod("_g", "_n"))
    p = 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.pmod("_g", F.lit(8))))
    d = d.withColumn("_a", a).withColumn("_p", p)
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p")))
    changed = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get("_w", place(i).cast("int"))), " ")
    return d.withColumn("text", F.when(F.col("_n") > 0, changed).otherwise(F.col("text"))).select(*docs.columns)


def op11_periodic(spark, sf_dir: str) -> DataFrame:
    c = collapse(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    all_runs = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    c = c.withColumn("_best", strongest(F.col("runs")))
    return c.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"), F.sha2(all_runs, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic": op11_periodic}
SQL: dict[str, str] = {}
