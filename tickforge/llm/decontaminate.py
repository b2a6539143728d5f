"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Normalised words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.  A window is ten
consecutive words of an item; a shorter item is one window.  Training texts are scanned with
rolling hashes, hits are verified word by word, and the words they cover are reported; documents
or the covered spans can then be removed.

The set is built once, on the driver, as sorted arrays of window hashes beside one buffer of the benchmark's normalised words,
and broadcast while the benchmark's texts stay under `SET_BYTES`; `Grams.nbytes` of it is at most about six times the texts.
A larger benchmark is scanned in blocks under that bound: documents are written once with a row number, each block reads their
texts alone and gives the rows that it hits, and these are joined back once.

Defined cases
* A null or empty text has no words and no hits; an item without words has no window.  Whole texts are read, a megabyte of words at a time.
* Repeated rows and ties: each row is scanned by itself.  Item ids are compared as strings; a
  null item id is the string `null`.  Equal items are separate items.
* An empty table gives an empty table; an empty benchmark gives no hits.  Extra columns pass
  through; results are added as n_words, hits and items behind `prefix`, and replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, arrow_batches, materialize, table
from .textbytes import fits, window_hashes, word_groups, word_hashes

N = 10
SET_BYTES = 32 << 20
#: ASCII letters lower-cased, digits and all bytes of non-ASCII characters stay; the rest ends a word.
_FOLD = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
RESULT = ("n_words", "hits", "items")
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Table:
    """The windows of one length: distinct sorted hashes, where each one's words stand in the buffer, and whose they are.

    Windows that share a hash but not their words (of a 64-bit hash, next to never) are apart in `odd`.
    """

    def __init__(self, buffer: bytes, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray):
        order = np.lexsort((owner, hashes))
        hashes, begin, end, owner = hashes[order], begin[order], end[order], owner[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        self.odd: dict[bytes, list[int]] = {}
        good = np.ones(len(hashes), bool)
        for i in np.flatnonzero(~new).tolist():
            lead = first[group[i]]
            if buffer[begin[i] : end[i]] != buffer[begin[lead] : end[lead]]:
                self.odd.setdefault(buffer[begin[i] : end[i]], []).append(int(owner[i]))
                good[i] = False
        keep = good & np.append(True, (group[1:] != group[:-1]) | (owner[1:] != owner[:-1]))
        self.hashes, self.begin, self.end = hashes[first], begin[first].astype(np.uint32), end[first].astype(np.uint32)
        self.owner, self.at = owner[keep].astype(np.uint32), np.append(0, np.cumsum(np.bincount(group[keep], minlength=len(first)))).astype(np.uint32)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.begin, self.end, self.owner, self.at, self.seen))


class Grams:
    """The windows of a block of items, by length, over one buffer of their normalised words."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.names = [item for item, _ in items]
        parts: list[bytes] = []
        made: dict[int, list[tuple[np.ndarray, ...]]] = {}
        at = 0
        for number, (_, text) in enumerate(items):
            words = normal_words(text)
            k = min(n, len(words))
            if not k:
                continue
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            begin = at + np.cumsum(size) - size
            h = window_hashes(word_hashes(words), k)
            made.setdefault(k, []).append((h, begin[: len(h)], (begin + size - 1)[k - 1 :], np.full(len(h), number)))
            parts.append(b" ".join(words))
            at += len(parts[-1]) + 1
        self.buffer = b" ".join(parts)
        self.tables = {k: Table(self.buffer, *(np.concatenate(c) for c in zip(*x, strict=True))) for k, x in made.items()}

    @property
    def nbytes(self) -> int:
        return len(self.buffer) + sum(t.nbytes for t in self.tables.values())

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Words, spans hit and items of each text."""
        n_words, hits, groups, items = np.zeros(len(texts), np.int64), [[] for _ in texts], [set() for _ in texts], [set() for _ in texts]
        for words, runs in word_groups(texts, normal_words, max([0, *(k - 1 for k in self.tables)])):
            np.add.at(n_words, runs[:, 0], runs[:, 2] - runs[:, 3])
            h, first = word_hashes(words), np.cumsum(runs[:, 2]) - runs[:, 2]
            for k, t in self.tables.items():
                w = window_hashes(h, k)
                some = np.flatnonzero(t.seen[w >> np.uint64(44)] & fits(runs, k)[: len(w)])
                place = np.minimum(np.searchsorted(t.hashes, w[some]), len(t.hashes) - 1)
                same = t.hashes[place] == w[some]
                some, place = some[same], place[same]
                for i, g, run in zip(some.tolist(), place.tolist(), (np.searchsorted(first, some, side="right") - 1).tolist(), strict=True):
                    said, doc = b" ".join(words[i : i + k]), int(runs[run, 0])
                    if said == self.buffer[t.begin[g] : t.end[g]]:
                        groups[doc].add((k, g))
                    elif said in t.odd:
                        items[doc].update(self.names[x] for x in t.odd[said])
                    else:
                        continue
                    at = int(runs[run, 1]) + i - int(first[run])
                    spans = hits[doc]
                    if spans and spans[-1][0] <= at <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], at + k))
                    else:
                        spans.append((at, at + k))
        for found, held in zip(items, groups, strict=True):
            for k, g in held:
                t = self.tables[k]
                found.update(self.names[x] for x in t.owner[t.at[g] : t.at[g + 1]].tolist())
        return n_words, hits, items


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(docs: DataFrame, grams, keep: list[str], text_col: str, names: list[str], hit_only: bool = False) -> DataFrame:
    """Columns `keep` of docs with the results of one set of windows, of the rows that it hits alone if hit_only."""
    at, kept = docs.columns.index(text_col), [docs.columns.index(c) for c in keep]
    results = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), _SPANS, T.ArrayType(T.StringType())), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, hits, found = grams.value.scan([x or b"" for x in b.column(at).cast(pa.large_binary()).to_pylist()])
            own = [pa.array(n_words), pa.array([[{"start": s, "end": e} for s, e in joined(x)] for x in hits], _HITS), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays([b.column(i) for i in kept] + own, names=[*keep, *names])
            yield out.filter(pa.array([bool(x) for x in hits], pa.bool_())) if hit_only else out

    return docs.mapInArrow(run, T.StructType([docs.schema[i] for i in kept] + results))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", set_bytes: int = SET_BYTES, prefix: str = "") -> DataFrame:
    """docs with n_words, hits (spans of words, merged) and items (ids of items with an occurring window), named behind `prefix`."""
    spark = docs.sparkSession
    arrow_batches(spark)
    names = [prefix + c for c in RESULT]
    docs = docs.drop(*(c for c in names if c != text_col))
    bench = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("id")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-size // set_bytes) or 1

    def grams(k: int):
        rows = bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        return spark.sparkContext.broadcast(Grams([(r["id"], r["text"].encode()) for r in rows.toLocalIterator()], n))

    if blocks == 1:
        return _scan(docs, grams(0), docs.columns, text_col, names)
    row = "_dec_row"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    hits = None
    for k in range(blocks):
        found = materialize(_scan(numbered.select(row, text_col), grams(k), [row], text_col, names, True), "decontaminate-hits")
        hits = found if hits is None else hits.unionByName(found)
    merged = hits.groupBy(row).agg(F.flatten(F.collect_list(names[1])).alias("_dec_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(names[2])))).alias(names[2]))
    merged = materialize(merged, "decontaminate-merged")
    if merged.count() <= BROADCAST_IDS:
        merged = F.broadcast(merged)
    # Spans of several blocks, in order, and each that touches the last one lengthens it.
    last = lambda a: F.element_at(a, -1)
    longer = lambda a, s: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    empty = F.array().cast(_SPANS)
    union = F.aggregate(F.array_sort("_dec_hits"), empty, lambda a, s: F.when((F.size(a) > 0) & (s["start"] <= F.when(F.size(a) > 0, last(a)["end"])), longer(a, s)).otherwise(F.concat(a, F.array(s))))
    words = _scan(numbered, spark.sparkContext.broadcast(Grams([], n)), numbered.columns, text_col, names).drop(*names[1:])
    out = words.join(merged, row, "left").withColumn(names[1], F.coalesce(union, empty)).withColumn(names[2], F.coalesce(F.col(names[2]), F.array().cast("array<string>")))
    return out.select(*docs.columns, *names)


def hit_words(hits: str = "hits"):
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def remove_documents(scanned: DataFrame, max_share: float = 0.0, prefix: str = "") -> DataFrame:
    """Documents with more than max_share of their words hit go."""
    return scanned.where(hit_words(f"{prefix}hits") <= max_share * F.col(f"{prefix}n_words")).drop(*(prefix + c for c in RESULT))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    d = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = hit_words()
    return d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(words)) AS k, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS g
      FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
ks AS (SELECT DISTINCT k FROM g),
w AS (SELECT doc_id, i, k, array_to_string(words[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, ks WHERE len(words) >= k)),
h AS (SELECT w.doc_id, w.i, w.k, g.item FROM w JOIN g ON w.k = g.k AND w.g = g.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op9_decontaminate": op9_decontaminate}
SQL = {"op9_decontaminate": OP9_SQL}
