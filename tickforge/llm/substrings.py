"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of a document; its minimiser is the smallest hash among its
GRAM-word grams.  Consecutive windows with one minimiser are a super-k-mer and travel as one packed string to
the bucket of that minimiser, where the windows are sorted and so counted exactly.

1. Minimisers alone are counted: one that only one document has can't belong to a repeated window.
2. Super-k-mers of the others are packed and dealt to buckets.  A task keeps a bounded memory of
   what it has sent: what it has sent before with a smaller id is settled there and isn't sent again,
   so copies meet as one row a task.  Buckets of more than HOT windows are split by window: each goes, as its words, to the bucket
   of their digest, so a passage that a third of all documents share is spread and never gathered, and is still compared word by word.
   A super-k-mer that the task has met with a smaller id isn't split, and settled windows side by side are one row: a passage costs a document few rows, not one a window.
3. In a bucket, windows are sorted with their documents; all but those of the smallest id are removed.  Rows of a split
   bucket come by id, so the first of a window is its smallest and the others are told as they pass: a task holds each distinct window once.
4. The removed windows go back to their documents.

Texts are shuffled once by document; both later passes read that one shuffle.

Defined cases
* null text: no words.  Texts of fewer words than a window lose nothing.
* A row without an id takes no part: nothing is removed from it or on its account.
* Rows that repeat an id aren't smaller than each other; each gets its own result.
* An empty table gives an empty table.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, table
from .textbytes import fits, segments, window_hashes, word_groups, word_hashes

WINDOW, GRAM = 50, 8
#: Windows of a bucket, a few hundred bytes each: what one task holds.
HOT = 1 << 16
#: No packed string holds more windows than this, and a task remembers this many sent strings.
LONGEST, MEMORY = 256, 20_000


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values, by doubling."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def super_kmers(texts: list[bytes], window: int, gram: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, place in words, document, first window in document, windows, minimiser) of groups of documents."""
    for words, runs in word_groups(texts, bytes.split, window - 1):
        if len(words) < window:
            continue
        least = sliding_min(window_hashes(word_hashes(words), gram), window - gram + 1)
        n = len(least)
        ok = fits(runs, window)[:n]
        first = np.cumsum(runs[:, 2]) - runs[:, 2]
        run = np.repeat(np.arange(len(runs)), runs[:, 2])[:n]
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | (run[1:] != run[:-1]) | ~ok[:-1]
        new &= ok
        place = np.flatnonzero(new)
        # A super-k-mer ends before the next one, or with the windows of its run.
        last = np.minimum(np.append(place[1:], n), (first + runs[:, 2])[run[place]] - window + 1) if len(place) else place
        size = last - place
        cuts = -(-size // LONGEST)
        part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        place = np.repeat(place, cuts) + part * LONGEST
        size = np.minimum(np.repeat(last, cuts) - place, LONGEST)
        own = run[place]
        yield words, place, runs[own, 0], runs[own, 1] + place - first[own], size, least[place].view(np.int64)


def stretches(places: list[int]) -> list[tuple[int, int]]:
    """(first, number) of each stretch of consecutive places, which are distinct."""
    at = np.sort(np.array(places, np.int64))
    first = np.flatnonzero(np.diff(at, prepend=at[:1] - 2) != 1)
    return list(zip(at[first].tolist(), np.diff(first, append=len(at)).tolist(), strict=True))


def _minimisers(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, key, start, size, mini) of every super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, doc, start, size, mini in super_kmers([x or b"" for x in b.column(2).cast(pa.large_binary()).to_pylist()], window, gram):
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(mini)], names=["id", "key", "start", "size", "mini"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, key long, start int, size int, mini long")


def _pack(d: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows for the buckets: (bucket, id, key, start, n, packed, more).

    packed holds n windows as words; one of a split bucket has n = 0 and in more
    where else the document has it, so that a text which repeats itself is one row there;
    a null packed is settled: n windows from start are to be removed; such rows are dealt by id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}

        def settled(what: bytes, doc_id: int) -> bool:
            before = sent.get(what)
            if before is None or before >= doc_id:
                if before is None and len(sent) >= MEMORY:
                    for old in list(sent)[: MEMORY // 4]:
                        del sent[old]
                sent[what] = doc_id
                return False
            return True

        for b in batches:
            ids, keys, starts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            wanted = [{abs(s): s < 0 for s in x} if x else None for x in starts]
            texts = [x or b"" if w else b"" for x, w in zip(b.column(2).cast(pa.large_binary()).to_pylist(), wanted, strict=True)]
            out: list[tuple] = []
            for words, place, doc, start, size, mini in super_kmers(texts, window, gram):
                split: dict[tuple[int, bytes], list[int]] = {}
                gone: dict[int, list[int]] = {}
                for p, d, s, n, m in zip(place.tolist(), doc.tolist(), start.tolist(), size.tolist(), mini.tolist(), strict=True):
                    hot = wanted[d].get(s + 1)
                    if hot is None:
                        continue
                    packed = b" ".join(words[p : p + n + window - 1])
                    done = settled(packed, ids[d])
                    if done or not hot:
                        out.append((ids[d] if done else m, ids[d], keys[d], s, n, None if done else packed, None))
                        continue
                    for i in range(n):
                        split.setdefault((d, b" ".join(words[p + i : p + i + window])), []).append(s + i)
                for (d, own), places in split.items():
                    if settled(own, ids[d]):
                        gone.setdefault(d, []).extend(places)
                    else:
                        bucket = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)
                        out.append((bucket, ids[d], keys[d], places[0], 0, own, places[1:]))
                for d, places in gone.items():
                    out += [(ids[d], ids[d], keys[d], s, n, None, None) for s, n in stretches(places)]
                if len(out) > 4000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), ids_type, pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "id", "key", "start", "n", "packed", "more"])

    ids_type = pa.int32() if d.schema["id"].dataType.simpleString() == "int" else pa.int64()
    return d.mapInArrow(run, f"bucket long, id {d.schema['id'].dataType.simpleString()}, key long, start int, n int, packed binary, more array<int>")


class SplitBucket:
    """The windows of one split bucket, in the order of their documents: the first of each is kept in mind, and others are told as they come."""

    def __init__(self) -> None:
        self.first: dict[bytes, int] = {}

    def removals(self, doc: int, key: int, starts: Iterator[int], own: bytes) -> list[tuple]:
        return [(doc, key, s, 1) for s in starts] if self.first.setdefault(own, doc) < doc else []


def bucket_removals(rows: list[tuple], window: int) -> list[tuple]:
    """(id, key, start, n): the windows of one bucket to remove; rows are (id, key, start, n, packed) by id."""
    out, firsts = [], {}
    windows: list[tuple[bytes, int, int]] = []
    gone: dict[tuple[int, int], list[int]] = {}
    for doc, key, start, n, packed in rows:
        whole = firsts.setdefault(packed, doc)
        if whole < doc:  # all of it is in a smaller document
            out.append((doc, key, start, n))
            continue
        size = np.fromiter(map(len, packed.split(b" ")), np.int64) + 1
        begin = (np.cumsum(size) - size)[:n].tolist()
        end = (np.cumsum(size) - 1)[window - 1 :].tolist()
        for i, (a, b) in enumerate(zip(begin, end, strict=True)):
            windows.append((packed[a:b], doc, len(firsts)))
            firsts[len(firsts)] = (key, start + i)
    if len(rows) > 1:
        windows.sort()
        now, least = None, None
        for w, doc, k in windows:
            if w != now:
                now, least = w, doc
            elif doc > least:
                key, start = firsts[k]
                gone.setdefault((doc, key), []).append(start)
    # Windows side by side go as one row; a row that repeats an id and its text has the same places.
    for (doc, key), places in gone.items():
        out += [(doc, key, s, n) for s, n in stretches(list(set(places)))]
    return out


def _count(buckets: DataFrame, window: int) -> DataFrame:
    """(id, key, start, n): all windows to remove."""
    schema = buckets.schema
    kind = schema["id"].dataType.simpleString()
    ids_type = pa.int32() if kind == "int" else pa.int64()

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (ids_type, pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "key", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, split, out = None, [], SplitBucket(), []
        for b in batches:
            for bucket, doc, key, start, n, packed, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    out += bucket_removals(held, window)
                    now, held, split = bucket, [], SplitBucket()
                # A settled row and a window of a split bucket aren't held: of those there is no bound.
                if packed is None:
                    out.append((doc, key, start, n))
                elif n == 0:
                    out += split.removals(doc, key, (start, *more), packed)
                else:
                    held.append((doc, key, start, n, packed))
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
        out += bucket_removals(held, window)
        if out:
            yield batch(out)

    return buckets.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(run, f"id {kind}, key long, start int, n int")


def _keep(d: DataFrame, window: int) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) from (id, key, text, removals)."""

    def one(text: bytes, removals: list[dict] | None) -> tuple[int, int, str]:
        sha, at, gone, some = hashlib.sha256(), 0, 0, False
        first = np.array([r["start"] for r in removals or []], np.int64)
        last = first + np.array([r["n"] for r in removals or []], np.int64) + window - 1
        for part in segments(text):
            words = part.split()
            n = len(words)
            if len(first):
                near = (first < at + n) & (last > at)
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, np.maximum(first[near] - at, 0), 1)
                np.add.at(step, np.minimum(last[near] - at, n), -1)
                cut = np.cumsum(step[:n]) > 0
                gone += int(cut.sum())
                words = [words[i] for i in np.flatnonzero(~cut).tolist()]
            if words:
                sha.update((b" " if some else b"") + b" ".join(words))
                some = True
            at += n
        return at, gone, sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(t or b"", r) for t, r in zip(b.column(2).cast(pa.large_binary()).to_pylist(), b.column(3).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; ids are integers."""
    arrow_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    minis = materialize(_minimisers(d.where("id IS NOT NULL"), window, gram), "minimisers")
    shared = minis.groupBy("mini").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("size").alias("n")).where("low < high")
    # start + 1, negative for a bucket that is to be split.
    marked = minis.join(shared.select("mini", (F.col("n") > hot).alias("hot")), "mini").select("id", "key", F.when(F.col("hot"), -F.col("start") - 1).otherwise(F.col("start") + 1).alias("s"))
    wanted = marked.groupBy("id", "key").agg(F.collect_set("s").alias("starts")).toDF("w_id", "w_key", "starts")
    by_doc = d.repartition("id", "key")
    found = by_doc.join(wanted, (by_doc["id"] == wanted["w_id"]) & (by_doc["key"] == wanted["w_key"]), "left").select("id", "key", "text", "starts")
    removed = _count(_pack(found, window, gram), window)
    removed = removed.distinct().groupBy("id", "key").agg(F.collect_list(F.struct("start", "n")).alias("removals")).toDF("r_id", "r_key", "removals")
    out = by_doc.join(removed, (by_doc["id"] == removed["r_id"]) & (by_doc["key"] == removed["r_key"]), "left").select("id", "key", "text", "removals")
    return _keep(out, window).withColumnRenamed("id", "doc_id")


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50)),
f AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM w JOIN f USING (g) WHERE doc_id > least),
n AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda p: NOT list_contains(gone, p)), lambda p: words[p]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op6_substrings": op6_substrings}
SQL = {"op6_substrings": OP6_SQL}
