"""SimHash near-duplicates, linked with BK-trees.

A fingerprint has 64 bits by majority over the XXH64 of a text's word shingles.  Only distinct
fingerprints are searched, with the smallest document id and nothing else of their documents.

Search: two fingerprints that differ in at most r bits agree on k of r + k parts of their bits.  For each choice of k parts
the fingerprints are dealt into shards by the bits of these, with k as small as keeps an even shard small (`choices`: a part of four up to sixteen
million fingerprints, two of five up to eight billion, and so on; all find the same links); a shard that holds more
than `SHARD` is cut into pieces by hash, and every pair of its pieces meets in a task of its own.
There a BK-tree of the one piece (children keyed by integer Hamming distance to the parent) is
searched with the fingerprints of the other, following only edges within the radius.  So a tree is
broadcast to the tasks that need it, of at most SHARD nodes, however large a shard is.  A task
returns a spanning forest of its links, never all pairs.

Near copies by similarity (`near_copies`): 3 of 64 bits are far fewer than a Jaccard similarity of 0.8 leaves
(about ten), and bands of so few bits as ten bits ask for don't part a large corpus.  So a text gets `WIDE` words of
fingerprint, over its distinct shingles; tables of bits drawn from them deal the texts into shards, as many bits
a table as keep an even shard near `EVEN` texts, and so many tables that a pair at the threshold shares a shard with
probability `RECALL`.  In a shard a BK-tree over the first word is followed within `FIRST_RADIUS`; pairs it finds are
proposed if the angle between the whole fingerprints and the numbers of shingles give a Jaccard
similarity of the threshold less `LOOSE` (four standard errors) or more.  Majorities of few shingles are biased, so a text of at
most `FEW` shingles is proposed by shared shingle hashes instead: the least of them under `ROWS` orders make a key, and texts that
share one of `BANDS` keys meet.  A fingerprint thus serves texts of more than FEW shingles and those that may be their copies.

Proposals only bring texts together: in each of their components the texts' distinct shingle hashes are
compared and two texts are linked if the Jaccard similarity of these is the threshold or more, whatever the sketches
said.  A component over `PIECE` texts or `PIECE_HASHES` hashes is cut into pieces by hash, and every two of its pieces meet in a task.

Components of the links are found in rounds of joins.

Defined cases
* A null text counts as empty; a text without words has fingerprint zero and is linked like any other.
* Repeated rows share a fingerprint, and so a component.  A null id is never the smallest of
  a component that has another; a component of null ids alone has a null id.
* Very long texts are read whole, a megabyte at a time.
* An empty table gives an empty table.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, arrow_batches, materialize, table, without_ids
from .components import components
from .textbytes import segments

BITS, RADIUS, SHARD = 64, 3, 4096
SHINGLE = 3
#: Near copies by similarity: 64-bit words of a fingerprint, texts in an even shard, shared shards of a pair at the threshold.
WIDE, EVEN, RECALL, FIRST_RADIUS, WIDE_SHARD = 8, 64, 0.99, 18, 2048
#: What a proposal's estimate may lie under the threshold; shingles of a text that keys propose, its keys, and orders a key.
LOOSE, FEW, BANDS, ROWS = 0.16, 160, 16, 5
PIECE, PIECE_HASHES = 1024, 1 << 19
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, bytes(range(97, 123)))
_BLOCK = 1 << 15


def shingle_hashes(text: bytes, shingle: int) -> Iterator[list[int]]:
    """XXH64 of a text's shingles, a segment of the text at a time."""
    carry, found, h = [], False, xxhash.xxh64_intdigest
    for part in segments(text.translate(_LOWER)):
        words = carry + part.split()
        if len(words) >= shingle:
            joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words)) + 1
            start = np.cumsum(size) - size
            end = (start + size - 1)[shingle - 1 :]
            found = True
            yield [h(joined[a:b], 42) for a, b in zip(start.tolist(), end.tolist(), strict=False)]
            carry = words[1 - shingle :] if shingle > 1 else []
        else:
            carry = words
    if not found and carry:
        yield [h(b" ".join(carry), 42)]


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of 255 rows fit a byte.
        whole = len(bits) // 255 * 255
        votes += bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return votes


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit b is 1 if more than half of the shingles' hashes have it."""
    votes, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        votes += _votes(np.array(hashes, dtype="<u8"))
        total += len(hashes)
    return int((1 << np.flatnonzero(2 * votes > total).astype(object)).sum()) if total else 0


def distinct_hashes(text: bytes, shingle: int) -> np.ndarray:
    parts = [np.array(x, dtype="<u8") for x in shingle_hashes(text, shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def wide_fingerprint(h: np.ndarray) -> bytes:
    """WIDE words of fingerprint over distinct hashes, each from hashes mixed anew."""
    bits = []
    for k in range(1, WIDE + 1):
        z = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits.append(2 * _votes(z ^ (z >> np.uint64(31))) > len(h))
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


_ORDERS = np.random.RandomState(5).randint(0, 1 << 62, BANDS * ROWS).astype(np.uint64) * np.uint64(4) + np.uint64(1)


def band_keys(h: np.ndarray) -> bytes:
    """BANDS keys of 64 bits, each of the least hash under ROWS orders; two texts share a key with their similarity to the power ROWS."""
    least = (h[:, None] * _ORDERS).min(0).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.tobytes()


def sketch(text: bytes, shingle: int, similarity: float) -> tuple[bytes, int, bytes, bytes, bytes]:
    """Digest and number of the distinct hashes, fingerprint and keys where they serve, and the hashes."""
    h = distinct_hashes(text, shingle)
    held, n = h.tobytes(), len(h)
    return hashlib.blake2b(held, digest_size=16).digest(), n, wide_fingerprint(h) if n >= similarity * FEW else b"", band_keys(h) if 0 < n <= FEW else b"", held


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    arrow_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x or b"", shingle) for x in b.column(1).cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


class BKTree:
    """Nodes in arrays.  A child hangs under its parent by its distance to it; children of a node lie side by side, in the order of that distance.

    With `group` (not decreasing) each group has a tree of its own, whose root is the group's first value.
    """

    def __init__(self, values: np.ndarray, group: np.ndarray | None = None):
        self.values = values
        n = len(values)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        # All values walk down together: those that meet at a node part by their distance to it, and of
        # each part the first becomes the child there.
        at = np.zeros(n, np.int64) if group is None else np.searchsorted(group, group)
        rest = np.flatnonzero(at != np.arange(n))
        while len(rest):
            d = np.bitwise_count(values[rest] ^ values[at[rest]]).astype(np.int64)
            _, first, which = np.unique(at[rest] * (BITS + 1) + d, return_index=True, return_inverse=True)
            child = rest[first]
            parent[child], edge[child] = at[child], d[first]
            at[rest] = child[which]
            rest = np.delete(rest, first)
        order = np.lexsort((edge, parent))
        self.children = order[np.count_nonzero(parent < 0) :]
        self.keys = parent[self.children] * (BITS + 1) + edge[self.children]

    def found(self, queries: np.ndarray, radius: int, roots: np.ndarray | None = None, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of every pair within the radius, some queries at a time; query i starts at node roots[i]."""
        for begin in range(0, len(queries) if len(self.values) else 0, block):
            q = np.arange(begin, min(begin + block, len(queries)))
            node = np.zeros(len(q), np.int64) if roots is None else roots[q]
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                yield q[near], node[near]
                low = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(d - radius, 0))
                high = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
                n = high - low
                q = np.repeat(q, n)
                node = self.children[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of every pair within the radius."""
        out = list(self.found(queries, radius))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes over links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (before == root).all():
            break
    return root


def _links(tree: np.ndarray, queries: np.ndarray, radius: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two pieces, or within one."""
    values = tree if own else np.concatenate([tree, queries])
    q, t = BKTree(tree).search(queries, radius)
    q = q if own else q + len(tree)
    root = forest(len(values), q[q != t], t[q != t])
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def choices(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """The choices of parts by which n fingerprints are dealt: of each, the (first bit, bits) of its parts.

    Bits differ in at most `radius` of `radius + k` parts, so k parts are whole: any k of them are a choice.
    """
    k = 1
    while k < 8 and n >> (k * BITS // (radius + k)) > 256:
        k += 1
    parts = radius + k
    at = [i * BITS // parts for i in range(parts + 1)]
    # A single part is cut to so many bits that an even shard has a few hundred fingerprints.
    lead = max(0, (max(n, 1) // 512).bit_length()) if k == 1 else BITS
    return [[(at[i], min(lead, at[i + 1] - at[i])) for i in which] for which in itertools.combinations(range(parts), k)]


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, dealt_as: list[list[tuple[int, int]]] | None = None) -> DataFrame:
    """Links (a, b) that join the same fingerprints as all links of at most radius bits do; fps has distinct fp."""

    def lead_of(choice: list[tuple[int, int]]) -> Column:
        out = F.lit(0).cast("long")
        for first, size in choice:
            out = F.shiftleft(out, size).bitwiseOR(F.shiftrightunsigned(F.col("fp"), BITS - first - size).bitwiseAND((1 << size) - 1)) if size else out
        return out

    cut = [lead_of(c) for c in dealt_as or choices(fps.count(), radius)]
    dealt = fps.select("fp", F.posexplode(F.array(*cut)).alias("band", "lead"))
    sizes = dealt.groupBy("band", "lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    pieces = sizes.select("band", "lead", F.ceil(F.col("n") / shard).cast("int").alias("pieces"))
    # Piece i of the shard goes to each task (i, j) and (j, i), as tree if it comes first and as query otherwise.
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    d = dealt.join(pieces, ["band", "lead"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    d = d.select("band", "lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("tree"), "fp")
    key = F.xxhash64("band", "lead", "i", "j").alias("key")
    d = d.select(key, "band", "lead", "i", "j", "tree", "fp")
    d = d.repartition("key").sortWithinPartitions("key", "band", "lead", "i", "j", "tree", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def solve(g: pd.DataFrame) -> pd.DataFrame:
            fp, tree = g["fp"].to_numpy().view(np.uint64), g["tree"].to_numpy()
            same = g["i"].iloc[0] == g["j"].iloc[0]
            a, b = _links(fp, fp, radius, True) if same else _links(fp[tree], fp[~tree], radius, False)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        def groups(pdf: pd.DataFrame, last: bool) -> tuple[list[pd.DataFrame], pd.DataFrame | None]:
            x = pdf[["band", "lead", "i", "j"]].to_numpy()
            edge = np.flatnonzero((x[1:] != x[:-1]).any(axis=1)) + 1
            bounds = [0, *edge.tolist(), len(pdf)]
            parts = [pdf.iloc[s:e] for s, e in zip(bounds, bounds[1:], strict=False)]
            return (parts, None) if last else (parts[:-1], parts[-1])

        # Sorted rows: a group may run over batches, and its rest is held; it has at most two pieces.
        for pdf in batches:
            if not len(pdf):
                continue
            done, rest = groups(pd.concat([*held, pdf]) if held else pdf, False)
            held = [rest]
            if out := [solve(g) for g in done if len(g) > 1]:
                yield pd.concat(out)
        if held and len(held[0]) > 1:
            yield solve(held[0])

    return d.mapInPandas(run, "a long, b long")


def tables_for(n: int, similarity: float) -> tuple[int, int]:
    """(bits a table, tables) that keep even shards of n texts near EVEN, and find a pair of the given similarity with probability RECALL."""
    bits = min(48, max(1, math.ceil(math.log2(max(n, 2) / EVEN)))) if n > EVEN else 1
    cosine = 2 * similarity / (1 + similarity)
    share = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - share))) if share < 1 else 1


def _pair_up(g: pd.DataFrame, group: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, in nodes, of the proposed links within whole groups: tree rows against query rows, or each other where i = j."""
    node, size = g["node"].to_numpy(), g["size"].to_numpy(np.float64)
    fp = np.frombuffer(b"".join(g["fp"]), "<u8").reshape(-1, WIDE)
    tree, own = g["tree"].to_numpy(), (g["i"] == g["j"]).to_numpy()
    t_rows, q_rows = np.flatnonzero(tree), np.flatnonzero(own | ~tree)
    t_group = group[t_rows]
    roots = np.searchsorted(t_group, group[q_rows])
    there = roots < len(t_rows)
    there[there] = t_group[roots[there]] == group[q_rows][there]
    q_rows, roots = q_rows[there], roots[there]
    a, b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def reduced() -> np.ndarray:
        return forest(len(node), np.concatenate(a), np.concatenate(b))

    for q, t in BKTree(fp[t_rows, 0], t_group).found(fp[q_rows, 0], FIRST_RADIUS, roots, 256):
        x, y = q_rows[q], t_rows[t]
        x, y = x[x != y], y[x != y]
        apart = np.zeros(len(x), np.int64)
        for w in range(WIDE):
            apart += np.bitwise_count(fp[x, w] ^ fp[y, w])
        shared = np.cos(np.pi * apart / (BITS * WIDE)) * np.sqrt(size[x] * size[y])
        near = shared >= similarity * (size[x] + size[y] - shared)
        a.append(x[near])
        b.append(y[near])
        held += len(a[-1])
        if held > 1 << 20:
            root = reduced()
            x = np.flatnonzero(root != np.arange(len(node)))
            a, b, held = [x], [root[x]], len(x)
    root = reduced()
    moved = np.flatnonzero(root != np.arange(len(node)))
    return node[moved], node[root[moved]]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[i] to start[i] + n[i] - 1 of each i, side by side."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def settled(hashes: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all pairs whose sets of hashes have the Jaccard similarity, exactly.

    A set of n hashes shares n * similarity with each of its like, so that any n - n * similarity + 1 of its hashes, the rarest here, lead to all of them.
    Texts are reached from one another, and those already reached aren't compared again.
    """
    size = np.array([len(x) // 8 for x in hashes], np.int64)
    start = np.cumsum(size) - size
    _, word = np.unique(np.frombuffer(b"".join(hashes), "<u8"), return_inverse=True)
    n_of = np.bincount(word)
    owner, first = np.repeat(np.arange(len(size)), size)[np.argsort(word, kind="stable")], np.cumsum(n_of) - n_of
    free, marked, a, b = np.ones(len(size), bool), np.zeros(len(n_of), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for seed in range(len(size)):
        if not free[seed]:
            continue
        free[seed], line = False, [seed]
        while line:
            x = line.pop()
            own = word[start[x] : start[x] + size[x]]
            enough = int(size[x]) - math.ceil(similarity * int(size[x]) - 1e-6) + 1
            rare = own[np.argsort(n_of[own], kind="stable")[:enough]]
            y = owner[_ranges(first[rare], n_of[rare])]
            y = np.unique(y[free[y]])
            y = y[(size[y] >= similarity * size[x] - 1e-6) & (size[x] >= similarity * size[y] - 1e-6)]
            if not len(y):
                continue
            marked[own] = True
            shared = np.add.reduceat(marked[word[_ranges(start[y], size[y])]].astype(np.int64), np.cumsum(size[y]) - size[y])
            marked[own] = False
            y = y[shared >= similarity * (size[x] + size[y] - shared) - 1e-6]
            free[y] = False
            line += y.tolist()
            a.append(np.full(len(y), x))
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def key_links(sketches: DataFrame) -> DataFrame:
    """Links (a, b) of every node (node, bands) to the smallest that shares a key with it."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": np.frombuffer(b"".join(pdf["bands"]), np.int64), "node": np.repeat(pdf["node"].to_numpy(), BANDS)})

    dealt = sketches.select("node", "bands").mapInPandas(deal, "key long, node long")
    least = dealt.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key", "a")
    return dealt.join(least, "key").where("a < node").select("a", F.col("node").alias("b")).distinct()


def settled_links(marked: DataFrame, nodes: DataFrame, proposed: DataFrame, similarity: float, piece: int = PIECE, piece_hashes: int = PIECE_HASHES) -> DataFrame:
    """Links (a, b) that join the same nodes as all links of the similarity within components (node, root) of proposals do."""
    member = nodes.join(proposed, "node").select("key", "least", "node", "root", "size")
    hot = member.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / piece), F.ceil(F.sum("size") / piece_hashes)).cast("int").alias("pieces")).where("pieces > 1")
    hot = materialize(hot, "hot-proposals")
    side = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    member = materialize(member.join(side, "root", "left").select("key", "least", "node", "root", F.coalesce("pieces", F.lit(1)).alias("pieces")), "proposed")
    side = F.broadcast(member) if member.count() <= BROADCAST_IDS else member
    # Of the rows of a text one is enough, as all have its hashes.
    d = marked.select("key", "doc_id", "hashes").join(side, "key").where(F.col("doc_id").eqNullSafe(F.col("least")))
    d = d.groupBy("node", "root", "pieces").agg(F.first("hashes").alias("hashes"))
    d = d.withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda x: x != F.col("own"))
    d = d.withColumn("other", F.explode(F.when(F.col("pieces") > 1, others).otherwise(F.array(F.lit(0)))))
    d = d.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "hashes")
    d = d.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(g: pd.DataFrame) -> pd.DataFrame:
            node = g["node"].to_numpy()
            a, b = settled(g["hashes"].tolist(), similarity)
            return pd.DataFrame({"a": node[a], "b": node[b]})

        held = None
        # Sorted rows: the last group of a batch may go on in the next, and waits for it; it has at most two pieces.
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            x = pdf[["root", "i", "j"]].to_numpy()
            edge = [0, *(np.flatnonzero((x[1:] != x[:-1]).any(axis=1)) + 1).tolist()]
            held = pdf.iloc[edge[-1] :].reset_index(drop=True)
            if out := [solve(pdf.iloc[s:e]) for s, e in zip(edge, edge[1:], strict=False)]:
                yield pd.concat(out)
        if held is not None:
            yield solve(held)

    return d.mapInPandas(run, "a long, b long")


def similar_links(sketches: DataFrame, similarity: float, shard: int = WIDE_SHARD) -> DataFrame:
    """Links (a, b) that join the same nodes as all pairs whose estimate is the similarity less LOOSE do; sketches (node, fp, size) are distinct."""
    bits, tables = tables_for(sketches.count(), similarity)
    r = np.random.RandomState(64)
    chosen = [r.permutation(BITS * WIDE)[:bits] for _ in range(tables)]
    power = 1 << np.arange(bits, dtype=np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ones = np.unpackbits(np.frombuffer(b"".join(pdf["fp"]), np.uint8).reshape(-1, 8 * WIDE), axis=1, bitorder="little")
            for i, at in enumerate(chosen):
                yield pdf.assign(shard=(i << 48) + ones[:, at] @ power)

    dealt = sketches.select("node", "fp", "size").mapInPandas(deal, "node long, fp binary, size long, shard long")
    keys = sketches.select("node", "fp", "size").mapInPandas(lambda x: (p[["shard"]] for p in deal(x)), "shard long")
    hot = keys.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard)
    hot = materialize(hot.select("shard", F.ceil(F.col("n") / shard).cast("int").alias("pieces")), "hot-shards")
    side = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    d = dealt.join(side, "shard", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    d = d.withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    d = d.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("tree"), "node", "size", "fp")
    d = d.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "tree", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(g: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
            a, b = _pair_up(g, group, similarity - LOOSE)
            return pd.DataFrame({"a": a, "b": b})

        held = None
        # Sorted rows: the last group of a batch may go on in the next, and waits for it; it has at most two pieces.
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            x = pdf[["shard", "i", "j"]].to_numpy()
            group = np.concatenate([[0], np.cumsum((x[1:] != x[:-1]).any(axis=1))])
            last = int(np.searchsorted(group, group[-1]))
            held = pdf.iloc[last:].reset_index(drop=True)
            if last:
                yield solve(pdf.iloc[:last], group[:last])
        if held is not None:
            yield solve(held, np.zeros(len(held), np.int64))

    return d.mapInPandas(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, shard: int = WIDE_SHARD, piece: int = PIECE) -> DataFrame:
    """(doc_id, component_id) for every row of docs: texts whose distinct shingles have the given Jaccard similarity are linked, if sketches bring them together.

    Texts without words are copies of each other.  Other cases are as for the fingerprints of 64 bits.
    """
    arrow_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = {"key": pa.binary(), "size": pa.int64(), "fp": pa.binary(), "bands": pa.binary(), "hashes": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sketch(x or b"", shingle, similarity) for x in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in made], kind) for i, kind in enumerate(kinds.values()))], names=["doc_id", *kinds])

    marked = materialize(d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, key binary, size long, fp binary, bands binary, hashes binary"), "sketches")
    nodes = materialize(marked.groupBy("key", "size", "fp", "bands").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "distinct-sketches")
    long, short = nodes.where(F.col("size") >= similarity * FEW), nodes.where((F.col("size") > 0) & (F.col("size") <= FEW))
    proposed = components(materialize(similar_links(long, similarity, shard).union(key_links(short)), "proposals"))
    roots = components(materialize(settled_links(marked, nodes, proposed, similarity, piece), "settled-links"))
    of = nodes.join(roots, "node", "left").select("key", "least", F.coalesce("root", "node").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    found = of.join(least, "root").select("key", "component_id")
    return marked.select("doc_id", "key").join(found, "key").select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(materialize(links(fps.select("fp"), radius, shard), "fingerprint-links"))
    of = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    # Copies are many rows of one fingerprint: they join once, with a side that has each fingerprint once.
    found = of.join(least, "root").select("fp", "component_id")
    return marked.join(found, "fp").select("doc_id", "fp", "component_id")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays.

    Components are those of `near_copies` if a similarity is given, and of `near_duplicates` otherwise.  Of rows that repeat an id one stays, whichever; rows without an id all stay.
    """
    found = near_copies(docs, id_col, text_col, similarity, shingle) if similarity else near_duplicates(docs, id_col, text_col, radius, shingle)
    found = materialize(found.select("doc_id", "component_id"), "components")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    twice = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_twice")).count().where("count > 1").select("_twice")
    kept = without_ids(docs, id_col, gone)
    if not twice.limit(1).count():
        return kept
    once = kept.join(twice, F.col(id_col) == F.col("_twice"), "left_anti")
    return once.unionByName(kept.join(twice, F.col(id_col) == F.col("_twice"), "left_semi").dropDuplicates([id_col]))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
SQL: dict[str, str] = {}
