"""A Merkle manifest of a dataset: a content-addressed tree of digests, proofs by descent, and their check.

Leaves are digests of rows, in order of source and id; FAN consecutive nodes become their digest until one is left of each source,
and the sources' roots likewise become the root.  The store has a record a digest, its children's digests in order, and nothing
of places: a proof is found from the root alone.  Requests go down together, a level at a time: the base-FAN digits of a leaf's
rank choose a child of each record, the children not chosen are collected as a path segment, and the segments are reversed at the end.
A level's frontier has one row a distinct node that is asked for, so a hot source or a common ancestor isn't many rows of one key.

Ranks come from a sort by range: rows are written in order with their partition and place, and a partition's first rank in a source
is the sum over the table of partitions and sources.  No task holds a source.

Defined cases
* A null in a field is `-`.  A null source is a source of its own and the first; a null id comes first in its source.
* Ties and repeated rows: rows of one source and id are ordered by leaf digest; equal rows are leaves of their own with equal results.
* Whole texts are read.  An empty table gives an empty manifest, without a root, and an empty table of proofs.
* Extra columns pass through `leaves`; its own replace columns of their names: `leaf`, `_source`, `_id`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A table of partitions and sources, or of sources, is broadcast up to so many rows.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of a row's values: each `-` if null, else its UTF-8 byte count, a colon and the value."""
    own = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in own]), 256)


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with leaf, and _source and _id to order by."""
    return docs.withColumns({"leaf": leaf_of([docs[c] for c in fields]), "_source": docs[source_col].cast("string"), "_id": docs[id_col]})


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with source_no and rank, sources with source_no and their number of leaves), from leaves' columns."""
    by = [F.col("_source").asc_nulls_first(), F.col("_id").asc_nulls_first(), F.col("leaf")]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # Place in the sorted partition, and the partition: the two halves of the id that increases.
    ordered = materialize(ordered.withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33)), "merkle-order")
    parts = materialize(ordered.groupBy("_source", "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first")), "merkle-parts")
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sources = materialize(parts.groupBy("_source").agg(F.sum("_n").alias("n_leaves")), "merkle-counts")
    # Sources are numbered like leaves: a sort by range with the partitions' sums.
    place = materialize(sources.repartitionByRange(F.col("_source").asc_nulls_first()).sortWithinPartitions(F.col("_source").asc_nulls_first()).withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33)), "merkle-sources")
    offsets = place.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    offsets = offsets.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first"))
    numbered = place.join(F.broadcast(offsets.select("_part", "_offset")), "_part").select("_source", (F.col("_place") + F.col("_offset")).alias("source_no"), "n_leaves")
    numbered = materialize(numbered, "merkle-numbered")
    shift = parts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).withColumnRenamed("_source", "_s").select("_s", F.col("_part").alias("_p"), "_shift")
    shift = materialize(shift.join(_small(numbered.select(F.col("_source").alias("_t"), "source_no")), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t"), "merkle-shift")
    out = ordered.join(_small(shift), (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s")))
    return out.withColumn("rank", F.col("_place") + F.col("_shift")).drop("_s", "_p", "_part", "_place", "_shift"), numbered


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def height_of(n: Column, most: int) -> Column:
    """The same as a column, for numbers up to `most`."""
    out = F.lit(0)
    for k in range(height(most)):
        out = F.when(n > FAN**k, F.lit(k + 1)).otherwise(out)
    return out


def _grown(nodes: DataFrame) -> DataFrame:
    """(source_no, n, node, children, digest) of the level over (source_no, n, node, digest); n is the source's nodes there."""
    up = nodes.groupBy("source_no", "n", F.floor(F.col("node") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("_c"))
    children = F.col("_c")["digest"]
    return up.select("source_no", F.ceil(F.col("n") / FAN).alias("n"), F.col("up").alias("node"), children.alias("children"), F.sha2(F.concat_ws("", children), 256).alias("digest"))


@dataclass
class Manifest:
    """store: digest and children of every node above the leaves.  sources: source_no, n_leaves, subroot.  root: None if there is no leaf."""

    store: DataFrame
    sources: DataFrame
    root: str | None
    n_sources: int
    most_leaves: int


def build(rows: DataFrame, sources: DataFrame) -> Manifest:
    """The tree over (source_no, rank, leaf); a level is written before the next is made of it."""
    size = sources.agg(F.count("*").alias("n"), F.coalesce(F.max("n_leaves"), F.lit(0)).alias("most")).first()
    counts = _small(sources.select(F.col("source_no").alias("_no"), F.col("n_leaves").alias("n")))
    level = rows.select("source_no", F.col("rank").alias("node"), F.col("leaf").alias("digest")).join(counts, F.col("source_no") == F.col("_no")).select("source_no", "n", "node", "digest")
    ends, records = level.where("n = 1").select("source_no", "digest"), []
    for _ in range(height(size["most"])):
        level = materialize(_grown(level.where("n > 1")), "merkle-level")
        records.append(level.select("digest", "children"))
        ends = ends.unionByName(level.where("n = 1").select("source_no", "digest"))
    subroots = materialize(sources.drop("subroot").join(ends.withColumnRenamed("digest", "subroot"), "source_no"), "merkle-subroots")
    top = subroots.select(F.lit(0).alias("source_no"), F.lit(size["n"]).alias("n"), F.col("source_no").alias("node"), F.col("subroot").alias("digest"))
    for _ in range(height(size["n"])):
        top = materialize(_grown(top), "merkle-level")
        records.append(top.select("digest", "children"))
    last = top.first()
    store = records[0] if records else top.select("digest", F.array("digest").alias("children")).limit(0)
    for r in records[1:]:
        store = store.unionByName(r)
    # Equal nodes have one record.
    return Manifest(materialize(store.dropDuplicates(["digest"]), "merkle-store"), subroots, last["digest"] if last else None, size["n"], size["most"])


def _down(frontier: DataFrame, wanted: DataFrame, store: DataFrame) -> DataFrame:
    """wanted (its columns with source_no and node one level under the frontier) with digest and path, the record's other children added last."""
    f = frontier.join(store, "digest").select(F.col("source_no").alias("_no"), F.col("node").alias("_up"), "children", "path")
    d = wanted.join(f, (F.col("source_no") == F.col("_no")) & (F.floor(F.col("node") / FAN) == F.col("_up")))
    digit = F.pmod("node", F.lit(FAN)).cast("int")
    # A segment: the children to the left and to the right, as text, for each is only hashed.
    left, right = F.array_join(F.slice("children", F.lit(1), digit), ""), F.array_join(F.slice("children", digit + 2, F.lit(FAN)), "")
    segment = F.struct(left.alias("left"), right.alias("right"))
    return d.select(*wanted.columns, F.element_at("children", digit + 1).alias("digest"), F.concat("path", F.array(segment)).alias("path"))


def prove(requests: DataFrame, manifest: Manifest) -> DataFrame:
    """requests (source_no and rank, and more) with digest, the leaf found, subroot, and path: segments from the leaf to the root."""
    spark = requests.sparkSession
    own = [c for c in requests.columns if c not in ("digest", "subroot", "path")]
    low = requests.select("source_no", F.col("rank").alias("node"), F.struct(*own).alias("_row"))
    frontier = spark.createDataFrame([(0, 0, manifest.root)] if manifest.root else [], "source_no long, node long, digest string")
    frontier = frontier.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    numbers = materialize(low.select("source_no").distinct(), "merkle-asked")
    for h in reversed(range(height(manifest.n_sources))):
        wanted = numbers.select(F.lit(0).cast("long").alias("source_no"), F.floor(F.col("source_no") / FAN**h).alias("node")).distinct()
        frontier = materialize(_down(frontier, wanted, manifest.store), "merkle-frontier")
    heights = materialize(manifest.sources.select(F.col("source_no").alias("_no"), height_of(F.col("n_leaves"), manifest.most_leaves).alias("_h"), F.col("subroot").alias("_sub")), "merkle-heights")
    heights = _small(heights)
    subs = frontier.select(F.col("node").alias("source_no"), F.lit(0).cast("long").alias("node"), "digest", "path").join(heights, F.col("source_no") == F.col("_no"))
    subs = materialize(subs.select("source_no", "node", "digest", "path", "_h"), "merkle-frontier")
    # Nodes h levels over the leaves; lower sources join the frontier when their turn comes.
    frontier = subs.where("false").drop("_h")
    for h in range(height(manifest.most_leaves), 1, -1):
        frontier = subs.where(F.col("_h") == h).drop("_h").unionByName(frontier)
        live = low.join(heights.where(F.col("_h") >= h), F.col("source_no") == F.col("_no"), "left_semi")
        wanted = live.select("source_no", F.floor(F.col("node") / FAN ** (h - 1)).alias("node")).distinct()
        frontier = materialize(_down(frontier, wanted, manifest.store), "merkle-frontier")
    # The last level has a row a request: requests meet their parents' records here, and go no further.
    found = _down(subs.where("_h = 1").drop("_h").unionByName(frontier), low, manifest.store)
    lone = subs.where("_h = 0").select(F.col("source_no").alias("_no"), "digest", "path")
    found = found.unionByName(low.join(lone, F.col("source_no") == F.col("_no")).drop("_no"))
    found = found.join(heights.select("_no", "_sub"), F.col("source_no") == F.col("_no"))
    return found.select("_row.*", "digest", F.col("_sub").alias("subroot"), F.reverse("path").alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def siblings(path: Column) -> Column:
    """The digests of a proof, level by level from the leaf, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    tampered = leaf_of([F.col(c) for c in FIELDS[:-1]] + [shown])
    rows = leaves(docs).withColumn("shown", tampered).select("doc_id", "leaf", F.when(F.col("shown") != F.col("leaf"), F.col("shown")).alias("shown"), "_source", "_id")
    # Written, as a sort by range reads its input twice and texts are to be read once.
    order, sources = ranked(materialize(rows, "merkle-leaves"))
    order = materialize(order.select("doc_id", "source_no", "rank", "leaf", "shown"), "merkle-ranked")
    manifest = build(order, sources)
    p = prove(order, manifest)
    root = F.lit(manifest.root).cast("string")
    back = folded(F.coalesce("shown", "leaf"), F.col("path"))
    p = p.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), back.alias("folded_root"))
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6, top: int = 4) -> str:
    """Levels are unrolled: sources of up to 16**levels leaves and up to 16**top sources, which the given tables keep to."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(field(c) for c in FIELDS[:-1])
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    entry = "list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))"
    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, x: xor(c >> 8, crc[CAST(xor(c & 255, x) AS INTEGER) + 1]), 4294967295), 4294967295)"
    out = f"""WITH t AS (SELECT list({entry} ORDER BY i) AS crc FROM range(256) r(i)),
d AS (SELECT doc_id, source, sha256({head} || {field('text')}) AS leaf,
             sha256({head} || CASE WHEN {crc} % 5 = 0 THEN {field(low)} ELSE {field('text')} END) AS shown FROM documents, t),
l0 AS (SELECT doc_id, source, leaf, shown, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
n0 AS (SELECT source, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM l0)"""
    for k in range(levels):
        out += f""",
n{k + 1} AS (SELECT source, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, any_value((n + 15) // 16) AS n FROM n{k} WHERE n > 1 GROUP BY source, i // 16)"""
    ends = " UNION ALL ".join(f"SELECT source, h FROM n{k} WHERE n = 1" for k in range(levels + 1))
    out += f""",
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM ({ends})),
m0 AS (SELECT i, subroot AS h, n FROM s)"""
    for k in range(top):
        out += f""",
m{k + 1} AS (SELECT i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, any_value((n + 15) // 16) AS n FROM m{k} WHERE n > 1 GROUP BY i // 16)"""
    roots = " UNION ALL ".join(f"SELECT h FROM m{k} WHERE n = 1" for k in range(top + 1))
    out += f""",
r AS (SELECT h AS root FROM ({roots})),
p0 AS (SELECT doc_id, l0.source, leaf, subroot, l0.i, s.i AS j, '' AS p, shown AS f FROM l0 JOIN s ON l0.source IS NOT DISTINCT FROM s.source)"""
    side = "coalesce((SELECT string_agg(c.h, '' ORDER BY c.i) FROM {t} c WHERE {same}c.n > 1 AND c.i // 16 = p.{x} // 16 AND c.i {op} p.{x}), '')"
    at = 0
    for tree, count, x in (("n", levels, "i"), ("m", top, "j")):
        for k in range(count):
            same = "c.source IS NOT DISTINCT FROM p.source AND " if tree == "n" else ""
            a, b = (side.format(t=f"{tree}{k}", same=same, x=x, op=op) for op in "<>")
            here = "p.source IS NOT DISTINCT FROM g.source AND " if tree == "n" else ""
            group = f"SELECT DISTINCT {'source, ' if tree == 'n' else ''}n FROM {tree}{k}"
            keep = "i // 16 AS i, j" if tree == "n" else "i, j // 16 AS j"
            out += f""",
q{at} AS (SELECT p.*, coalesce(g.n, 1) > 1 AS more, CASE WHEN g.n > 1 THEN {a} ELSE '' END AS a, CASE WHEN g.n > 1 THEN {b} ELSE '' END AS b
       FROM p{at} p LEFT JOIN ({group}) g ON {here}true),
p{at + 1} AS (SELECT doc_id, source, leaf, subroot, {keep}, p || a || b AS p, CASE WHEN more THEN sha256(a || f || b) ELSE f END AS f FROM q{at})"""
            at += 1
    return out + f"""
SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM p{at}, r"""


QUERIES = {"op12_merkle": op12_merkle}
SQL = {"op12_merkle": _sql()}
