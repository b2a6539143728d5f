"""Language ID by Bayesian evidence fusion.

The posterior of a language is the product of
* the text's likelihood: naive Bayes over hashed byte trigrams of its letters, tempered, as trigrams of a text
  depend on each other;
* the likelihood of the declared markup language and of the address suffix, given the language;
* a prior of its host, smoothed towards its domain, and that towards the whole corpus.

The last three come from grouped sums of text posteriors over all rows; a row's own part is
taken out of what it is judged by.  The trigram model is fitted on the driver on at most LABEL_ROWS rows of each label (those whose ids have the smallest hashes), of
each a span of at most TRAIN_CHARS characters at a place that its hash chooses; all else covers every row and whole texts.  It is fitted in two halves, by a hash of the
id, and a row is scored with the half that rows like it had no part in: so a row's declared label never stands behind its text's likelihood as well.
A label is a language of the model if LEAST_ROWS rows of the whole table have it, however many rows others have; of more such labels than MOST_LANGUAGES those
with the most rows are (ties by label), and the rest count as labels of too few rows do.

Sums of the groups come from one table of all combinations of label, suffix, domain and host; each level's is broadcast up to BROADCAST_VALUES
numbers, and joined by shuffle beyond, where adaptive execution splits a hot host.

A row is rejected if its text has no letters, if no language explains its letters (its mean
log-likelihood lies well below that of every training row), if its posterior is under MIN_POSTERIOR, or
if its language isn't wanted.

Defined cases
* null text counts as empty: language `und`, rejected.  Long texts are read whole, a block of words at a time.  Null host, suffix, domain or label: a value of its own.
* Repeated rows and ties: each row is judged by itself; of languages with equal posteriors the
  first in order is taken.  A label of fewer than LEAST_ROWS rows is no language of the model: its rows get the nearest language
  or `und`.  Without any label of so many rows every language is `und`.  A row without an id isn't trained on.
* An empty table gives an empty table.  Extra columns are not read by `identify`; `keep` passes them on.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import INLINE, pieces
from .common import arrow_batches, materialize, table, without_ids

LABEL_ROWS, TRAIN_CHARS, LEAST_ROWS, MOST_LANGUAGES = 500, 20_000, 15, 1000
BROADCAST_VALUES = 1_000_000
BUCKETS = 1 << 15
MIN_POSTERIOR = 0.5
#: Nats a trigram under the worst training row, and the trigrams that a text needs to be called unexplained.
FIT_MARGIN, FIT_TRIGRAMS = 1.5, 40
#: Pseudo-counts of the corpus in a domain's, of the domain in a host's, and in a label's distribution.
DOMAIN_WEIGHT, HOST_WEIGHT, LABEL_WEIGHT = 20.0, 20.0, 5.0
_LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BLOCK = 1 << 20


def trigrams(text: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of the byte trigrams of a text's letters, with one space around each word, a block at a time."""
    words = text.translate(_LETTERS).split()
    for i in range(0, len(words), _BLOCK // 8):
        b = np.frombuffer(b" " + b" ".join(words[i : i + _BLOCK // 8]) + b" ", np.uint8).astype(np.uint32)
        yield ((b[:-2] * np.uint32(961_748_941) + b[1:-1] * np.uint32(32_452_843) + b[2:] * np.uint32(15_485_863)) >> np.uint32(7)) & np.uint32(BUCKETS - 1)


class Model:
    """languages; logs[half][bucket, language]; least, the mean log-likelihood that a text of a known language reaches.

    rows are (label, half, text).  logs[half] is counted on the rows of the other half, but for a language that has none there, which is counted on its own.
    """

    def __init__(self, rows: list[tuple[str, int, bytes]]):
        self.languages = sorted({x for x, _, _ in rows})
        counts = np.zeros((2, BUCKETS, len(self.languages)))
        place = {x: i for i, x in enumerate(self.languages)}
        for x, half, t in rows:
            for g in trigrams(t):
                counts[1 - half, :, place[x]] += np.bincount(g, minlength=BUCKETS)
        counts = np.where(counts.sum(1, keepdims=True) > 0, counts, counts[::-1])
        self.logs = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * BUCKETS)).astype(np.float32)
        means = [s.max() / n for s, n in (self.score(t, half) for _, half, t in rows) if n >= 30]
        self.least = float(min(means)) - FIT_MARGIN if means else -np.inf

    def score(self, text: bytes, half: int) -> tuple[np.ndarray, int]:
        total, n = np.zeros(len(self.languages)), 0
        for g in trigrams(text):
            total += self.logs[half][g].sum(0, dtype=np.float64)
            n += len(g)
        return total, n


def half_of(id_: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), id_), F.lit(2)).cast("int")


def smallest_hashes(d: DataFrame, counts: dict, rows: int) -> DataFrame:
    """(_label, _id): of each label in counts (its rows) the `rows` ids of smallest hash, an id counting once.

    Only ids under a bound of the hash that about twice as many pass are compared, so that no task gets a whole label.  Where too few pass, as ids repeat, the
    bound is raised; the ids chosen don't depend on it.
    """
    share = {x: min(1.0, 2 * (rows + 50) / n) for x, n in counts.items()}
    schema = T.StructType([T.StructField("_label", d.schema["_label"].dataType), T.StructField("_bound", T.LongType())])
    while True:
        bounds = d.sparkSession.createDataFrame([(x, min((1 << 63) - 1, int(s * (1 << 64)) - (1 << 63))) for x, s in share.items()], schema)
        near = d.select("_label", "_id", F.xxhash64(F.lit("language"), "_id").alias("_h")).join(F.broadcast(bounds), "_label").where("_h <= _bound")
        near = materialize(near.select("_label", "_id", "_h").distinct(), "language-candidates")
        found = {r["_label"]: r["count"] for r in near.groupBy("_label").count().collect()}
        few = [x for x, s in share.items() if s < 1 and found.get(x, 0) < rows]
        if not few:
            best = Window.partitionBy("_label").orderBy("_h", "_id")
            return near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= rows).select("_label", "_id")
        share |= {x: min(1.0, 4 * share[x]) for x in few}


def fit(docs: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id", rows: int = LABEL_ROWS) -> Model:
    """The rows of a label are chosen by their ids alone; only the chosen texts follow."""
    d = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(label).alias("_label"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    enough = d.groupBy("_label").count().where(F.col("count") >= LEAST_ROWS).orderBy(F.col("count").desc(), "_label").limit(MOST_LANGUAGES).collect()
    chosen = smallest_hashes(d, {r["_label"]: r["count"] for r in enough}, rows)
    span = F.substr("_text", (F.lit(1) + F.pmod(F.xxhash64(F.lit("span"), "_id"), F.greatest(F.lit(1), F.length("_text") - TRAIN_CHARS + 1))).cast("int"), F.lit(TRAIN_CHARS))
    sample = d.join(F.broadcast(chosen), ["_label", "_id"], "left_semi").groupBy("_label", "_id").agg(F.min(span).alias("_text"))
    return Model(sorted((r["_label"], r["_half"], r["_text"].encode()) for r in sample.withColumn("_half", half_of(F.col("_id"))).collect()))


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """docs (id, text, declared, suffix, domain, host) without text, with n trigrams, mean, and the tempered log-likelihoods ev."""
    arrow_batches(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select("id", "declared", "suffix", "domain", "host", "text", half_of(F.col("id")).alias("half"))
    names = [*d.columns[:5], "n", "mean", "ev"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [own.value.score(x or b"", half) for x, half in zip(b.column(5).cast(pa.large_binary()).to_pylist(), b.column(6).to_pylist(), strict=True)]
            mean = [float(s.max() / n) if n and len(s) else None for s, n in scores]
            # Trigrams overlap and repeat: n of them weigh as 2 * sqrt(n).
            ev = [((s - s.max()) * (2 / np.sqrt(n))).tolist() if n and len(s) else [0.0] * len(s) for s, n in scores]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([n for _, n in scores], pa.int64()), pa.array(mean, pa.float64()), pa.array(ev, pa.list_(pa.float64()))], names=names)

    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(run, f"id {kind}, declared string, suffix string, domain string, host string, n long, mean double, ev array<double>")


def fuse(ev: DataFrame, model: Model, min_posterior: float = MIN_POSTERIOR, wanted: list[str] | None = None) -> DataFrame:
    """(id, lang, probability, text_lang, kept) from materialized evidence."""
    names = model.languages
    m = range(len(names))
    if not names:
        return ev.select("id", F.lit("und").alias("lang"), F.lit(0.0).alias("probability"), F.lit("und").alias("text_lang"), F.lit(False).alias("kept"))
    raw = [F.when(F.col("n") > 0, F.exp(F.col("ev")[i])).otherwise(F.lit(0.0)) for i in m]
    sum_of = lambda x: sum(x[1:], x[0])
    p = ev.select("*", *(F.coalesce(F.try_divide(raw[i], sum_of(raw)), F.lit(0.0)).alias(f"p{i}") for i in m))
    cells = materialize(p.groupBy("declared", "suffix", "domain", "host").agg(*(F.sum(f"p{i}").alias(f"c{i}") for i in m)), "language-cells")
    sums = lambda x: [F.sum(f"c{i}").alias(f"{x}{i}") for i in m]
    whole = cells.agg(*sums("g")).first()
    g = [float(whole[i] or 0.0) + 1.0 for i in m]
    share = [x / sum(g) for x in g]
    d, n_values = p, {}
    for level in ("declared", "suffix", "domain", "host"):
        by = materialize(cells.groupBy(F.col(level).alias(f"_{level}")).agg(*sums(level[:3])), f"language-{level}")
        n_values[level] = max(1, by.where(F.col(f"_{level}").isNotNull()).count())
        if n_values[level] * (len(names) + 2) <= BROADCAST_VALUES:
            by = F.broadcast(by)
        d = d.join(by, F.col(level).eqNullSafe(F.col(f"_{level}")), "left").drop(f"_{level}")

    def rest(level: str, i: int) -> Column:
        """The sum of a group without the row's own part."""
        return F.greatest(F.lit(0.0), F.col(f"{level[:3]}{i}") - F.col(f"p{i}"))

    score = []
    for i in m:
        label = [F.log((rest(level, i) + LABEL_WEIGHT / n_values[level]) / (F.greatest(F.lit(0.0), F.lit(g[i]) - F.col(f"p{i}")) + LABEL_WEIGHT)) for level in ("declared", "suffix")]
        domain = (rest("domain", i) + DOMAIN_WEIGHT * share[i]) / (sum_of([rest("domain", j) for j in m]) + DOMAIN_WEIGHT)
        host = (rest("host", i) + HOST_WEIGHT * domain) / (sum_of([rest("host", j) for j in m]) + HOST_WEIGHT)
        score.append((F.col("ev")[i] + label[0] + label[1] + F.log(host)).alias(f"s{i}"))
    d = d.select("id", "n", "mean", "ev", *score)
    top = F.greatest(*(F.col(f"s{i}") for i in m)) if len(names) > 1 else F.col("s0")
    d = d.withColumn("top", top).withColumn("probability", F.lit(1.0) / sum_of([F.exp(F.col(f"s{i}") - F.col("top")) for i in m]))
    best = F.coalesce(*(F.when(F.col(f"s{i}") == F.col("top"), F.lit(names[i])) for i in m))
    said = F.element_at(F.array(*map(F.lit, names)), F.array_position("ev", F.array_max("ev")).cast("int"))
    known = (F.col("n") > 0) & ((F.col("n") < FIT_TRIGRAMS) | (F.col("mean") >= F.lit(model.least)))
    kept = known & (F.col("probability") >= min_posterior) & best.isin(*(wanted if wanted is not None else names))
    return d.select("id", F.when(known, best).otherwise("und").alias("lang"), "probability", F.when(F.col("n") > 0, said).otherwise("und").alias("text_lang"), kept.alias("kept"))


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", declared: str | None = "lang", host: str | None = "source", suffix: str | None = None, domain: str | None = None, model: Model | None = None, **limits) -> DataFrame:
    """(id, lang, probability, text_lang, kept).  host, suffix and domain name columns; those that are None give no evidence."""
    model = model or fit(docs, text, declared, id_col)
    of = lambda name, c: (F.col(c).cast("string") if c else F.lit(None).cast("string")).alias(name)
    d = docs.select(F.col(id_col).alias("id"), of("text", text), of("declared", declared), of("suffix", suffix), of("domain", domain), of("host", host))
    return fuse(materialize(evidence(d, model), "language-evidence"), model, **limits)


def keep(docs: DataFrame, id_col: str = "doc_id", **named) -> DataFrame:
    """docs without the rows that are rejected; a row without an id stays unless every such row is rejected."""
    found = materialize(identify(docs, id_col, **named).select("id", "kept"), "language")
    gone = found.groupBy("id").agg(F.max("kept").alias("kept")).where("NOT kept").select("id")
    return without_ids(docs, id_col, gone)


def page_text(page: str) -> str:
    """What a page says, character references decoded; elements other than those of running text end a word."""
    return html.unescape("".join(rest if tag is None else "" if tag in INLINE and tag != "br" else " " for tag, rest, _ in pieces(page)))


def page_columns(pages: DataFrame) -> DataFrame:
    """pages as rows with text (markup stripped, references decoded), declared language, host, domain and suffix."""
    arrow_batches(pages.sparkSession)
    page = F.coalesce(F.col("html"), F.lit(""))
    lang = F.lower(F.regexp_extract(page, r"""(?i)<html[^>]*\blang=["']?([A-Za-z]+)""", 1))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    empty = lambda c: F.when(c != "", c)
    d = pages.select("page_id", page.alias("text"), empty(lang).alias("declared"), empty(host).alias("host"), empty(F.substring_index(host, ".", -2)).alias("domain"), empty(F.substring_index(host, ".", -1)).alias("suffix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [page_text((x or b"").decode("utf-8", "replace")) for x in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *b.columns[2:]], names=b.schema.names)

    return d.mapInArrow(run, d.schema)


def op8_language(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def pages_language(spark, sf_dir: str) -> DataFrame:
    d = page_columns(table(spark, sf_dir, "pages"))
    return identify(d, "page_id", declared="declared", host="host", suffix="suffix", domain="domain").withColumnRenamed("id", "page_id")


QUERIES = {"op8_language": op8_language, "pages_language": pages_language}
SQL: dict[str, str] = {}
