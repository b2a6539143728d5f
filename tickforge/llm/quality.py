"""Quality rules (native): cross-document line frequency beside per-document base rules.

Lines are normalised (trimmed, lower case, runs of white space to one space, digits to 0) and
hashed; the distinct documents of a line are counted per host, rows of equal text being one document.  A line in more than
`max_docs` documents of its host is boilerplate, whatever the host's size, and is removed; a
document that keeps less than `min_left` of its words is depleted and is rejected.  `cleaned` gives the texts without those lines.

Texts are read once: the base figures of a row and the hashes of its lines are written, and all that follows reads these.

Defined cases
* null text: no words, so base_failed; a null host is a host of its own, a null id an id.
* Repeated rows: equal rows get equal results, and count as one document of the host, as do other rows of equal text.
* Very long texts: whole; a task holds the words of a row and the hashes of its windows, not the windows.
  Windows of equal 64-bit hash are compared word by word with their neighbour in the order of hashes.
* A document without words fails the base rules.  An empty table gives an empty table; extra
  columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, SPACE, SPACES, let, materialize, table, words_of

WINDOW = 8
MAX_DOCS = 20
MIN_LEFT = 0.5


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of `window` words which the text has twice or more."""
    # Each word is hashed once, and a window from its words' hashes.
    each = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(window))))
    hashed = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), each)

    def covered(w: Column, by_hash: Column) -> Column:
        n = F.size(by_hash)

        def same(x: Column, j: Column) -> Column:
            other = F.get(by_hash, j)
            return F.when((j >= 0) & (j < n), (other["h"] == x["h"]) & (F.slice(w, other["i"], window) == F.slice(w, x["i"], window))).otherwise(F.lit(False))

        twice = F.filter(by_hash, lambda x, j: same(x, j - 1) | same(x, j + 1))
        starts_at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        # Each window adds what the one before it doesn't cover.
        begin = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"))
        return F.aggregate(starts_at, begin, step)["n"]

    def counted(w: Column, h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, j: F.struct(x.alias("h"), (j + 1).alias("i"))))
        # Most texts have no hash twice.
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, lambda p: covered(w, p))).otherwise(F.lit(0))

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(words, lambda w: let(hashed(w), lambda h: counted(w, h)))).cast("long")


def normal(line: Column) -> Column:
    """What two lines that count as one have in common."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line, F.lit(SPACE))), SPACES, " "), "[0-9]", "0")


def line_hashes(text: Column) -> Column:
    """Of each line with a word, in order: the hash of its normal form and its number of words."""
    lines = F.filter(F.transform(F.split(text, "\n"), normal), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).cast("long").alias("n")))


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    d = d.withColumn("words", words_of(F.col("text")))
    worded = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    d = d.select(
        "doc_id",
        "host",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(worded, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def sized(df: DataFrame) -> DataFrame:
    """A written frame, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def frequent_lines(base: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(f_host, f_line) of the lines above the limit, from (host, text_key, lines).

    Rows are first made distinct, which spreads even the commonest line over all tasks, and then counted with partial sums.
    """
    once = base.select("host", "text_key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).distinct()
    per_line = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs)
    return per_line.select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """Per document the base figures, lost_words, and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_rules(docs, id_col, text_col, host_col).withColumns({"text_key": F.xxhash64("text"), "lines": line_hashes(text)}).drop("text")
    base = materialize(base.withColumn("_row", F.monotonically_increasing_id()), "quality-base")
    frequent = materialize(frequent_lines(base, max_docs), "frequent-lines")
    lines = base.select("_row", "host", F.explode("lines").alias("x")).select("_row", "host", "x.*")
    hit = lines.join(sized(frequent), F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")))
    lost = materialize(hit.groupBy(F.col("_row").alias("_lost")).agg(F.sum("n").alias("lost")), "lost-words")
    out = base.join(sized(lost), F.col("_row") == F.col("_lost"), "left").withColumn("lost_words", F.coalesce("lost", F.lit(0)))
    kept = ~F.col("base_failed") & (F.col("lost_words") <= (1 - min_left) * F.col("n_words"))
    return out.withColumn("kept", kept).drop("_row", "_lost", "lost", "lines")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """docs with the frequent lines of their host cut from the text; line ends of the lines that stay are kept as they are.

    Only the hashes of lines are shuffled; which lines a row loses is joined back by id, host and text, broadcast if few rows lose any.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_cid"), F.col(host_col).alias("host"), F.xxhash64(text_col).alias("text_key"), line_hashes(text).alias("lines"))
    rows = materialize(rows.dropDuplicates(["_cid", "host", "text_key"]), "quality-lines")
    frequent = materialize(frequent_lines(rows, max_docs), "frequent-lines")
    lines = rows.select("_cid", "host", "text_key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    hit = lines.join(sized(frequent), F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")))
    gone = hit.groupBy(F.col("_cid"), F.col("host").alias("_chost"), F.col("text_key").alias("_ckey")).agg(F.collect_set("line").alias("_gone"))
    gone = sized(materialize(gone, "quality-gone"))
    d = docs.withColumn("_key", F.xxhash64(docs[text_col]))
    d = d.join(gone, docs[id_col].eqNullSafe(F.col("_cid")) & docs[host_col].eqNullSafe(F.col("_chost")) & (F.col("_key") == F.col("_ckey")), "left")
    stays = lambda x: (normal(x) == "") | ~F.array_contains("_gone", F.xxhash64(normal(x)))
    kept = F.array_join(F.filter(F.split(docs[text_col], "\n"), stays), "\n")
    return d.select(*(F.when(F.col("_gone").isNull(), docs[c]).otherwise(kept).alias(c) if c == text_col else docs[c] for c in docs.columns))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, source, trim(x, e' \t\n\x0b\x0c\r') AS x, l.x AS raw FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM d) l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM ln GROUP BY doc_id),
nrm AS (SELECT doc_id, source, regexp_replace(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g') AS x FROM ln),
fr AS (SELECT nrm.source, nrm.x FROM nrm JOIN d USING (doc_id) GROUP BY nrm.source, nrm.x HAVING count(DISTINCT d.text) > 20),
lost AS (SELECT doc_id, sum(len(nrm.x) - len(replace(nrm.x, ' ', '')) + 1) AS n FROM nrm JOIN fr ON nrm.source IS NOT DISTINCT FROM fr.source AND nrm.x = fr.x GROUP BY doc_id),
a AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost.n, 0) AS lost
      FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed) AND lost <= 0.5 * n_words AS kept, CAST(lost AS BIGINT) AS lost_words FROM b
"""

QUERIES = {"op10_quality": op10_quality}
SQL = {"op10_quality": OP10_SQL}
