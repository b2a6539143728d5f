"""The window set's memory, windows of equal hashes, columns that clash, and blocks against one set."""

import random

from tickforge.llm import decontaminate as dc

R = random.Random(3)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 9))) for _ in range(5000)]
prose = lambda n: " ".join(R.choice(VOCAB) for _ in range(n))


def test_memory_of_the_set():
    items = [(str(i), prose(80).encode()) for i in range(2000)]
    g = dc.Grams(items, 10)
    assert g.nbytes < 8 * sum(len(t) for _, t in items)  # SET_BYTES of texts: about a quarter of a gigabyte


def test_windows_that_share_a_hash_only(monkeypatch):
    monkeypatch.setattr(dc, "window_hashes", lambda h, k: h[: max(0, len(h) - k + 1)] * 0)
    g = dc.Grams([("a", b"one two three"), ("b", b"four five six"), ("c", b"four five six"), ("d", b"one two three")], 10)
    _, hits, items = g.scan([b"x one two three y", b"four five six", b"seven eight nine"])
    assert hits == [[(1, 4)], [(0, 3)], []] and items == [{"a", "d"}, {"b", "c"}, set()]


def test_clashing_columns_and_blocks(spark):
    items = [(i, prose(R.choice((3, 10, 25)))) for i in range(30)] + [(30, None), (31, "")]
    rows = [(i, prose(20) + " " + (items[i % 30][1] + " " + items[(i * 7) % 30][1]).upper() + ", " + prose(10) if i % 2 else prose(40), "w", 5, f"k{i}") for i in range(60)]
    rows += [(60, None, "w", 5, "k"), (61, "", None, None, None), (1, *rows[1][1:])]
    d = spark.createDataFrame(rows, "doc_id long, text string, hits string, n_words int, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted((str(r["doc_id"]), r["_dec_n_words"], tuple(map(tuple, r["_dec_hits"])), tuple(r["_dec_items"]), r["hits"], r["n_words"], r["items"]) for r in df.collect() if r["hits"])
    one, many = (dc.decontaminate(d, b, set_bytes=n, prefix="_dec_") for n in (1 << 20, 400))
    assert one.columns == many.columns == [*d.columns, "_dec_n_words", "_dec_hits", "_dec_items"]
    assert key(one) == key(many) and sum(bool(x[2]) for x in key(one)) > 25
    left = dc.remove_documents(one, prefix="_dec_")
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in one.collect() if not r["_dec_hits"]}
