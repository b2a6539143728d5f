"""How many rows a passage that all documents share costs, and that rows of several windows remove the same words."""

import random

from tickforge.llm import substrings


def prose(n, r):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_a_common_passage_is_few_rows_a_document(spark):
    r = random.Random(4)
    common = prose(200, r)
    texts = [common if i % 3 else f"{prose(5, r)} {common}" for i in range(120)]
    rows = []
    for i, text in enumerate(texts):
        starts = [-int(s) - 1 for _, _, _, start, _, _ in substrings.super_kmers([text.encode()], 50, 8) for s in start]
        rows.append((i, i, text, starts))
    d = spark.createDataFrame(rows, "id long, key long, text string, starts array<int>").coalesce(1)
    packed = substrings._pack(d, 50, 8).collect()
    settled = [x for x in packed if x["packed"] is None]
    assert all(x["n"] > 0 for x in settled)
    # 151 windows of each document are shared; all but the first documents' are settled.
    assert sum(x["n"] for x in settled) == 151 * 119 and len(settled) < 20 * 119
    covered = {(x["id"], s) for x in settled for s in range(x["start"], x["start"] + x["n"])}
    assert len(covered) == 151 * 119


def test_removed_windows_side_by_side_are_one_row():
    r = random.Random(5)
    words = prose(90, r).encode().split()
    a, b = b" ".join(words[:80]), b" ".join([b"x", *words[:79], b"y"])
    assert substrings.bucket_removals([(1, 7, 3, 31, a), (2, 8, 0, 32, b)], 50) == [(2, 8, 1, 30)]
    assert substrings.bucket_removals([(1, 7, 3, 31, a), (2, 8, 0, 31, a)], 50) == [(2, 8, 0, 31)]
    assert substrings.stretches([5, 3, 4, 9, 8, 1]) == [(1, 1), (3, 3), (8, 2)]
