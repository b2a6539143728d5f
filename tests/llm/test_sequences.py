"""Periodic runs, the Merkle manifest and byte-level BPE against brute force and the library that defines the ids."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickforge.llm import bpe, merkle, periodic

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs int, leaf string, ids string, path string"
PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    prose = lambda n: " ".join(r.choice("alpha beta gamma délta Epsilon zeta 12 , 漢字 eta".split()) for _ in range(n))
    texts = [None, "", " \t\n", "one", "<|endoftext|> 𝄞 x", "same " * 200, prose(40) + " " + (prose(9) + " ") * 5, prose(900)]
    rows = [(i, texts[i % len(texts)], "en" if i % 3 else None, None if i % 7 == 3 else f"s{'a' if i % 2 else i % 20}", i if i % 5 else None) for i in range(120)]
    rows += [rows[5], rows[6], (None, "Null id", "en", "sa", 1), (None, None, None, None, None), (6, "another text of id 6", "en", "sa", 1)]
    return spark.createDataFrame([(*x, 1, "a", "b", "c") for x in rows], SCHEMA)


# --- 11 periodic runs


def brute_runs(w, least=24):
    """Every period is tried at every place."""
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((a, n, q) for (a, n), q in out.items())


def sequences(count, seed):
    r = random.Random(seed)
    for _ in range(count):
        w = [r.choice("ab") if r.random() < 0.3 else r.choice("abcdefgh") for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            period = [r.choice("abc") for _ in range(r.randint(1, 70))]
            w += (period * 8)[: r.randint(1, len(period) * 6)] + [r.choice("abcdefgh") for _ in range(r.randint(0, 9))]
        yield w


def test_runs_of_one_tile_are_those_of_brute_force():
    for w in sequences(400, 1):
        ids = np.array([ord(x) for x in w], np.int32)
        t, q, a, e = periodic.inner_fragments([ids, ids[::-1].copy()], np.array([1, 1]), np.array([len(w) // 3 + 1] * 2))
        assert sorted((int(y), int(z - y + x), int(x)) for k, x, y, z in zip(t, q, a, e, strict=True) if k == 0) == brute_runs(w)
        assert sorted((int(y), int(z - y + x), int(x)) for k, x, y, z in zip(t, q, a, e, strict=True) if k == 1) == brute_runs(w[::-1])


@pytest.mark.parametrize("base", [16, 64, 4096])
def test_runs_are_stitched_over_tiles(spark, base):
    """With small tiles most runs are cut by borders, in several octaves."""
    rows = list(enumerate(sequences(60, base)))
    rows += [(100, ["x"] * 700), (101, list("ab") * 400), (102, [f"w{i % 130}" for i in range(1000)]), (103, [f"w{i % 300}" for i in range(900)]), (104, list("abcdefghijklmnopqrstuvw") * 30 + ["x"] * 23)]
    d = spark.createDataFrame([(i, " ".join(w), 1) for i, w in rows], "doc_id long, text string, runs int")
    got = {r["doc_id"]: r for r in periodic.collapse(d, base=base).collect()}
    assert len(got) == len(rows)
    for i, w in rows:
        want = brute_runs(w)
        assert [tuple(x) for x in got[i]["runs"]] == want, (i, w)
        dropped = {k for a, n, q in want for k in range(a + q, a + n)}
        assert got[i]["collapsed"] == " ".join(x for k, x in enumerate(w) if k not in dropped)


def planted(i, words):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k if k < a else a + (k - a) % p] for k in range(n)]


def test_periodic_query(spark, tmp_path, docs):
    docs.union(docs.where("text is not null").withColumn("doc_id", F.col("doc_id") + 1000)).write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    want = []
    for r in d:
        w = (r["text"] or "").encode().split()
        w = planted(r["doc_id"], w) if r["doc_id"] is not None else w
        found = brute_runs(w)
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        dropped = {k for a, n, q in found for k in range(a + q, a + n)}
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
        kept = b" ".join(x for k, x in enumerate(w) if k not in dropped)
        milli = 1000 * best[1] // best[2] if best[2] else None
        want.append((r["doc_id"], len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in periodic.op11_periodic(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(x[1] for x in want) > 20
    assert periodic.collapse(docs.limit(0)).count() == 0
    c = periodic.collapse(docs, prefix="per_")
    assert c.columns == [*docs.columns, "per_runs", "per_collapsed"] and c.count() == docs.count()


# --- 12 Merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grown(nodes):
    """All levels, the nodes first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        at = i // 16 * 16
        yield level[at:i], level[i + 1 : at + 16]
        i //= 16


def brute_manifest(rows):
    leaf = lambda r, text: digest(*(field(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))) for s in names}
    levels = {s: grown([leaf(r, r["text"]) for r in trees[s]]) for s in names}
    top = grown([levels[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(trees[s]):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = "".join(x.lower() if x.isascii() else x for x in text)
            sides = [*path(levels[s], i), *path(top, k)]
            fold = leaf(r, text)
            for a, b in sides:
                fold = digest(*a, fold, *b)
            out.append((r["doc_id"], levels[s][0][i], levels[s][-1][0], top[-1][0], digest(*(x for a, b in sides for x in (*a, *b))), fold, fold == top[-1][0]))
    return out


def test_merkle_query(spark, tmp_path, docs):
    r = random.Random(3)
    many = [(i, f"Text {r.random()}", "de", f"{'S' if i % 3 else 's'}{r.choice(['', 'é', 'Z', i % 40])}" if i % 2 else "hot", 5) for i in range(200, 900)]
    docs.union(spark.createDataFrame([(*x, 1, "a", "b", "c") for x in many], SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in merkle.op12_merkle(spark, str(tmp_path)).collect()]
    want = brute_manifest(d.collect())
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {x[-1] for x in got} == {True, False}


def test_merkle_small_trees(spark, docs, tmp_path):
    for name, rows in (("none", docs.limit(0)), ("one", docs.where("doc_id = 4")), ("lone", docs.where("doc_id in (1, 3, 4)")), ("seventeen", docs.where("doc_id % 2 = 1 and doc_id < 40"))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = [tuple(x) for x in merkle.op12_merkle(spark, f"{tmp_path}/{name}").collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute_manifest(rows.collect())))


def test_proofs_of_some_leaves(spark, docs):
    order, sources = merkle.ranked(merkle.leaves(docs))
    order = order.cache()
    m = merkle.build(order, sources)
    p = merkle.prove(order.where("rank % 3 = 1"), m).collect()
    assert len(p) == order.where("rank % 3 = 1").count() and all(x["digest"] == x["leaf"] for x in p)
    # A record is found by what it is made of.
    assert all(x["digest"] == digest(*x["children"]) for x in m.store.collect())
    order.unpersist()


# --- 13 byte-level BPE


@pytest.fixture(scope="module")
def both():
    raw = bpe.read_ranks(PATH)
    own = bpe.codec(raw, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids(own, text):
    return np.frombuffer(own.encode(text), "<i4").tolist()


def test_ids_are_those_of_the_library(both):
    own, library = both
    r = random.Random(5)
    for alphabet in ("ab", "aAbB 1", "étñ 漢字 a", "\n\t  x", "hello world the ing ", "'s've  ", "<|endoftext|>", "\x00\x1c\x85   a"):
        for _ in range(150):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 150)))
            assert ids(own, text) == library.encode_ordinary(text), text


def test_ids_around_every_block_of_code_points(both):
    own, library = both
    for c in [*range(0, 0x3100), *range(0x3100, 0x110000, 97)]:
        if not 0xD800 <= c <= 0xDFFF:
            text = f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)} !{chr(c)}"
            assert ids(own, text) == library.encode_ordinary(text), hex(c)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_round_trip(both, text):
    own, library = both
    got = ids(own, text)
    assert got == library.encode_ordinary(text)
    assert own.decode(got) == text.encode() and "".join(own.text_stream(got)) == text


def test_long_pieces_and_forgotten_states(monkeypatch):
    """A piece of many bytes takes linear time and sends tokens early; few states and pieces are kept, and results don't change."""
    raw = bpe.read_ranks(PATH)
    own = bpe.Codec(bpe.codec(raw, public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_PIECES", 20)
    r = random.Random(2)
    text = "ab" * 3000 + "a" * 5000 + "".join(r.choice("abcdefghijklmno") for _ in range(20_000)) + " " + " ".join("".join(r.choice("xyzé") for _ in range(6)) for _ in range(3000))
    assert ids(own, text) == library.encode_ordinary(text) and own.transducer.restarts > 10 and len(own.kept) <= 20
    monkeypatch.undo()
    assert len(ids(own, "a" * 2_000_000)) == 250_000 if len(library.encode_ordinary("a" * 64)) == 8 else True


def test_neighbours_by_taking_merges_back(both):
    """`follows` against merging both tokens, for a small vocabulary of every kind of order and for the large one."""
    r = random.Random(9)
    words = {bytes([c]): i for i, c in enumerate(b"abc")}
    while len(words) < 60:
        words.setdefault(bytes(r.choice(b"abc") for _ in range(r.randint(2, 6))), len(words))
    for t in (bpe.Transducer(words), both[0].transducer):
        some = r.sample(sorted(t.tokens), min(60, len(t.tokens)))
        for a in some:
            if bpe.merged(t.tokens[a], t.ranks) != [t.tokens[a]]:
                continue
            for b in some:
                assert t.follows(a, b) == (bpe.merged(t.tokens[a] + t.tokens[b], t.ranks) == [t.tokens[a], t.tokens[b]])
    library = tiktoken.Encoding("small", pat_str=r"[abc]+", mergeable_ranks={**words, **{bytes([c]): 1000 + c for c in range(256) if c not in b"abc"}}, special_tokens={})
    own = bpe.Codec(library._mergeable_ranks, r"[abc]+")
    for _ in range(300):
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 40)))
        assert ids(own, text) == library.encode_ordinary(text)


def test_utf8_machine_is_the_decoder():
    r = random.Random(1)
    for _ in range(3000):
        raw = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xC0, 0xED, 0xA0, 0xF4, 0x90, 0xFF, 0xE0, 0x9F]) for _ in range(r.randint(0, 12)))
        state, out, at = b"", "", 0
        while at < len(raw):
            n = r.randint(1, 4)
            state, text = bpe.feed(state, raw[at : at + n])
            out, at = out + text, at + n
        assert out + ("�" if state else "") == raw.decode(errors="replace")


def test_bpe_query(spark, tmp_path, docs, both):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in bpe.op13_bpe(spark, str(tmp_path)).collect()]
    want = []
    for x in docs.collect():
        t = x["text"] or ""
        i = both[1].encode_ordinary(t)
        want.append((x["doc_id"], len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(str, got)) == sorted(map(str, want))
    e = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert sorted(e.columns) == sorted(docs.columns) and bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    texts = bpe.decode_text(e, PATH, public_tokenizers.PATTERN, out_col="path").select("text", "path").collect()
    assert all(x["path"] == (x["text"] or "") for x in texts)
    odd = spark.createDataFrame([(None,), ([],), ([0, 50256],)], "ids array<int>")
    assert [bytes(x["decoded"]) for x in bpe.decode(odd.limit(2), PATH, public_tokenizers.PATTERN).collect()] == [b"", b""]
    with pytest.raises(Exception, match="no token has the id"):
        bpe.decode(odd, PATH, public_tokenizers.PATTERN).collect()


def test_vocabulary_file(tmp_path, monkeypatch):
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + f" {i}".encode() for i in range(256)))
    assert len(bpe.codec(bpe.read_ranks(str(path)), r"\S+").ranks) == 256
    monkeypatch.setattr(bpe, "FILE_BYTES", 10)
    with pytest.raises(ValueError, match="larger"):
        bpe.read_ranks(str(path))
