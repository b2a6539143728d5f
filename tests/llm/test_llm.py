"""The training-data operators against brute force, round trips and held-out rows, with the odd inputs that each defines."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickforge.llm import chat, decontaminate, extract, language, mixing, pii, quality, registry, simhash, substrings, warc
from tickforge.llm.blocks import blocks
from tickforge.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, fp string, words string"
R = random.Random(4)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 6))) for _ in range(300)]


def prose(n, r=R):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def odd_docs():
    """Nulls, empties, white space, copies, repeated rows, a long text, clashing columns."""
    shared = prose(80)
    texts = [None, "", " \t\n", "one", "two words", shared + " " + prose(30), prose(30) + "\n" + shared, shared, prose(40) + " mail a.b@c.de call +1 (988) 555-2485 ip 10.0.0.1 card 4111111111111111", " ".join(["same"] * 120), prose(9000)]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", None, i, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[5], rows[7], (None, shared, "en", "s0", None, 1, "x", "y", "z"), (99, shared, "en", "s1", None, 1, "x", "y", "z")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def save(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- 3 mixing


def test_targets_fill_and_sum(spark):
    d = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 500), ("d", 70)], "source string, source_size long")
    got = {r["source"]: r for r in mixing.source_targets(d).collect()}
    assert abs(sum(r["target"] for r in got.values()) - 1580) < 1e-6 and all(r["target"] <= 3 * r["source_size"] for r in got.values())
    assert got["a"]["target"] == 30 and got["c"]["target"] == 0  # weights a 1, b 2, c 3, d 1, null 2
    assert abs(got["b"]["target"] - 2 * (1580 - 30 - 210) / 4) < 1e-6 or got["d"]["target"] < 210


def test_mixing_odd_rows(docs, none):
    m = mixing.mix(docs).collect()
    assert len(m) == docs.count() and all(r["_mix_copies"] * r["_mix_size"] <= 3 * r["_mix_size"] for r in m)
    assert all(r["_mix_size"] == len(WORD.findall(r["text"] or "")) for r in m)
    assert sorted(map(str, m)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0 and mixing.emit(mixing.mix(docs)).columns == [*docs.columns, "copy_no"]


# --- 10 quality


def repeat_words(words):
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    return len({p for x in seen.values() if len(x) > 1 for i in x for p in range(i, i + 8)})


def test_frequent_lines_are_cut_from_texts(spark, none):
    """Boilerplate of a host goes from its texts in every spelling, and from no other host's; all else stays to the letter."""
    menu = ["Home | News 2024", "  HOME |  news 1999 "]
    rows = [(i, f"{menu[i % 2]}\n\nstory {i} of its own\t x\nHome", "a") for i in range(30)] + [(100 + i, f"{menu[0]}\nother {i}", "b") for i in range(5)] + [(200, None, "a"), (201, "", None), (0, f"{menu[0]}\n\nstory 0 of its own\t x\nHome", "a"), (None, menu[0], "a")]
    d = spark.createDataFrame([(i, t, h, 1) for i, t, h in rows], "doc_id long, text string, source string, host int")
    # Digits count as 0, so the stories of two-digit numbers are one line in 20 documents: under the limit.
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in quality.cleaned(d, max_docs=25).collect())
    want = sorted((i if i is not None else -1, t if h != "a" or t is None else "\n".join(x for x in t.split("\n") if "|" not in x and x != "Home")) for i, t, h in rows)
    assert [x for x in got if x[1] is not None] == [x for x in want if x[1] is not None] and len(got) == len(want)
    assert quality.cleaned(none).count() == 0 and quality.cleaned(none).columns == none.columns


def test_quality_base_rules(spark, docs, none):
    more = spark.createDataFrame([(200 + i, " ".join(R.choice(VOCAB[:3]) for _ in range(R.randint(5, 90))) + "\n#a\n#a\n  \n", "en", "s", None, 1, "", "", "") for i in range(30)], SCHEMA)
    for r in quality.base_rules(docs.union(more)).collect():
        w = WORD.findall(r["text"] or "")
        lines = [x for x in (r["text"] or "").split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), repeat_words(w), len(lines) - len(set(lines)))
    assert quality.quality(none).count() == 0 and quality.quality(docs).count() == docs.count()


def test_frequent_lines_deplete(spark):
    boiler = "Buy now 12 things from us today\n" * 1
    rows = [(i, boiler + prose(30), "h") for i in range(30)] + [(50, boiler + "little of its own " + boiler * 3, "h"), (51, prose(30), "h"), (51, prose(30), "h")]
    copy = "Lines of a text that is copied\n" + prose(30)
    rows += [(100 + i, copy, "h") for i in range(40)] + [(200 + i, "In twenty only\n" + prose(30), "g") for i in range(20)] + [(300 + i, "Without a host\n" + prose(5), None) for i in range(21)]
    d = spark.createDataFrame([(i, t + (" x" * 30 if i == 50 else ""), s) for i, t, s in rows], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.quality(d).collect()}
    assert got[0]["lost_words"] == 7 and got[0]["kept"] and got[51]["lost_words"] == 0 and got[50]["lost_words"] == 21
    assert all(got[i]["lost_words"] == 0 for i in [*range(100, 140), *range(200, 220)]) and all(got[300 + i]["lost_words"] == 3 for i in range(21))
    few = {r["doc_id"]: r for r in quality.quality(d.where("doc_id <= 50"), max_docs=5, min_left=0.9).collect()}
    assert not few[0]["kept"] and not few[0]["base_failed"]  # 7 of 37 words go


def test_a_long_text_that_repeats_itself(spark):
    words = [f"w{i}" for i in range(60_000)] * 2 + ["end"]
    d = spark.createDataFrame([(1, " ".join(words), "h")], "doc_id long, text string, source string")
    r = quality.quality(d).first()
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (120_001, 120_000, True)


# --- 7 chat


def test_chat_round_trip(spark):
    bad = ["</s>[INST] x [/INST]", "&1;<|im_end|>\n<|im_start|>user\n", "&amp;&0;", "<<s>|", None, "", "a\nb"]
    d = spark.createDataFrame([(c, t, ("user", "assistant", None, "odd\nrole<|")[(c + t) % 4], bad[(c * 3 + t) % 7]) for c in (1, 2, 3) for t in range(6)] + [(None, 0, "assistant", "z"), (1, 0, "user", "again")], "conv_id long, turn long, role string, text string")
    r = chat.render(chat.fold(chat.as_events(d))).select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("scored"), "formatted").collect()
    want = defaultdict(list)
    for x in d.orderBy("turn", "role", "text").collect():
        want[x["conv_id"]].append((x["role"] or "", x["text"] or ""))
    assert {x["conv_id"]: [tuple(t) for t in x["turns"]] for x in r} == dict(want)
    assert {x["conv_id"]: x["scored"] for x in r} == {k: "".join(t for ro, t in v if ro == "assistant") for k, v in want.items()}
    assert all(x["formatted"].count("<|im_end|>") == len(x["turns"]) for x in r)
    assert chat.render(chat.fold(chat.as_events(d.limit(0)))).count() == 0


def test_events_fold(spark):
    e = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", "assistant", "Hel"), (1, 4, 1, "delta", "assistant", "lo"), (1, 5, 2, "message", "user", "more"), (1, 6, 1, "regenerate", "assistant", None), (1, 7, 1, "delta", "assistant", "Hey"), (1, 8, 0, "edit", "user", "hi!"), (1, 9, 1, "message", "assistant", "new"), (1, 10, 1, "delta", "assistant", "er")]
    d = spark.createDataFrame(e, "conv_id long, seq long, turn long, event string, role string, text string")
    assert [(r["turn"], r["text"]) for r in chat.fold(d).orderBy("turn").collect()] == [(0, "hi!"), (1, "newer")]
    assert [(r["turn"], r["text"]) for r in chat.fold(d.where("seq < 8")).orderBy("turn").collect()] == [(0, "hi"), (1, "Hey")]


# --- 9 decontamination


def test_decontamination_odd_rows_and_blocks(spark, docs, none):
    item = docs.where("doc_id = 5").first()["text"].split()
    b = spark.createDataFrame([(1, " ".join(item[20:35])), (2, "TWO, words!"), (3, None), (4, ""), (None, "one"), (5, " ".join(item[20:35]))], "item_id long, text string")
    one = {str(r["doc_id"]) + str(r["hits"]): r for r in decontaminate.decontaminate(docs, b).collect()}
    many = {str(r["doc_id"]) + str(r["hits"]): r for r in decontaminate.decontaminate(docs, b, set_bytes=20).collect()}
    assert one == many
    by = {r["doc_id"]: r for r in one.values()}
    assert set(by[5]["items"]) >= {"1", "5"} and by[4]["items"] == ["2"] and by[3]["items"] == ["null"] and by[0]["items"] == []
    assert [tuple(h) for h in by[5]["hits"]] == [(20, 35)] or any(h["start"] <= 20 and h["end"] >= 35 for h in by[5]["hits"])
    assert decontaminate.decontaminate(none, b).count() == 0 and all(not r["hits"] for r in decontaminate.decontaminate(docs, b.limit(0)).collect())


# --- 2 PII


def test_base_patterns_are_as_written():
    email, ip, card, phone = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    digits = lambda s: re.sub("[^0-9]", "", s)
    r = random.Random(9)
    for k in range(20_000):
        t = "".join(r.choice("aé@@..-+ 0123456789()") for _ in range(r.randint(0, 40)))
        want = [(*m.span(), "email") for m in email.finditer(t)] + [(*m.span(), "ip") for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(*m.span(), "card") for m in card.finditer(t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))] + [(*m.span(), "phone") for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        assert sorted(pii.base_spans(t)) == sorted(want), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.fixture(scope="module")
def detector():
    return pii.Detector()


def test_detector_on_held_out_candidates(detector):
    x, y, kinds = pii.Training(12345).rows(1500)
    said = detector.trees.probability(x) >= np.array([detector.least[k] for k in kinds])
    assert y[said].mean() > 0.95 and said[y == 1].mean() > 0.85


def test_pii_odd_rows(docs, none, detector):
    got = {r["doc_id"]: r for r in pii.find_pii(docs, detector=detector).collect()}
    assert [s["kind"] for s in got[8]["spans"]] == ["email", "phone", "ip", "card"] and got[0]["spans"] == []
    red = {r["doc_id"]: r for r in pii.redact(docs, detector=detector).collect()}
    assert red[0]["text"] is None and red[8]["text"].endswith("mail [EMAIL] call [PHONE] ip [IP] card [CARD]") and red[10]["text"] == got[10]["text"]
    assert pii.find_pii(none, detector=detector).count() == 0
    assert pii.redacted("abcdef", [(1, 4, "x"), (2, 5, "y")]) == "a[X]f"


# --- 4 SimHash


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, links):
    of = {v: v for v in values}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        of[b] = a
    return {v: find(v) for v in values}


def test_fingerprints_and_components(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == docs.count() and all(r["fp"] & (2**64 - 1) == fingerprint(text[r["doc_id"]]) for r in got)
    ids = [i for i in text if i is not None]
    want = roots(ids, [(a, b) for a in ids for b in ids if (fingerprint(text[a]) ^ fingerprint(text[b])).bit_count() <= 3])
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert simhash.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(want.values())) and None in kept


def test_links_in_split_shards_keep_every_component(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for _ in range(600):  # chains and a dense group
        fps.add((r.choice(sorted(fps)) if r.random() < 0.3 else base[0]) ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
    fps = sorted(fps)
    want = roots(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3])
    d = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
    for shard, n in ((16, 600), (4096, 600), (4096, 1 << 26), (8, 1 << 34), (4096, 1 << 44)):
        c = components(simhash.links(d, shard=shard, dealt_as=simhash.choices(n)))
        sign = {x["node"] & (2**64 - 1): x["root"] & (2**64 - 1) for x in c.collect()}
        groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
        assert groups({x: sign.get(x, x) for x in fps}) == groups(want)


def similar(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("shard", [8, 2048])
def test_near_copies_by_similarity(spark, docs, none, shard):
    r, rows = random.Random(12), []
    for g in range(30):  # a text, copies with few words changed, and relatives that share half
        w = prose(200, r).split()
        rows.append((1000 + 10 * g, " ".join(w)))
        for k in range(1, 6):
            v = list(w)
            for p in r.sample(range(200), 2):
                v[p] = "changed"
            rows.append((1000 + 10 * g + k, " ".join(v)))
        rows += [(1000 + 10 * g + 7, " ".join(w[:120]) + " " + prose(80, r)), (1000 + 10 * g + 8, " ".join(w) + "\n")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(d, shard=shard).collect()}
    text = dict(rows)
    want = roots(list(text), [(a, b) for a in text for b in text if b < a < b + 10 and similar(text[a], text[b]) >= 0.8])
    assert len(got) == len(rows) and sum(got[i] == want[i] for i in got) >= 0.98 * len(got)
    assert all(got[i] == i for i in got if i % 10 == 7) and all(got[i] == i - 8 for i in got if i % 10 == 8)
    odd = simhash.near_copies(docs, shard=shard).collect()
    by = {x["doc_id"]: x["component_id"] for x in odd}
    assert len(odd) == docs.count() and by[0] == by[1] == by[2] == 0 and by[7] == by[99] == by[None] == 7 and by[3] == 3 and by[5] == 5
    assert simhash.near_copies(none).count() == 0
    kept = sorted(x["doc_id"] for x in simhash.keep_one(docs, shingle=5, similarity=0.8).collect() if x["doc_id"] is not None)
    assert kept == sorted({v for k, v in by.items() if k is not None})


@pytest.mark.parametrize("piece", [8, 1024])
def test_near_copies_are_settled_exactly(spark, piece):
    """Pairs at and around the bar, short and long: (shingles, words cut from the front, words put at the end)."""
    r, rows = random.Random(21), []
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    for n, cut, more in ((4, 0, 1), (5, 0, 1), (6, 0, 1), (12, 0, 3), (20, 0, 5), (24, 0, 5), (8, 1, 1), (6, 1, 1), (150, 15, 20), (150, 16, 20), (200, 22, 22), (200, 23, 23)):
        for _ in range(12):
            w = [word() for _ in range(n + 4)]
            rows += [(10 * len(rows), " ".join(w)), (10 * len(rows) + 5, " ".join(w[cut:] + [word() for _ in range(more)]))]
    w = [word() for _ in range(100)]  # a chain of 30 near copies over several pieces
    rows += [(9_000_000 + k, " ".join(w[2 * k :] + [f"x{i}" for i in range(2 * k)])) for k in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(d, piece=piece).collect()}
    text = dict(rows)
    ids = list(text)
    want = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[max(0, i - 30) : i] if similar(text[a], text[b]) >= 0.8])
    assert 100 < sum(want[i] != i for i in ids) < len(ids) - 100
    assert {i: want[i] for i in ids if want[i] != got[i]} == {}


def test_bk_trees_of_groups():
    r = np.random.default_rng(3)
    v, g = r.integers(0, 2**12, 300, dtype=np.uint64), np.sort(r.integers(0, 9, 300))
    found = list(simhash.BKTree(v, g).found(v, 2, np.searchsorted(g, g), 50))
    assert {(i, j) for q, t in found for i, j in zip(q.tolist(), t.tolist(), strict=True)} == {(i, j) for i in range(300) for j in range(300) if g[i] == g[j] and int(v[i] ^ v[j]).bit_count() <= 2}


def test_bk_tree_finds_all():
    r = np.random.default_rng(1)
    v = np.unique(r.integers(0, 2**20, 500, dtype=np.uint64))
    q, t = simhash.BKTree(v).search(v, 3)
    assert set(zip(q.tolist(), t.tolist(), strict=True)) == {(i, j) for i in range(len(v)) for j in range(len(v)) if int(v[i] ^ v[j]).bit_count() <= 3}


# --- 6 substrings


def removals(rows):
    first = {}
    for i, w in rows:
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in rows:
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        out[i, tuple(w)] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1, 4096])
def test_substrings_against_brute_force(spark, docs, none, hot):
    r = random.Random(8)
    common = prose(70, r)
    rows = [(300 + i, (prose(r.randint(0, 60), r) + " " + (common if i % 2 else "a b " * 40) + " " + prose(r.randint(0, 60), r)).strip()) for i in range(24)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    all_rows = [(x["doc_id"], WORD.findall(x["text"] or "")) for x in d.collect()]
    want = removals([x for x in all_rows if x[0] is not None])
    got = substrings.remove_repeats(d, hot=hot).collect()
    assert len(got) == len(all_rows)
    assert Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got if x["doc_id"] is not None) == Counter((i, *want[i, tuple(w)]) for i, w in all_rows if i is not None)
    assert all(x["n_removed"] == 0 for x in got if x["doc_id"] is None)
    assert substrings.remove_repeats(none).count() == 0


# --- 5 WARC


def test_warc_round_trip_with_chunks(spark, tmp_path, monkeypatch):
    big = "é<WARC/1.1\r\n\r\n>" * 4000
    rows = [(1, "http://a\r\nb", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (None, "u", "y" * 200), (7, "u", "y" * 200), (7, "u", "y" * 200), (8, "u", "y" * 200)]
    p = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = f"{tmp_path}/w"
    warc.write_archives(warc.assign(p), path, chunk=1000, per_file=7)
    got = warc.read_records(spark, path).collect()
    key = lambda i, h, t, ref: (i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), t, ref)
    want = [key(i, h, "revisit" if ref is not None else "response", ref) for (i, _, h), ref in zip(rows, [None, 1, None, None, None, None, 7, None, None, 7], strict=True)]
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == Counter(want)
    warc.write_archives(warc.assign(p.limit(0)), f"{tmp_path}/e")
    assert warc.read_records(spark, f"{tmp_path}/e").count() == 0


# --- 8 language


def test_language_fuses_evidence(spark, none):
    r = random.Random(3)
    words = {"xx": "lorem amet dolor sit ipsum tempor labore".split(), "yy": "quick brown jumps over lazy the with".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k, f"h{k}{i % 3}") for i in range(120) for k in ("xx", "yy")]
    rows = [(2 * i, t, k, h) for i, (_, t, k, h) in enumerate(rows)]
    rows += [(1001, "am th", "yy", "hyy1"), (1003, None, "xx", "hxx1"), (1005, "12 34", None, None), (1007, "lorem amet dolor sit ipsum tempor labore amet", None, None), (1007, "lorem amet dolor sit ipsum tempor labore amet", None, None)]
    d = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, lang string, source string, n int, ev int")
    got = {x["id"]: x for x in language.identify(d).collect()}
    assert all(got[i]["lang"] == k and got[i]["kept"] for i, _, k, _ in rows[:240])
    assert got[1001]["lang"] == "yy" and got[1007]["lang"] == "xx" and got[1003]["lang"] == "und" and not got[1005]["kept"]
    assert sorted(x["doc_id"] for x in language.keep(d).collect() if x["doc_id"] > 1000) == [1001, 1007, 1007]
    assert language.identify(none).count() == 0


def test_page_columns(spark):
    d = spark.createDataFrame([(1, "https://u@Blog.Ex.example.org:80/x?y", "<HTML lang='fr-CA'><script>var x='<b>';</script><p>Bon&eacute; jour</p>"), (2, None, None)], "page_id long, url string, html string")
    a, b = language.page_columns(d).orderBy("page_id").collect()
    assert (a["declared"], a["host"], a["domain"], a["suffix"]) == ("fr", "blog.ex.example.org", "example.org", "org") and "var" not in a["text"] and b["host"] is None and b["text"] == ""


# --- 1 extraction


@pytest.fixture(scope="module")
def labeller():
    return extract.default_labeller()


def test_labeller_on_held_out_pages(labeller):
    made = [blocks(extract.Layout(55_000_000 + i).page()) for i in range(200)]
    p, y = np.concatenate(labeller.label(made)), np.array([extract.MARK in b.text for bs in made for b in bs])
    assert ((p >= 0.5) == y).mean() > 0.95


def test_blocks_of_broken_markup():
    got = [b.text for b in blocks("a<p>b &lt;i&amp;<b>c</b>\n d<p>e<!-- x --><script>z</p></script>f<li>g<li>h</p>< i</div>")]
    assert got == ["a", "b <i&c d", "ef", "g", "h", "< i"]
    assert blocks("") == [] and blocks("<p> \n </p>") == [] and blocks("<script>x")== []


def test_extraction_odd_pages(spark, labeller):
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy things now.</div><article><h1>Title of it</h1><p>First  words\nof the text.</p><p>Second part &amp; more of it.</p></article><footer>&copy; us</footer></body></html>"
    long = page.replace("<p>First", "<p>Filler words of a long page.</p>" * 1500 + "<p>First")
    d = spark.createDataFrame([(1, page, "k"), (2, None, "k"), (3, "", "k"), (4, long, "k"), (1, page, "k")], "page_id long, html string, main_text string")
    got = [(r["page_id"], r["main_text"]) for r in extract.extract(d, labeller=labeller).collect()]
    assert got.count((1, "Title of it\n\nFirst words of the text.\n\nSecond part & more of it.")) == 2 and (2, "") in got and (3, "") in got
    assert dict(got)[4].count("Filler words") == 1500
    assert extract.extract(d.limit(0), labeller=labeller).count() == 0


# --- the pipeline


def changed(text, places):
    w = text.split()
    for p in places:
        w[p] = f"changed{p}"
    return " ".join(w)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage's rows, and the number of each document's copies, worked out one by one."""
    import corpus_pipeline

    r = random.Random(6)
    base = [" ".join(r.choice(VOCAB) for _ in range(r.randint(60, 90))) for _ in range(60)]
    bench = base[10].split()[:14]
    base[11] = base[11] + " " + " ".join(bench)
    base[12] += " reach me at joe@mail.example.com"
    base[13] = base[14]  # a copy
    base[15] = "12 34 56"
    for i, j, places in ((20, 21, [40]), (22, 23, [0, 40]), (24, 25, [10, 20, 30, 40, 50]), (26, 27, [0]), (27, 28, [30])):  # 0.9, 0.8 and more, below, and a chain
        base[j] = changed(base[i], places)
    base[30], base[31] = "a b c d e f g h i j", "a b c d e f g h i j k"  # 6 of 7 shingles
    base[32], base[33] = "one two three four five six", "one two three four five seven"  # 1 of 3
    base[34] = (base[35] + " ") * 400  # long, and of the same shingles but for the seams
    base += [None, "", " \t"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "extra", 7, i) for i, t in enumerate(base)] + [(5, base[5], "en", "s1", 3, "extra", 7, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, items string, n_words int, copy_no int")
    d = save(spark, tmp_path, documents=docs, benchmark=spark.createDataFrame([(1, " ".join(bench))], "item_id long, text string"))
    after, now = {}, spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, d).collect(), [*now.columns, "copy_no_2"] if name == "mix" else now.schema)
        after[name] = now.collect()
    ids = {k: sorted(x["doc_id"] for x in v) for k, v in after.items()}
    assert ids["language"] == sorted([*(i for i in range(60) if i != 15), 5])
    texts = {i: base[i] for i in ids["language"]}

    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in texts.items()}
    group = roots(sorted(texts), [(i, j) for i in texts for j in texts if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert [group[i] for i in (14, 21, 23, 25, 27, 28, 31, 33)] == [13, 20, 22, 25, 26, 26, 30, 33]
    left = [i for i in sorted(texts) if group[i] == i]
    assert ids["near_duplicates"] == left
    left = [i for i in left if " ".join(bench[:10]) not in base[i] and " ".join(bench[4:]) not in base[i]]
    assert ids["decontaminate"] == left == ids["pii"]
    clean = {x["doc_id"]: x for x in after["pii"]}
    assert all(clean[i]["text"] == base[i].replace("joe@mail.example.com", "[EMAIL]") and clean[i]["n_chars"] == len(clean[i]["text"]) for i in left)
    assert all((x["items"], x["n_words"], x["copy_no"]) == ("extra", 7, x["doc_id"]) for x in after["mix"])
    sizes = Counter()
    for x in clean.values():
        sizes[x["source"]] += len(x["text"].split())
    weights = {k: 1 + i % 3 for i, k in enumerate(sorted(sizes, key=lambda k: (k is None, k)))}
    target, open_ = {}, set(sizes)
    while True:  # the excess of full sources is shared again by weight
        rest = sum(sizes.values()) - sum(target.values())
        share = {k: rest * weights[k] / sum(weights[x] for x in open_) for k in open_}
        full = {k for k in open_ if share[k] > 3 * sizes[k]}
        if not full:
            break
        target |= {k: 3 * sizes[k] for k in full}
        open_ -= full
    target |= share
    copies = Counter(x["doc_id"] for x in after["mix"])
    for i, x in clean.items():
        rate = target[x["source"]] / sizes[x["source"]]
        draw = int(hashlib.md5(f"mix-1:{i}:{x['text']}".encode()).hexdigest()[:13], 16) / 2**52
        assert copies[i] == int(rate) + (draw < rate % 1)
    whole = corpus_pipeline.run(spark, d).collect()
    assert sorted(map(str, whole)) == sorted(map(str, after["mix"])) and {x["copy_no_2"] for x in whole} >= {1}
    empty = save(spark, tmp_path / "none", documents=docs.limit(0), benchmark=spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_registry_has_every_number():
    names = registry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)
