"""A language is known by its own rows, however many rows other languages have."""

import random

from pyspark.sql import functions as F

from tickforge.llm import language


def test_rare_language_of_a_large_table(spark):
    r = random.Random(7)
    words = {"xx": "lorem amet dolor sit ipsum tempor labore".split(), "yy": "quick brown jumps over lazy the with".split(), "zz": "hyvaa paivaa kiitos talo jarvi metsa kukka".split()}
    kinds = ["xx", "yy"] * 4000 + ["zz"] * 20
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(12)), k, f"h{k}") for i, k in enumerate(kinds)]
    rows += [(9000 + i, " ".join(r.choice(words["xx"]) for _ in range(12)), f"odd{i}", "hxx") for i in range(14)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit(d)
    assert model.languages == ["xx", "yy", "zz"]
    got = {x["id"]: x for x in language.identify(d, model=model).where("id >= 8000").collect()}
    assert all(got[i]["lang"] == "zz" and got[i]["kept"] for i in range(8000, 8020)) and all(got[9000 + i]["lang"] == "xx" for i in range(14))


def test_more_labels_than_languages(spark, monkeypatch):
    """The labels with the most rows are languages; the others' rows get the nearest."""
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    r = random.Random(1)
    words = {"aa": "lorem amet dolor sit ipsum".split(), "bb": "quick brown jumps over lazy".split()}
    rows = [(k, " ".join(r.choice(words["aa" if k % 2 else "bb"]) for _ in range(15)), ("aa" if k % 2 else "bb") if k < 200 else f"x{k % 3}", "h") for k in range(260)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit(d)
    assert model.languages == ["aa", "bb"]
    got = {x["id"]: x["text_lang"] for x in language.identify(d, model=model).collect()}
    assert all(got[k] == ("aa" if k % 2 else "bb") for k in range(260))


def test_pages_in_character_references(spark):
    """A text in numeric references has letters, and a reference inside a word doesn't end it."""
    def coded(text):
        return "".join(f"&#{ord(c)};" for c in text)

    ru, de = "\u0434\u043e\u043c \u043b\u0435\u0441 \u0440\u0435\u043a\u0430 \u0433\u043e\u0440\u0430".split(), "haus b&auml;ume fl&uuml;sse gr&ouml;&szlig;e".split()
    r = random.Random(2)
    rows = [(i, f"http://h{i % 5}.ru/x", f"<html lang=ru><p>{' '.join(coded(r.choice(ru)) for _ in range(20))}<script>var x</script></p>") for i in range(60)]
    rows += [(100 + i, f"http://h{i % 5}.de/x", f"<html lang='de-AT'><div>{' '.join(r.choice(de) for _ in range(20))}</div>") for i in range(60)]
    d = language.page_columns(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert "fl\u00fcsse" in " ".join(x["text"] for x in d.where("page_id >= 100").collect())
    got = language.identify(d, "page_id", declared="declared", host="host", suffix="suffix", domain="domain").collect()
    assert all(x["lang"] == ("ru" if x["id"] < 100 else "de") and x["kept"] for x in got)
    assert language.page_text("<p>a<b>b</b>c<br>d</p>e<!-- <p>x --><style>y</style>") .split() == ["abc", "d", "e"]


def test_language_of_long_texts_alone(spark):
    rows = [(i, "lorem amet dolor " * 20, "xx") for i in range(20)] + [(100 + i, "quick brown jumps " * 1500, "yy") for i in range(20)]
    assert language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["xx", "yy"]


def test_chosen_ids_are_those_of_smallest_hash(spark):
    """One label of many ids, one whose rows repeat few ids, so that the first bound passes too few, and one with fewer ids than are asked for."""
    rows = [("xx", i) for i in range(3000)] + [("yy", 5000 + i % 40) for i in range(4000)] + [("zz", 7000 + i % 4) for i in range(400)]
    d = spark.createDataFrame(rows, "_label string, _id long")
    hashed = sorted((r["_label"], r["h"], r["_id"]) for r in d.distinct().select("*", F.xxhash64(F.lit("language"), "_id").alias("h")).collect())
    want = {(x, i) for k in ("xx", "yy", "zz") for x, _, i in [z for z in hashed if z[0] == k][:10]}
    got = language.smallest_hashes(d, {"xx": 3000, "yy": 4000, "zz": 400}, 10).collect()
    assert len(got) == 24 and {tuple(r) for r in got} == want
