"""The fused posterior of both queries against one worked out row by row, and what a row's own label may not do."""

import math
import os
import random
from collections import defaultdict

import pytest

from tickforge.llm import language
from tickforge.llm.common import table

DIR, PAGES = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def posteriors(rows, names):
    """From (id, declared, suffix, domain, host, n, ev): id -> probabilities."""
    m = range(len(names))
    p = []
    for r in rows:
        e = [math.exp(x) if r["n"] else 0.0 for x in r["ev"]]
        p.append([x / sum(e) if sum(e) else 0.0 for x in e])
    g = [sum(x[i] for x in p) + 1.0 for i in m]
    share = [x / sum(g) for x in g]
    group = {level: defaultdict(lambda: [0.0] * len(names)) for level in ("declared", "suffix", "domain", "host")}
    for r, x in zip(rows, p, strict=True):
        for level, held in group.items():
            held[r[level]] = [a + b for a, b in zip(held[r[level]], x, strict=True)]
    n_values = {level: max(1, sum(k is not None for k in held)) for level, held in group.items()}
    out = {}
    for r, x in zip(rows, p, strict=True):
        own = {level: [max(0.0, a - b) for a, b in zip(group[level][r[level]], x, strict=True)] for level in group}
        score = []
        for i in m:
            s = r["ev"][i]
            for level in ("declared", "suffix"):
                s += math.log((own[level][i] + language.LABEL_WEIGHT / n_values[level]) / (max(0.0, g[i] - x[i]) + language.LABEL_WEIGHT))
            domain = [(own["domain"][j] + language.DOMAIN_WEIGHT * share[j]) / (sum(own["domain"]) + language.DOMAIN_WEIGHT) for j in m]
            s += math.log((own["host"][i] + language.HOST_WEIGHT * domain[i]) / (sum(own["host"]) + language.HOST_WEIGHT))
            score.append(s)
        e = [math.exp(s - max(score)) for s in score]
        out[r["id"]] = [y / sum(e) for y in e]
    return out


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("which", ["documents", "pages"])
@pytest.mark.parametrize("broadcast", [1, 1_000_000])
def test_posterior_is_the_product_of_its_parts(spark, monkeypatch, which, broadcast):
    monkeypatch.setattr(language, "BROADCAST_VALUES", broadcast)
    if which == "documents":
        d, args = table(spark, DIR, "documents"), {}
    else:
        d, args = language.page_columns(table(spark, PAGES, "pages")), {"id_col": "page_id", "declared": "declared", "host": "host", "suffix": "suffix", "domain": "domain"}
    model = language.fit(d, "text", args.get("declared", "lang"), args.get("id_col", "doc_id"))
    assert len(model.languages) > 1
    kept = []
    real = language.fuse
    monkeypatch.setattr(language, "fuse", lambda ev, *a, **k: kept.append(ev) or real(ev, *a, **k))
    got = {r["id"]: r for r in language.identify(d, model=model, **args).collect()}
    want = posteriors(kept[0].collect(), model.languages)
    assert got.keys() == want.keys()
    for i, p in want.items():
        assert abs(got[i]["probability"] - max(p)) < 1e-9
        assert got[i]["lang"] in ("und", *(x for x, y in zip(model.languages, p, strict=True) if y > max(p) - 1e-9))


def test_a_row_is_scored_without_its_own_label(spark):
    """A wrong label on one row of odd words doesn't make its text that language's."""
    r = random.Random(2)
    words = {"xx": "lorem amet dolor sit ipsum tempor labore".split(), "yy": "quick brown jumps over lazy the with".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k, None) for i, k in enumerate(("xx", "yy") * 100)]
    rows += [(500, "quick brown jumps over lazy the with " * 4, "xx", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x["id"]: x for x in language.identify(d).collect()}
    assert got[500]["text_lang"] == "yy"


def test_pages_of_no_rows_and_repeats(spark):
    d = spark.createDataFrame([(1, "http://a.fr/x", "<html lang=fr><p>bon jour</p>")] * 3 + [(2, None, None)], "page_id long, url string, html string")
    c = language.page_columns(d)
    args = {"id_col": "page_id", "declared": "declared", "host": "host", "suffix": "suffix", "domain": "domain"}
    assert [r["lang"] for r in language.identify(c, **args).collect()] == ["und"] * 4
    assert language.identify(c.limit(0), **args).count() == 0


def test_a_very_long_text(spark):
    r = random.Random(4)
    words = {"xx": "lorem amet dolor sit ipsum tempor labore".split(), "yy": "quick brown jumps over lazy the with".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k, "h") for i, k in enumerate(("xx", "yy") * 40)]
    rows += [(900, "lorem dolor ipsum " * 200_000, "xx", "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x["id"]: x for x in language.identify(d).collect()}
    assert got[900]["lang"] == "xx" and got[900]["kept"]
