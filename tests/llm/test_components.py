"""Connected components against a forest in numpy, and how many rows their joins make."""

import random

import numpy as np
import pytest

from tickforge.llm import components, simhash


def joined_rows(spark, monkeypatch):
    """How many links go into joins, by join."""
    rows, kind = [], type(spark.range(1))
    join = kind.join

    def counted(self, *args, **kw):
        if {"a", "b"} <= set(self.columns):
            rows.append(self.count())
        return join(self, *args, **kw)

    monkeypatch.setattr(kind, "join", counted)
    return rows


def table(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_a_forest(spark, seed):
    r = random.Random(seed)
    n = 600
    order = r.sample(range(n), n)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(299 + i, 300 + i) for i in range(100)] + [(order[i], order[i + 1]) for i in range(0, 60, 2)]
    pairs += [(450, x) for x in range(410, 450)] + [(599, x) for x in range(560, 599)] + [(7, 7), (500, 500)]
    root = simhash.forest(n, *(np.array(x) for x in zip(*pairs, strict=True)))
    got = {x["node"]: x["root"] for x in components.components(table(spark, pairs)).collect()}
    assert got == {x: int(root[x]) for p in pairs if p[0] != p[1] for x in p}
    assert components.components(table(spark, pairs).limit(0)).count() == 0


def test_links_are_joined_while_they_lead_elsewhere(spark, monkeypatch):
    """Groups with many links each, and a long way: a round leaves only links between its trees."""
    rows = joined_rows(spark, monkeypatch)
    r = random.Random(3)
    many = [(1000 * g + r.randrange(60), 1000 * g + r.randrange(60)) for g in range(20) for _ in range(600)]
    components.components(table(spark, [*many, *((i, i + 1) for i in range(50_000, 50_200))])).count()
    assert rows[0] > 5000 and sum(rows) < 2.2 * rows[0]
