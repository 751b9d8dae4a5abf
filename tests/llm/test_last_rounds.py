"""Components of few links: their rounds are one job."""

import random

from quernstone.llm import components


def test_few_links_take_few_checkpoints(spark, monkeypatch):
    written = []
    cut = components.cut
    monkeypatch.setattr(components, "cut", lambda df: written.append(1) or cut(df))
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(-(2**63), 2**63 - 1), (5000, 5000)] + [(10**12 + rng.randrange(300), 10**12 + rng.randrange(300)) for _ in range(160)]
    rng.shuffle(links)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    table = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(table).collect()}
    assert got == {x: find(x) for x in root}
    assert len(written) <= 3
    monkeypatch.setattr(components, "ROWS_A_PART", 60)  # rounds over the whole table come first
    assert {r["node"]: r["component"] for r in components.components(table).collect()} == got
