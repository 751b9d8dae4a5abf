"""Near copies and rows with null or repeated ids in the steps that drop documents."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quernstone.llm import common, exact_dedup, mixing, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(31)


def _prose(n):
    return ["".join(RNG.choice("aeionrstl") for _ in range(RNG.randint(3, 8))) for _ in range(n)]


def _shingles(text):
    words = WORD.findall((text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _jaccard(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b)


def _corpus():
    """Texts of 200 words, each with a copy whose likeness is 0.8 to 0.9 or just below 0.8."""
    texts = []
    for i in range(60):
        words = _prose(200)
        other = list(words)
        for at in range(10, 200, 180 // (2 + i % 4)):
            other[at] = "changed"
        texts += [" ".join(words), " ".join(other)]
    return [*texts, None, "  ", "short text", "Short  text", "other short", *[texts[0] + f" tail{i}" for i in range(40)]]


@pytest.mark.parametrize("tile", [simhash.COPY_TILE, 6])
def test_drop_near_finds_copies_from_four_fifths(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "COPY_TILE", tile)
    texts = _corpus()
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    between = 0
    for i in range(len(texts)):
        for j in range(i):
            if (likeness := _jaccard(texts[i], texts[j])) >= 0.8:
                between += likeness < 0.9
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert between > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[find(i)].append(i)
    assert sorted(r["doc_id"] for r in simhash.drop_near(docs).collect()) == sorted(map(min, groups.values()))


def test_null_and_repeated_ids_do_not_take_other_texts_along(spark):
    rows = [(None, "abc"), (9, "ABC"), (None, "only under null"), (5, "Abc"), (5, "only under five")]
    kept = exact_dedup.drop_exact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in kept} == {(9, "ABC"), (None, "only under null"), (5, "only under five")}

    a, b, c, d = (" ".join(_prose(200)) for _ in range(4))
    rows = [(3, a), (None, a + " tail"), (None, b), (5, a + " end"), (5, c), (8, c + " tail"), (None, d), (None, d + " tail")]
    kept = [tuple(r) for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {(3, a), (None, b), (5, c)} <= set(kept) and len(kept) == 4 and kept.count((None, d)) + kept.count((None, d + " tail")) == 1


def test_groups_that_share_an_id_stay_apart(spark, monkeypatch):
    a, b, c = (" ".join(_prose(200)) for _ in range(3))
    rows = [(5, a), (5, b), (7, b), (None, c)]
    found = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == [(0, 0), (5, 5), (5, 5), (7, 5)]
    rows = [(1, a), (5, a), (5, b), (7, b)]  # 5 is the smallest id of b only
    found = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (5, 1), (5, 5), (7, 5)]
    monkeypatch.setattr(simhash, "fingerprint_udf", F.udf(lambda t: int(t), "long"))
    rows = [(5, "0"), (9, "1"), (5, str((1 << 40) - 1)), (4, str((1 << 40) - 2))]  # two groups whose fingerprints share id 5
    found = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(4, 4), (5, 4), (5, 5), (9, 5)]


CLASHING = ("_gone", "_sha", "_key_id", "_key_text", "_bucket", "_bits", "_at", "_none", "_source", "_size", "_key", "_n", "_passes", "_stop", "_pass", "_row", "gone", "node", "keys", "a.b")


@pytest.mark.parametrize("of", [exact_dedup.drop_exact, simhash.drop_near, mixing.mixed])
def test_rows_stand_for_themselves_and_columns_stay(spark, of):
    texts = [" ".join(_prose(60)) for _ in range(12)]
    rows = [(7, texts[0]), (5, texts[0].upper() if of is exact_dedup.drop_exact else texts[0]), (5, texts[1]), (None, texts[0]), (None, texts[2]), (9, texts[3]), (9, texts[3]), (9, texts[4]), (None, texts[5]), (None, texts[5])]
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame([(*r, "s", *map(str, range(len(CLASHING)))) for r in rows], f"doc_id long, text string, source string, {names}").repartition(3)
    out = of(docs)
    assert out.columns == docs.columns
    found = out.collect()
    assert all(list(r)[3:] == list(map(str, range(len(CLASHING)))) for r in found)
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in found)
    if of is mixing.mixed:
        words = sum(len(r["text"].split()) for r in found)
        assert abs(words - 1.5 * 60 * len(rows)) <= 90  # half a document, and equal rows go together
        assert {texts.index(t) for _, t in kept} == {0, 1, 2, 3, 4, 5}
    else:
        stays = (7, texts[0]) if of is exact_dedup.drop_exact else (5, texts[0])
        assert kept == sorted([stays, (5, texts[1]), (0, texts[2]), (9, texts[3]), (9, texts[4]), (0, texts[5])])


def test_no_text_is_lost_with_a_full_bitmap(spark, monkeypatch):
    monkeypatch.setattr(common, "WIDTH", 4)  # every row may be meant
    rows = [(i % 50, f"text {i % 70}") for i in range(400)] + [(None, "text 1"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    best = {}
    for i, t in rows:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in exact_dedup.drop_exact(docs).collect()) == sorted((i, t) for t, i in best.items())


def test_texts_that_share_a_hash_by_chance_stay(spark, monkeypatch):
    """With a hash of a few values, unlike texts of one hash are all kept."""
    real = simhash.F.xxhash64

    class Few:
        def __getattr__(self, name):
            return getattr(functions, name)

        @staticmethod
        def xxhash64(*columns):
            return functions.pmod(real(*columns), functions.lit(3)) if len(columns) == 1 else real(*columns)

    functions = simhash.F
    monkeypatch.setattr(simhash, "F", Few())
    rows = [(i, f"text number {i} has words of its own such as w{i} and v{i * 7}") for i in range(12)]
    kept = simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(12))


def test_drop_near_goes_by_simhash_tiles_and_the_exact_likeness_confirms(spark, monkeypatch):
    """Without bands, long near copies are found by fingerprints alone; fingerprints that agree by chance drop no text."""
    calls, real = [], simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda *a: calls.append(a) or real(*a))
    monkeypatch.setattr(simhash, "BANDS", 0)
    texts = [" ".join(_prose(1500)) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate([*texts, *[t + f" tail{k}" for t in texts for k in range(3)], None, " "])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.drop_near(docs).collect()) == [0, 1, 2, 12]
    assert len(calls) == 1
    monkeypatch.setattr(simhash, "masks", lambda *a: [0])
    monkeypatch.setattr(simhash, "RADIUS", 64)
    monkeypatch.setattr(simhash.simhash_groups, "__defaults__", (64,))  # all fingerprints meet
    assert sorted(r["doc_id"] for r in simhash.drop_near(docs).collect()) == [0, 1, 2, 12]


def test_few_rows_are_joined_in_one_broadcast(spark):
    """A join of few rows took two broadcasts and a shuffle of both sides."""
    rows = common.cut(spark.createDataFrame([(i % 5, i) for i in range(100)], "k long, v long"))
    groups = common.cut(rows.where("k < 3").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most")))
    found = common.attach(rows, groups, ["k"], "n", 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "hashpartitioning" not in plan
    assert sorted((r["k"], r["v"], r["n"], r["most"]) for r in found.where("k < 3").collect()) == sorted((i % 5, i, 20, 95 + i % 5) for i in range(100) if i % 5 < 3)
    assert found.where("most is null").count() == 40
