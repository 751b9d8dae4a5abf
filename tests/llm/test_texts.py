"""Exact dedup, mixing, fingerprints, BPE and SimHash against plain Python, on odd rows and on empty tables."""

import hashlib
import random
import re
import struct
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import xxhash
from brute import library
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import bpe, exact_dedup, mixing, parsing, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n int, fp string, size int, key string, grp string"
RNG = random.Random(3)


def _prose(n):
    return " ".join("".join(RNG.choice("aeionrstlé") for _ in range(RNG.randint(2, 7))) for _ in range(n))


def _texts():
    base = [_prose(RNG.randint(30, 200)) for _ in range(25)]
    near = [t[: len(t) // 2] + " changed " + t[len(t) // 2 :] for t in base[:12]]
    return [None, "", " \t\n", "ÀB c", "àb c", "Àb C", "one two", "😀 🎉 ẞß", "x" * 30_000, "don't  we'll\n\n  go\x1c \u3000now 123 4567 !!?", *base, *near, *[t.upper() for t in base[:5]], *["hot copy of one text"] * 40]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, None if i % 9 == 0 else "en", [None, "b", "a", "hot", "hot", "hot"][i % 6], 1, 5, 5, "x", 1, "k", "g") for i, t in enumerate(_texts())]
    return out + [out[12], out[12]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[_fold(r[1])].append(r[0])
    want = sorted((r[0], max(g := groups[_fold(r[1])]), len(g), r[0] == max(g), hashlib.sha256(_fold(r[1]).encode()).hexdigest()) for r in rows)
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, digest=True).collect())) == want
    lean = sorted(map(tuple, exact_dedup.exact_dedup(docs).drop("sha256").collect()))
    assert lean == [w[:4] for w in want]
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {w[0] for w in want if w[3]}


def test_mixing(docs, rows):
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    out = mixing.mix(docs).collect()
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((r[0], size[r[0]]) for r in rows)
    source = {r[0]: r[3] for r in rows}
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size[r[0]]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, want, target = set(order), 1.5 * sum(total.values()), {}
    while True:
        share = {s: weight[s] * (want - sum(target.values())) / sum(weight[x] for x in left) for s in left}
        full = {s for s in left if share[s] > 2 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= full
    taken = defaultdict(int)
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(taken[s] == int(target[s] + 1e-9) for s in order)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    again = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(2)).collect())
    assert again == sorted((r["doc_id"], r["taken"]) for r in out)


def test_fingerprints(docs, rows):
    out = parsing.fingerprints(docs).collect()
    mark = {r["text"] or "": r["mark"] for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")).collect()}
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-r[0], mark[r[1]]))
    sketch = lambda t: parsing._text(parsing.sketch(t))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), sketch(t), sketch(edited), parsing.likeness(parsing.sketch(t), parsing.sketch(edited)), parsing.likeness(parsing.sketch(t), parsing.sketch(after))))
    assert sorted(map(tuple, out)) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)


def test_fingerprints_do_not_depend_on_the_offset():
    text = _prose(800)
    moved = parsing.likeness(parsing.sketch(text), parsing.sketch("seven+ " + text))
    assert moved > 0.9 and parsing.likeness(parsing.sketch(text), parsing.sketch(_prose(800))) < 0.3


def test_likeness_does_not_jump_at_a_length():
    rng, near = random.Random(8), []
    for n in range(100, 200, 2):  # texts around the length at which levels used to change
        text = "".join(rng.choice("aeionrstl ") for _ in range(n))
        near.append(parsing.likeness(parsing.sketch(text), parsing.sketch(text + "".join(rng.choice("aeionrstl ") for _ in range(n // 3)))))
    assert min(near) > 0.6


def test_bpe(docs, rows):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    plain = library().encode_ordinary
    trees = [bpe.TreeBpe(ranks, leaf=leaf) for leaf in (2, 7, 48)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in rows:
        text = r[1] or ""
        ids = plain(text)
        if len(text) < 5000:
            assert all(tree.encode(text) == ids for tree in trees)
        want.append((r[0], len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text.encode())))
    assert sorted(map(tuple, bpe.digests(docs).collect())) == sorted(want)
    assert all(trees[0]._bytes(token) == [token] for token in list(trees[0].rank)[::97])  # each token is what its bytes merge to
    assert bpe.encode_documents(docs.withColumnRenamed("key", "_bpe")).columns == [c if c != "key" else "_bpe" for c in docs.columns] + ["ids", "decoded"]


ALPHABETS = ["xyz", "ab ", "  \n\t a", "éß😀 a", "0123456789", "the ing and", "'ts re ll\x1c\u3000\x85", "aA", "=-_ "]


@given(st.sampled_from(ALPHABETS).flatmap(lambda letters: st.text(letters, max_size=200)), st.sampled_from([2, 3, 16]))
@settings(max_examples=300, deadline=None)
def test_bpe_joins_are_exact(text, leaf):
    assert _tree_of(leaf).encode(text) == _library().encode_ordinary(text)
    assert _tree_of(leaf).decode(np.array(_tree_of(leaf).encode(text), "<u4")) == text.encode()


@lru_cache
def _tree_of(leaf):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return bpe.TreeBpe(file.read(), leaf=leaf)


_library = lru_cache(library)


def _simhash(text):
    words = WORD.findall(_fold(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tile", [simhash.TILE, 6])
def test_simhash(docs, rows, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)  # the small one splits buckets into tiles
    prints = [_simhash(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(rows):
        least[find(i)] = min(least[find(i)], r[0])
    want = sorted((r[0], f"{prints[i]:016x}", least[find(i)]) for i, r in enumerate(rows))
    assert sorted(map(tuple, simhash.near_groups(docs).collect())) == want


def test_empty_tables(empty):
    for of in (exact_dedup.exact_dedup, exact_dedup.drop_exact, mixing.mix, mixing.mixed, parsing.fingerprints, bpe.digests, simhash.near_groups, simhash.drop_near):
        assert of(empty).collect() == [], of.__name__
