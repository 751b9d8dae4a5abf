"""The queue encoder, resampling and the divergence audit against plain Python and the library, on odd rows and on the smallest tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quernstone.llm import divergence, merge_queue, resampling
from quernstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, decoded int, weight int, score string, rank int, buckets int, n int, value string, part int"


def _sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def queue():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        return merge_queue.QueueBpe(file.read())


def _rows():
    rng = random.Random(8)
    words = ["Koor", "koor", "zingt", "été", "漢字", "b2", "x", "markt", "Ünder"]
    texts = [None, "", " \n\t", "<|endoftext|>", "a<|endoftext|>b <|endo", "\x00 \x1c　", "one " * 30_000, "z" * 50_000, "😀 é ꟎ 𒑯1"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(120)] + ["hot copy of one text " * 6] * 60
    rows = [(i, t, [None, "nl", "en", "en", ""][i % 5], [None, "a", "b", "hot", "hot", "hot"][i % 6], 1, "x", 1, 1, "x", 1, 1, 1, "x", 1) for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, *rows[21][1:]), (None, *rows[22][1:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- encoding


def test_queue_encodes_as_the_library(tokenizer, queue):
    rng = random.Random(1)
    parts = ["<|endoftext|>", "<|endo", " ", "  ", "\n", "\t", "'s", "'ll", "'S", "a", "the", " The", "é", "漢", "😀", "1", "23", "...", "　", "\x1c", "ſ", "꟎", " ꟏", "𒑯", "x" * 50, "ab" * 40, "==", "\x00", "\x85", "﻿"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        mine = queue.encode(text)
        assert mine.tolist() == ids and queue.decode(np.asarray(mine)) == tokenizer.decode(ids, skip_special_tokens=False) == text
    for _ in range(300):  # any ids, also such as stand for no UTF-8 or for nothing
        ids = [rng.randrange(50_400) for _ in range(20)]
        assert queue.decode(np.asarray(ids)) == tokenizer.decode(ids, skip_special_tokens=False)
        assert queue.decode(np.asarray(ids), frozenset([50256])) == tokenizer.decode(ids, skip_special_tokens=True)


def test_queue_classes_of_all_characters(tokenizer, queue):
    """Letters, numbers and white space are what the library takes for them, character by character."""
    for start in range(0, 0x110000, 64):
        text = "".join(f"a{c} {c}1{c}!{c}  {c}" for c in map(chr, range(start, start + 64)) if not 0xD800 <= ord(c) < 0xE000)
        if start < 0x3000 or start % 1024 == 0 or 0xA700 <= start < 0xAC00 or 0x10000 <= start < 0x20000:
            assert queue.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, hex(start)


def test_long_texts_are_cut_where_matches_end(tokenizer, queue, monkeypatch):
    text = " ".join(["été", "12", "don't", "  x", "\n\n", "...", "a" * 300] * 40)
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    for size in (1, 7, 100):
        cut = list(merge_queue.pieces(text, size))
        assert "".join(cut) == text and len(cut) > 5
        assert [i for piece in cut for i in queue.encode(piece)] == ids


def test_encode_and_decode_documents(docs, tokenizer):
    out = merge_queue.decode_documents(merge_queue.encode_documents(docs.select("doc_id", "text", "ids", "decoded")))
    assert out.columns == ["doc_id", "text", "ids", "decoded"] and out.count() == len(_rows())
    for r in out.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["decoded"] == (r["text"] or "")
    bare = merge_queue.decode_documents(merge_queue.encode_documents(docs.where("doc_id = 4")), skip_special_tokens=True).first()
    assert bare["decoded"] == "ab <|endo"


def test_op11(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in QUERIES["op11_merge_queue"](spark, SF).collect()}
    assert set(out) == set(texts)
    for i, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == (len(ids), _sha(struct.pack(f"<{len(ids)}I", *ids)), _sha(t.encode()))


# --- resampling


def _fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _features(text, run):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _fold(text))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def _resampled(rows, target, run=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, wanted = Counter(), Counter()
    for _, t in rows:
        raw.update(map(bucket, _features(t, run)[1]))
    for t in target:
        wanted.update(map(bucket, _features(t, run)[1]))
    s_all, t_all = raw.total(), wanted.total()
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
    out = []
    for i, t in rows:
        n, found = _features(t, run)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(_sha(f"2024:{'' if i is None else i}".encode())[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, (r[:5] for r in out)), key=str)


@pytest.mark.parametrize(("run", "percent"), [(1, 10), (3, 50), (1, 100), (2, 0)])
def test_resampling(spark, docs, run, percent):
    target = ["Koor zingt koor", None, "", "markt x b2"]
    given = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resample(docs, given, run=run, percent=percent, buckets=500, keep_text=False)
    assert "text" not in out.columns and {"lang", "source", "ids"} <= set(out.columns)
    want = _resampled([r[:2] for r in _rows()], target, run, 500, percent)
    assert sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == want
    kept = resampling.drawn(docs.select("doc_id", "text", "lang"), given, run=run, percent=percent, buckets=500).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(w[0]) for w in want if w[4] is not None)


def test_resampling_of_empty_tables(spark, docs, empty):
    assert resampling.resample(empty, empty).collect() == []
    out = resampling.resample(docs, empty)
    assert out.count() == len(_rows()) and out.where("rank is not null").count() > 0


def test_op12(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = QUERIES["op12_resampling"](spark, SF)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, out.collect()), key=str) == _resampled(rows, target)


# --- divergence


def _audited(rows, least):
    counts, having, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _fold(text))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        having[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in having[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        of = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(of[s][t] for s in sources) for t in kept}
        share = lambda n: {t: 1 + 1_000_000_000 * (c + 2) // (sum(n.values()) + 2 * len(kept)) for t, c in n.items()}
        p, q = {s: share(of[s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if of[s][t] > 0 and p[s][t] > q[t])[:10]
            out += [(lang, s, part, item.decode(), -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 5, 10_000])
def test_divergence(docs, least, monkeypatch):
    monkeypatch.setattr(divergence, "VECTORS", 3)
    monkeypatch.setattr(divergence, "HELD", 4)
    out = divergence.audit(docs, least_documents=least)
    assert sorted(map(tuple, out.collect())) == _audited([(r[1], r[2], r[3]) for r in _rows()], least)


def test_divergence_in_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 8)
    assert sorted(map(tuple, divergence.audit(docs, least_documents=2).collect())) == _audited([(r[1], r[2], r[3]) for r in _rows()], 2)


def test_divergence_of_an_empty_table(empty):
    assert divergence.audit(empty).collect() == []


def test_shares_are_exact_for_large_counts():
    for count, of in ((3 * 10**12, 7 * 10**12 + 1), (1, 9 * 10**15), (9 * 10**15, 9 * 10**15)):
        assert divergence.share(np.array([count]), np.array([of]))[0] == 1 + 10**9 * count // of


def test_op13(spark):
    rows = [(r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_divergence"](spark, SF).collect())) == _audited(rows, 10)
