"""The registered queries on the smallest tables against plain Python."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from math import log, sqrt

import numpy as np
import pytest
import xxhash
from brute import library, personal, secret, sha, written

from quernstone.llm import language, toxicity
from quernstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def _rows(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}


def test_op5(spark, texts):
    encode = library().encode_ordinary
    out = _rows(spark, "op5_bpe")
    assert set(out) == set(texts)
    for i, t in texts.items():
        ids = encode(t)
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha(t))


def test_op6(spark, texts):
    out = _rows(spark, "op6_simhash")
    prints = {}
    for i, t in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    group = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            for j in texts:
                if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] > group[j]:
                    group[i], changed = group[j], True
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in out.items()} == {i: (f"{prints[i]:016x}", group[i]) for i in texts}


def test_op7_and_op8_keep_what_the_patterns_find(spark, texts):
    seven, eight = _rows(spark, "op7_pii"), _rows(spark, "op8_secrets")
    for i, t in texts.items():
        assert seven[i]["base_sha256"] == sha(written(personal(t))) and eight[i]["base_sha256"] == sha(written(secret(t)))
        assert set(written(personal(t)).split(",")) <= set(seven[i]["spans"].split(",")) and set(written(secret(t)).split(",")) <= set(eight[i]["spans"].split(","))


def _grams(text):
    """Counts of hashed pairs and triples of letters, word by word, with plain numbers."""
    codes, last = [], True
    for c in text.lower():
        if c.isalpha() or not last:
            codes.append(ord(c) if c.isalpha() else 32)
        last = not c.isalpha()
    if text and not text.lower()[0].isalpha():
        codes.insert(0, 32)
    out = Counter()
    m = 0xFFFFFFFF
    for a, b in zip(codes, codes[1:]):
        out[((a * 0x9E3779B1 + b * 0x85EBCA77) & m) >> 18] += 1
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        out[((a * 0x9E3779B1 & m) ^ (b * 0xC2B2AE3D & m) ^ (c * 0x27D4EB2F & m)) >> 18] += 1
    return out


def test_op9(spark, texts):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    sums = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            sums[r["lang"]].update(_grams(r["text"]))
    names = sorted(sums)
    code = language.codewords(len(names))
    assert all((code[i] != code[j]).any() for i in range(len(names)) for j in range(i))
    share = {n: {k: (sums[n][k] + 0.5) / (sums[n].total() + 0.5 * language.FEATURES) for k in range(language.FEATURES)} for n in names}
    bits = []
    for b in range(code.shape[1]):
        one, zero = ([n for n, w in zip(names, code, strict=True) if w[b] == s] for s in (1, -1))
        p, q = (np.array([sum(share[n][k] for n in side) / len(side) for k in range(language.FEATURES)]) for side in (one, zero))
        w = np.log(p) - np.log(q)
        bits.append((w, (p @ w + q @ w) / 2, max((p @ w - q @ w) / 2, 1e-9)))
    total = sum(s for _, _, s in bits) / len(bits)
    out = _rows(spark, "op9_language")
    for i, t in texts.items():
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= out[i]["score"] <= 1
        if not any(c.isalpha() for c in t):
            assert out[i]["lang_pred"] == "und"
            continue
        grams = _grams(t)
        loss = []
        for w in code:
            loss.append(0.0)
            for b, (weights, centre, spread) in enumerate(bits):
                margin = (sum(n * weights[k] for k, n in grams.items()) / max(1, grams.total()) - centre) / spread
                loss[-1] += spread / total * log(1 + np.exp(-4 * min(8, max(-8, w[b] * margin))))
        assert out[i]["lang_pred"] == names[int(np.argmin(loss))] or sorted(loss)[1] - min(loss) < 1e-3, i
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["lang"] and any(c.isalpha() for c in r["text"] or "")]
    assert sum(out[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.9 * len(held)


def test_op10(spark, texts):
    """The neighbours are those of a brute-force cosine over all terms of the examples that the index holds."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in index.ids.tolist())
    counts = {i: Counter(re.findall(r"[^\W_]+", t.lower())) for i, t in texts.items()}
    ids, label = index.ids.tolist(), dict(zip(index.ids.tolist(), index.labels.tolist(), strict=True))
    n, rate = len(ids), sum(label.values()) / len(ids)
    df, bad = Counter(t for i in ids for t in counts[i]), Counter(t for i in ids if label[i] for t in counts[i])
    weight = {t: log(1 + n / df[t]) * (1 + max(abs(bad[t] - df[t] * rate) - 0.5, 0) ** 2 / (df[t] * rate * (1 - rate))) for t in df}
    vector = {i: {t: sqrt(c) * weight.get(t, log(1 + n)) for t, c in counts[i].items()} for i in texts}
    norm = {i: sqrt(sum(w * w for w in v.values())) for i, v in vector.items()}
    out = _rows(spark, "op10_toxicity")
    for i in texts:
        like = sorted(((sum(w * vector[j].get(t, 0) for t, w in vector[i].items() if t in df) / norm[i] / norm[j] if norm[i] and norm[j] else 0.0, j) for j in ids), reverse=True)
        best = [x for x in like if x[0] > 1e-12][: toxicity.NEIGHBOURS]
        r = out[i]
        assert len(r["evidence"]) == len(best)
        of = {j: s for s, j in like}
        assert all(abs(of[j] - s) < 1e-5 for j, (s, _) in zip(r["evidence"], best, strict=True)), i
        votes = [(of[j], label[j]) for j in r["evidence"]]
        score = (toxicity.PRIOR_WEIGHT * rate + sum(s * y for s, y in votes)) / (toxicity.PRIOR_WEIGHT + sum(s for s, _ in votes))
        assert abs(r["score"] - score) < 1e-4 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_others_cover_their_tables(spark, texts):
    pages = {r["page_id"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id").collect()}
    one = QUERIES["op1_url_filter"](spark, SF).collect()
    assert {r["page_id"] for r in one} == pages and len(one) == len(pages) and {r["verdict"] for r in one} <= {"allow", "block"}
    for name in ("op2_mixing", "op3_fingerprints", "op4_exact_dedup"):
        assert set(_rows(spark, name)) == set(texts)
