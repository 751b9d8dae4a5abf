from brute import personal, sha, written

from quernstone.llm import pii

ODD = [
    (1, None),
    (2, ""),
    (3, "é😀 a@b.c_x@d.e.f and x@y, me.too+1@mail-1.example.org."),
    (4, "1.2.3.4.5.6.7.8 and 256.1.1.1 and 000000255.1.2.003 and 1.2.3"),
    (5, "4111 1111-1111 1111 and 41111111111111111111111111 and 4111111111111112 and 4111-1111-1111-1111-0"),
    (6, "+1 (743) 555-3824 ++44 20 7946 0958. and +1234567 and +123456789012345678 +1 2"),
    (7, "9" * 60_000 + " " + "a" * 60_000 + "@" + "b" * 10),
    (8, " ".join(f"u{i}@h{i}.example.com {i}.2.3.4" for i in range(3000))),
    (8, "same id a@b.c"),
    (None, "no id 1.1.1.1"),
]


def test_base_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in ODD], "doc_id long, text string, kind string, value string")
    found = sorted((r["doc_id"] or 0, r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.digests(docs).collect())
    want = []
    for i, t in ODD:
        spans = personal(t or "")
        want.append((i or 0, sha(written(spans)), *(sum(s[0] == k for s in spans) for k in pii.KINDS)))
    assert found == sorted(want)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"Lorem ipsum. customer card: 4{i:014d} thanks") for i in range(400)]  # about one in ten passes the check
    rows = [(i, t) for i, t in rows if personal(t)] + [(1000 + i, f"nothing {i}2345 here") for i in range(50)]
    rows += [(5000, "Dear customer card: 99AB-7731-5562 thanks"), (5001, "order 99887766 shipped")]
    out = {r["doc_id"]: r["spans"] for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[5000] == "card:20:34"
    assert out[5001] == "" and all(out[1000 + i] == "" for i in range(50))


def test_found_identifiers_lead_to_further_contexts(spark):
    rows = [(i, f"Lorem ipsum. customer card: 4{i:014d} thanks") for i in range(800)]
    rows = [(i, t) for i, t in rows if personal(t)]  # seeds for the first context
    rows += [(1000 + i, f"customer card: 99AB-77{i:02d} thanks") for i in range(40)]  # found by the first context
    rows += [(2000 + i, f"Please quote member ref 99AB-77{i:02d} always") for i in range(40)]  # they induce a second one
    rows += [(5000, "Please quote member ref 88CD-1234 always"), (5001, "order 99887766 shipped"), (5002, "customer card: 9911 2233 4455 thanks")]
    out = {r["doc_id"]: r["spans"] for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1000] == "card:15:24" and out[2000] == "card:24:33"
    assert out[5000] == "card:24:33"
    assert out[5001] == "" and out[5002] == "card:15:29"


def test_empty_table(spark):
    assert pii.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
