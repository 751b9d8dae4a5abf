import random
import string

from brute import secret, sha, written

from quernstone.llm import secrets

ODD = [
    (1, None),
    (2, ""),
    (3, "token:secret:abcdefgh Password = 'hunter2hunter2' API-key: x apikey=\"aaaa.bbbb=\" TOKEN=short"),
    (4, "AKIAAKIAAKIA0123 xAKIA01234567890 AKIA0123 akia01234567890123"),
    (5, "😀" + "0123456789abcdef" * 2 + "G" + "f" * 31 + " " + "a" * 50_000),
    (6, "token = " + "z" * 60_000),
    (7, " ".join("secret=abcdefgh%d" % i for i in range(2000))),
    (7, "again api_key: 12345678"),
    (None, "passwd=12345678"),
]


def test_base_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, tokens int")
    found = sorted((r["doc_id"] or 0, r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in secrets.digests(docs).collect())
    want = []
    for i, t in ODD:
        spans = secret(t or "")
        want.append((i or 0, sha(written(spans)), *(sum(s[0] == k for s in spans) for k in secrets.KINDS[:3])))
    assert found == sorted(want)


def test_battery_finds_random_tokens_only(spark):
    rng = random.Random(5)
    token = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alphabets = [string.ascii_letters + string.digits + "+/", string.ascii_letters, "0123456789ABCDEF", string.ascii_lowercase + string.digits]
    befores = ["see ", "sig=", "sig: ", 'sig="', "?key=", "x:"]
    planted = [(before, token(alphabet, n)) for before in befores for alphabet in alphabets for n in (24, 40) for _ in range(12)]
    ordinary = [f"internationalization{y}" for y in range(1900, 2000)] + [f"release-candidate-2024-{i:02d}-final-build" for i in range(60)] + ["0123456789abcdefghijklmnop", "xy1" * 12, "acknowledgementsandreferences", "getElementByIdFromDocumentNode", "src/main/java/org/example/util"]
    rows = [(i, f"text {b}{t} there") for i, (b, t) in enumerate(planted)] + [(10_000 + i, f"see {t} there") for i, t in enumerate(ordinary)]
    out = {r["doc_id"]: r["spans"] for r in secrets.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = {}
    for i, (before, t) in enumerate(planted):
        start = 5 + len(before)
        caught.setdefault((before, len(t)), []).append(f"random:{start}:{start + len(t)}" in out[i])
    share = {k: sum(x) / len(x) for k, x in caught.items()}
    assert all(share[before, 40] >= 0.95 and share[before, 24] >= 0.75 for before in befores), share  # few characters are little evidence
    assert not any(out[10_000 + i] for i in range(len(ordinary)))


def test_empty_table(spark):
    assert secrets.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
