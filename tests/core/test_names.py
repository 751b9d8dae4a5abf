"""Likeness of names, phones and tolerant pairing against plain Python that shares nothing with the library."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import resolve

RNG = random.Random(12)
WORDS = "markt markten veemarkt zomermarkt concert concerten koor kerk kerkplein wandeling wandeltocht 2026 1999 été déjà o'neill midsland-west a".split()


def fold(s):
    for sign in "-_'’":
        s = s.replace(sign, " ")
    s = "".join(c for c in unicodedata.normalize("NFD", s) if c == " " or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")
    return s.lower().split()


def distance(a, b):
    table = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return table[-1][-1]


def near(a, b):
    if a == b:
        return True
    if len(a) < 5 or len(b) < 5:
        return False
    return a in b or b in a or 1 - distance(a, b) / max(len(a), len(b)) >= 0.8


def pairs(a, b):
    free, count = list(b), 0
    for w in a:
        for i, x in enumerate(free):
            if near(w, x):
                del free[i]
                count += 1
                break
    return count


def words(s):
    return fold(re.sub(r"\b(19|20)\d\d\b", " ", s))


def fuzzy(a, b):
    p, q = words(a), words(b)
    return pairs(p, q) / (len(p) + len(q) - pairs(p, q)) if p and q else 0.0


def contained(a, b):
    p, q = sorted((words(a), words(b)), key=len)
    return 0.75 if p and sum(map(len, p)) >= 8 and pairs(p, q) == len(p) else 0.0


def letters(a, b):
    x, y = " ".join(fold(a)), " ".join(fold(b))
    return 1.0 if not x and not y else 0.0 if not x or not y else 1 - distance(x, y) / max(len(x), len(y))


def tokens(a, b):
    x, y = set(fold(a)), set(fold(b))
    return len(x & y) / len(x | y) if x and y else 0.0


def test_names(spark):
    some = lambda: " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(0, 5)))
    rows = [(i, some(), some()) for i in range(300)]
    given = spark.createDataFrame(rows, "i int, a string, b string").withColumnsRenamed({"a": "a_name", "b": "b_name"}).withColumns({"a_slug": text.slug("a_name"), "b_slug": text.slug("b_name"), "a_words": text.words("a_name"), "b_words": text.words("b_name")})
    found = given.select("i", "a_slug", text.fuzzy_token_similarity("a_name", "b_name").alias("fuzzy"), text.containment("a_name", "b_name").alias("contained"), resolve.name_likeness("a_", "b_").alias("like"))
    for r in found.collect():
        _, a, b = rows[r["i"]]
        assert r["a_slug"] == " ".join(fold(a))
        assert abs(r["fuzzy"] - fuzzy(a, b)) < 1e-9 and r["contained"] == contained(a, b), (a, b)
        assert abs(r["like"] - max(letters(a, b), tokens(a, b), fuzzy(a, b), contained(a, b))) < 1e-9, (a, b)


def phone(s):
    for m in re.finditer(r"(?<!\d)(?:\+31[\s\-]?\(?0?\)?[\s\-]?|0)(?:\d[\s\-]?){8,10}\d(?!\d)", s, re.ASCII):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 12:
            return " ".join(m[0].split())
    return None


def test_phones(spark):
    said = ["bel 0562 123456", "+31 (0)562-123456", "06-12 34 56 78", "00", "1234567890", "0562 1234567890123", "x0562123456 en 0612345678", "", "tel. +31562123456."]
    said += ["".join(RNG.choice("0123 -+()") for _ in range(30)) for _ in range(300)]
    found = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", text.find_phone(F.col("t")).alias("p")).collect()
    assert {r["i"]: r["p"] for r in found} == {i: phone(s) for i, s in enumerate(said)}


def test_phones_at_the_beginning_of_longer_runs(spark):
    said = ["kaart 0300233469491448", "bel 0562 123456", "1030023346949"]
    found = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", text.find_phone(F.col("t"), whole=False).alias("p"), text.find_phone(F.col("t")).alias("q")).collect()
    assert {r["i"]: (r["p"], r["q"]) for r in found} == {0: ("030023346949", None), 1: ("0562 123456", "0562 123456"), 2: (None, None)}


def test_a_text_is_slugged_once_for_all_categories(spark):
    from quernstone.functions import categories

    rows = spark.createDataFrame([(0, "krat"), (1, ""), (2, None), (3, "mok")], "i int, t string")
    out = rows.select("i", categories.classify(F.reverse("t"), {"Markt": ("tark",), "Festival": ("kom",)}).alias("c"))
    assert {r["i"]: r["c"] for r in out.collect()} == {0: ["Markt"], 1: [], 2: [categories.OTHER], 3: ["Cultuur", "Festival"]}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1


def test_names_within_words_are_not_looked_at_closely():
    """Each name that only stood within words had its pattern read the whole text again."""
    from quernstone.functions import places

    names = ("can", "de Zaal", "oost-ende", "’t Huis", " rand", "tab\tje", "twee  wit", "größe", "Kin")
    finder, asked = places._Finder(tuple(map(places.Place, names))), []
    real = finder._fits
    finder._fits = lambda i, hay: asked.append(finder.names[i][0]) or real(i, hay)
    assert finder("candle vulcan scan de zaaltje akin " * 50) == [] and asked == []
    assert finder("a can, DE-zaal") == ["de Zaal", "can"] and asked == []
    said = "x  rand tab je twee wit twee - wit oost-ende oost ende grösse größe ’T HUIS Kin canͅ"
    assert set(finder(said)) == {i for i in names if real(next(k for k, n in enumerate(finder.names) if n[0] == i), said)}
