"""Text functions: folding to slugs, cleaning, likeness, contacts, ids."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quernstone.functions.fixed import UNKNOWN

# Fixed values. How e-mail addresses and phone numbers are written, addresses that don't count, digits of a number, and segments of a path that name a language.
EMAIL, NO_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", r"(?i)(\.png$|\.jpg$|example\.|^sentry)"
PHONE, PHONE_DIGITS = r"(?<!\d)(?:\+31[\s\-]?\(?0?\)?[\s\-]?|0)(?:\d[\s\-]?){8,10}\d(?!\d)", (9, 12)
LANGUAGES = r"(?i)/(?:nl-nl|en-gb|en-us|de-de|nl|en|de|fr)(?=/|$)"

_SPACE_LIKE = str.maketrans({c: " " for c in "-_'’"})
_ASCII_JUNK = re.compile(r"[^a-z0-9 ]")


def slug_text(text: str | None) -> str:
    """Lower-case letters and digits without accents; space - _ ' ’ part words, anything else vanishes."""
    if not text:
        return ""
    folded = text.translate(_SPACE_LIKE)
    if folded.isascii():
        kept = _ASCII_JUNK.sub("", folded.lower())
    else:
        marks = unicodedata.normalize("NFD", folded)
        letter = lambda c: ord(c) <= 0xFFFF and (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")
        kept = "".join(c if c == " " else c.lower() for c in marks if c == " " or letter(c))
    return " ".join(kept.split())


@pandas_udf(StringType())
def _slug_of_others(text: pd.Series) -> pd.Series:
    return text.map(slug_text, na_action="ignore")


def _latin() -> tuple[str, str]:
    """What becomes of the characters of Latin texts in a slug, as two strings for translate: those beyond the second one's end vanish."""
    one, none = {}, []
    for c in map(chr, [*range(0x250), *range(0x2000, 0x2070), 0x20AC]):
        made = " " if c == " " else slug_text(f"x{c}x")[1:-1]
        if not made:
            none.append(c)
        elif made != c:
            one[c] = made
    return "".join([*one, *none]), "".join(one.values())


#: Texts of no other characters are folded by built-in functions: Latin letters with and without marks, general punctuation, the euro sign.
LATIN_ONLY = "^[\\x{0}-\\x{24F}\\x{2000}-\\x{206F}\\x{20AC}]*$"
_FROM, _TO = _latin()


def latin_slug(text: Column) -> Column:
    """slug_text of texts that are LATIN_ONLY, by built-in functions only, so also inside arrays."""
    return F.trim(F.regexp_replace(F.translate(text, _FROM, _TO), " +", " "))


def slug(text: Column | str) -> Column:
    """slug_text of a column. Latin texts stay with the built-in functions; only the others are sent to Python."""
    given = F.col(text) if isinstance(text, str) else text
    ascii_only, latin = F.octet_length(given) == F.char_length(given), given.rlike(LATIN_ONLY)
    kept = F.regexp_replace(F.translate(F.lower(given), "-_'", "   "), "[^a-z0-9 ]", "")
    built_in = F.when(ascii_only, F.trim(F.regexp_replace(kept, " +", " "))).when(latin, latin_slug(given))
    return F.coalesce(built_in, _slug_of_others(F.when(~ascii_only & ~latin, given)), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_unknown(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("", UNKNOWN.lower()), F.lit(True))


def collapse(text: Column) -> Column:
    """White space of any kind becomes single spaces, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s ]+", " "))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)


def strip_years(text: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\b(19|20)\d{2}\b", " "))


def tokens(slugged: Column) -> Column:
    return F.filter(F.split(slugged, " "), lambda t: t != "")


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard likeness of the token sets of two slugs; 0 if either has none."""
    both, either = F.array_intersect(tokens(a), tokens(b)), F.array_union(tokens(a), tokens(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.size(both) / F.greatest(F.size(either), F.lit(1)))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance of two slugs over the longer one's length; two empty ones are alike."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


# Fixed values. Letters from which words may differ, their least likeness then, letters of a name that may be contained, and what containing it is worth.
LONG_WORD, NEAR_WORD, LONG_NAME, CONTAINED = 5, 0.80, 8, 0.75


def words(text: Column | str) -> Column:
    """The words of a name in order, without years."""
    given = F.col(text) if isinstance(text, str) else text
    return tokens(slug(strip_years(given)))


def words_match(a: Column, b: Column) -> Column:
    """Whether two words are the same but for an ending, a part or a fifth of their letters."""
    long = F.least(F.char_length(a), F.char_length(b)) >= LONG_WORD
    near = 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1)) >= NEAR_WORD
    return (a == b) | (long & (F.contains(a, b) | F.contains(b, a) | near))


def paired(a: Column, b: Column) -> Column:
    """How many words of list a, in order, find a word of list b of their own: the first left that matches. The state of the fold is the words left and the count."""
    start = F.struct(b.alias("left"), F.lit(0).alias("n"))

    def step(state: Column, word: Column) -> Column:
        left, n = state["left"], state["n"]
        at = F.array_position(F.transform(left, lambda other: words_match(word, other)), True)
        rest = F.filter(left, lambda _, i: i + 1 != at)
        return F.struct(rest.alias("left"), (n + F.when(at > 0, 1).otherwise(0)).alias("n"))

    return F.aggregate(a, start, step, lambda state: state["n"])


def words_alike(a: Column, b: Column, found: Column | None = None) -> Column:
    """Words of two lists that are paired one to one with tolerance, over all words of both; 0 if either has none. found: paired(a, b), if it is known."""
    found = paired(a, b) if found is None else found
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(found / F.greatest(F.size(a) + F.size(b) - found, F.lit(1)))


def words_contained(a: Column, b: Column, found: Column | None = None, back: Column | None = None) -> Column:
    """CONTAINED if each word of the shorter list (a if both are as long) has a match of its own in the longer one and has letters enough together; else 0.

    found and back: paired(a, b) and paired(b, a), if they are known.
    """
    first = F.size(a) <= F.size(b)
    few, many = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    letters = F.char_length(F.array_join(few, ""))
    whole = paired(few, many) if found is None else F.when(first, found).otherwise(back)
    return F.when((F.size(few) > 0) & (letters >= LONG_NAME) & (whole == F.size(few)), CONTAINED).otherwise(0.0)


def alike_by_counts(a: str, b: str, found: str) -> Column:
    """words_alike by columns of numbers: the words of both lists and those that are paired; null if these aren't known."""
    return F.when(F.col(found).isNull(), None).when((F.col(a) == 0) | (F.col(b) == 0), 0.0).otherwise(F.col(found) / F.greatest(F.col(a) + F.col(b) - F.col(found), F.lit(1)))


def contained_by_counts(a: str, b: str, a_letters: str, b_letters: str, found: str, back: str) -> Column:
    """words_contained by columns of numbers: words and letters of both lists, paired(a, b) and paired(b, a)."""
    first = F.col(a) <= F.col(b)
    few, letters, whole = (F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in ((a, b), (a_letters, b_letters), (found, back)))
    return F.when((few > 0) & (letters >= LONG_NAME) & (whole == few), CONTAINED).otherwise(0.0)


def fuzzy_token_similarity(a: Column | str, b: Column | str) -> Column:
    """Words of two names paired one to one with tolerance, over all words of both; years don't count."""
    return words_alike(words(a), words(b))


def containment(a: Column | str, b: Column | str) -> Column:
    """0.75 if each word of the shorter name, of 8 letters at least, has its own match in the longer one; else 0."""
    return words_contained(words(a), words(b))


def find_email(text: Column) -> Column:
    """The first address in a text; null if there is none or it is a picture's name or a placeholder."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), EMAIL, 0)
    return F.when((found != "") & ~found.rlike(NO_EMAIL), found)


def find_phone(text: Column, whole: bool = True) -> Column:
    """The first Dutch phone number of 9 to 12 digits; null without one. A longer run of digits holds none, unless whole is false: then its beginning may be one."""
    fits = lambda m: F.char_length(F.regexp_replace(m, r"\D", "")).between(*PHONE_DIGITS)
    return collapse_null(F.get(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHONE if whole else PHONE.removesuffix(r"(?!\d)")), F.lit(0)), fits), F.lit(0)))


def collapse_null(text: Column) -> Column:
    return F.when(text.isNotNull(), collapse(text))


def stable_id(*slugs_and_times: Column) -> Column:
    """16 hex digits that identify an activity: its slugged name, date, time, village and place."""
    parts = [F.coalesce(c, F.lit("")) for c in slugs_and_times]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def registry_id(source_id: Column) -> Column:
    """An id without its page part: the first two of the parts between colons."""
    return F.substring_index(F.lower(F.trim(F.coalesce(source_id, F.lit("")))), ":", 2)


def host_of(url: Column) -> Column:
    """Lower-case host without www. and port; empty for what is no address."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def without_language(path: Column) -> Column:
    """A path without segments that name a language and without slashes at its end."""
    return F.regexp_replace(F.regexp_replace(path, r"/+$", ""), LANGUAGES, "")


def word_likeness(a: Column | str, b: Column | str) -> Column:
    """The larger one of fuzzy_token_similarity and containment."""
    p, q = words(a), words(b)
    return F.greatest(words_alike(p, q), words_contained(p, q))
