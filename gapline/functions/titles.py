"""Title and text expressions: normal forms, keys, variants; Arrow functions where the JVM has no equal."""

from __future__ import annotations

import difflib
import html
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that tell no topic.
STOP = ["the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "at", "by", "from", "new", "game", "games", "review", "trailer", "news", "update", "how", "why", "what", "this", "that"]
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx"]
#: Endings that tell editions of one title apart.
EDITIONS = ["edition", "remastered", "definitive", "complete", "goty", "game of the year"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once, however often the body or functions in it name it."""
    return F.transform(F.array(value), body)[0]


def normalized_title(title: Column) -> Column:
    """Lower-case, colons and dashes to spaces, edition endings and trademark signs gone, single spaces."""
    out = F.regexp_replace(F.regexp_replace(F.trim(F.lower(title)), r"\s*:\s*", " "), r"\s*-\s*", " ")
    for ending in EDITIONS:
        out = F.regexp_replace(out, rf"\s+{ending}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[™®©]", ""), r"\s+", " "))


def variant_key(title: Column) -> Column:
    """What editions of one title share."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " ")), r"( (edition|remastered|definitive|complete|goty|deluxe|ultimate|gold))+$", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def search_match(column: Column, query: str) -> Column:
    """Case-blind containment, or containment of what is left without all but letters and digits."""
    plain = "".join(c for c in query.lower() if c.isascii() and c.isalnum())
    found = F.lower(column).contains(query.lower())
    return found | compact(column).contains(plain) if plain else found


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), "&", " and "), "['’]", ""), "[^a-z0-9]+", "-").try_cast("string").alias("slug")


def trimmed_slug(text: Column) -> Column:
    return F.regexp_replace(slug(text), "^-+|-+$", "")


def clean_headline(title: Column, source: Column) -> Column:
    """A headline without its source's name at the end; 'Untitled' if nothing is left."""
    name = F.concat(F.lit(r"(?i)\s*(-|\||:|–|—)\s*\Q"), F.trim(source), F.lit(r"\E\s*$"))
    bare = F.when(F.length(F.trim(source)) > 0, F.regexp_replace(title, name, "")).otherwise(title)
    out = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(F.coalesce(out, F.lit("")) == "", "Untitled").otherwise(out)


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def arabic(word: Column) -> Column:
    """Roman numerals to 20 as digits, leading zeros gone."""
    place = F.array_position(F.array(*map(F.lit, ROMAN)), word)
    return F.when(place > 0, place.cast("string")).when(word.rlike(r"^\d+$"), F.regexp_replace(word, r"^0+(?=\d)", "")).otherwise(word)


def topic_key(title: Column) -> Column:
    """The first three telling words of a title."""
    def first_three(every: Column) -> Column:
        telling = F.filter(every, lambda w: ~w.isin(*STOP) & ((F.length(w) > 2) | w.rlike(r"^\d+$") | w.isin(*ROMAN)))
        return F.transform(F.slice(F.when(F.size(telling) > 0, telling).otherwise(every), 1, 3), arabic)

    kept = let(words(title), first_three)
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise("untitled")


def content_words(text: Column) -> Column:
    """Words of more than one letter that aren't in STOP."""
    return F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(*STOP))


def strip_html(text: Column, most: int | None = None) -> Column:
    """Tags gone, the five basic entities and numbers decoded by the JVM, single spaces; cut to ``most`` characters where that is given, as for descriptions (8000)."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return bare if most is None else F.substring(bare, 1, most)


@F.arrow_udf(T.StringType())
def unescaped(texts: pa.Array) -> pa.Array:
    """All HTML entities decoded."""
    return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def ascii_label(labels: pa.Array) -> pa.Array:
    """A label's plain form: accents gone, lower-case, & as and, other signs as spaces."""
    def one(text: str | None) -> str:
        plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower().replace("&", " and ").replace("'", "")
        return " ".join("".join(c if c.isalnum() else " " for c in plain).split())

    return pa.array(map(one, labels.to_pylist()), pa.string())


@F.arrow_udf(T.DoubleType())
def title_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of matching blocks of two normalised titles (Ratcliff and Obershelp); null if either is."""
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs], pa.float64())


def runs(text: Column, n: int) -> Column:
    """All runs of ``n`` words, as arrays."""
    none = F.expr("cast(array() as array<array<string>>)")
    return let(words(text), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.slice(w, i, n))).otherwise(none))


def series_markers(title: Column) -> Column:
    """Numbers in a title, roman ones too, that tell parts of a series apart; years are left out."""
    numbers = F.filter(F.transform(words(title), arabic), lambda w: w.rlike(r"^\d+$") & ~w.rlike(r"^(19|20)\d\d$"))
    return F.array_sort(F.array_distinct(numbers))


def titles_related(expected: Column, candidate: Column, similarity: Column) -> Column:
    """Whether a candidate can be the expected title: its series numbers are there, and it is similar or shares half the words."""
    a, b = words(expected), words(candidate)
    shared = F.filter(F.array_intersect(a, b), lambda w: F.length(w) >= 4)
    overlap = F.try_divide(F.size(F.array_intersect(a, b)), F.greatest(F.lit(1), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))))
    numbers = F.size(F.array_except(series_markers(expected), series_markers(candidate))) == 0
    return numbers & ((similarity >= 0.82) | ((overlap >= 0.5) & (F.size(shared) > 0)))


def slug_candidates(title: Column) -> Column:
    """Slugs under which a title may stand: plain, without connecting words, with numerals in figures, with figures as numerals."""
    romans = F.array(*map(F.lit, ROMAN))

    def of(parts: Column) -> Column:
        numeral = lambda w: F.when(w.rlike("^([1-9]|1[0-9]|20)$"), F.get(romans, w.try_cast("int") - 1)).otherwise(w)
        every = [parts, F.filter(parts, lambda w: ~w.isin("and", "the", "of", "a")), F.transform(parts, arabic), F.transform(parts, numeral)]
        return F.array_distinct(F.array(*[F.array_join(x, "-") for x in every]))

    return let(F.split(trimmed_slug(title), "-"), of)
