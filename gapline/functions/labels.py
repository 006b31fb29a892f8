"""Label and payload expressions: tokens, lists, links, JSON values, vectors as text."""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .titles import let

#: Tokens that are shown in capitals of their own.
SPECIALS = {"rpg": "RPG", "mmo": "MMO", "pvp": "PvP", "pvpve": "PvPvE"}
#: Keys under which an object's name is looked for, in turn.
NAME_KEYS = ("description", "name", "title", "label", "value", "displayName", "slug")
#: Beginnings that tell a shop's phrases from metadata, and the longest value kept.
SHOP_PHRASES = ("released on", "release date", "available on", "wishlist", "add to")
LONGEST_VALUE, LONGEST_URL = 120, 2048
#: Fixed values of the 32-bit FNV-1a hash.
FNV_START, FNV_PRIME = 2166136261, 16777619
_NONE = "cast(array() as array<string>)"


def plain_label(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, & as and, apostrophes gone; what ``titles.ascii_label`` gives for ASCII."""
    out = F.replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def token(text: Column) -> Column:
    return F.replace(plain_label(text), F.lit(" "), F.lit("_"))


def provenance(text: Column) -> Column:
    """source/field, each as a token; empty if either is."""
    source, field = token(F.split_part(text, F.lit("/"), F.lit(1))), token(F.regexp_extract(text, "^[^/]*/(.*)$", 1))
    both = F.when((source != "") & (field != ""), F.concat(source, F.lit("/"), field)).otherwise("")
    return F.when(F.contains(text, F.lit("/")), both).otherwise(token(text))


def shown(tok: Column) -> Column:
    """A token as a reader sees it: capital words, SPECIALS as they are."""
    specials = F.create_map(*[F.lit(x) for kv in SPECIALS.items() for x in kv])
    parts = F.filter(F.split(tok, "_"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(specials, p), F.initcap(p))), " ")


def human_list(values: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(values)
    long = F.concat(F.array_join(F.slice(values, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(values, -1))
    return F.when(n <= 0, "").when(n <= 2, F.array_join(values, " and ")).otherwise(long)


def distinct_labels(values: Column) -> Column:
    """Trimmed values without empty ones; of those that differ in case only, the first."""
    start = F.struct(F.expr(_NONE).alias("seen"), F.expr(_NONE).alias("kept"))

    def add(s: Column, v: Column) -> Column:
        mark = F.lower(v)
        new = (mark != "") & ~F.array_contains(s["seen"], mark)
        return F.struct(F.when(new, F.array_append(s["seen"], mark)).otherwise(s["seen"]).alias("seen"), F.when(new, F.array_append(s["kept"], v)).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(F.transform(values, lambda v: F.trim(v)), start, add, lambda s: s["kept"])


def ordered_union(a: Column, b: Column) -> Column:
    """Values of ``a``, then those of ``b`` that it lacks, in order."""
    return F.array_distinct(F.concat(a, b))


def metadata_values(text: Column) -> Column:
    """The values of a line of metadata, parted at bullets, commas, slashes and spaced bars; years, single characters and shop phrases gone."""
    parts = F.transform(F.split(text, r"[•,/]|\s+\|\s+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))

    def kept(p: Column) -> Column:
        low = F.lower(p)
        phrase = low.startswith(SHOP_PHRASES[0])
        for s in SHOP_PHRASES[1:]:
            phrase = phrase | low.startswith(s)
        return (F.length(p) <= LONGEST_VALUE) & ~phrase & ~p.rlike(r"^\d{4}$") & ((F.length(p) > 1) | (low == "x"))

    return distinct_labels(F.filter(parts, kept))


def tag_texts(html: Column, pattern: str) -> Column:
    """What stands in the elements that ``pattern`` (one group) finds: inner tags gone, single spaces, repeats in other case left out."""
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return distinct_labels(F.transform(found, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " "))))


def image_url(*candidates: Column) -> Column:
    """The first candidate that is a remote link of bounded length; ``//host`` counts as https."""
    def usable(url: Column) -> Column:
        url = F.trim(url)
        url = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
        return F.when(F.lower(url).rlike("^https?://") & (F.length(url) <= LONGEST_URL), url)

    return F.coalesce(*map(usable, candidates))


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three of them dots where something is cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def digits(text: Column) -> Column:
    """The number made of all digits of a text; null without any."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("long")


def achievements(details: Column) -> Column:
    return digits(F.get_json_object(details, "$.achievements.total"))


def match_payload(payload: Column, most: int = 3) -> Column:
    """struct<reasons, confidence> of a stored explanation, the first ``most`` reasons."""
    read = F.from_json(payload, "match_reasons array<string>, confidence string")
    return F.struct(F.slice(F.coalesce(read["match_reasons"], F.expr(_NONE)), 1, most).alias("reasons"), read["confidence"].alias("confidence"))


def fnv32(text: Column) -> Column:
    """FNV-1a over the code points, 8 hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(FNV_START).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(FNV_PRIME), F.lit(1 << 32)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def vector_text(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def parsed_vector(text: Column) -> Column:
    """An array of doubles from ``[1,2.5]``; null if a part is no number."""
    parts = F.transform(F.filter(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda p: p != ""), lambda p: p.try_cast("double"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def names_in(value: Any) -> list[str]:
    """Names in a JSON value: strings, parted at commas and slashes; objects by NAME_KEYS; lists one by one."""
    if isinstance(value, str):
        return [p.strip() for p in re.split("[,/]", value) if p.strip()]
    if isinstance(value, dict):
        whole = next((value[k].strip() for k in NAME_KEYS if isinstance(value.get(k), str) and value[k].strip()), None)
        return [whole] if whole else [n for k in NAME_KEYS if k in value for n in names_in(value[k])]
    return [n for v in value for n in names_in(v)] if isinstance(value, list) else []


@F.arrow_udf(T.ArrayType(T.StringType()))
def json_names(values: pa.Array) -> pa.Array:
    """``names_in`` of JSON texts of any form; other text is a name itself, unless it begins like an object or a list."""
    def one(text: str | None) -> list[str]:
        try:
            return names_in(json.loads(text)) if text else []
        except ValueError:
            return [] if text.lstrip()[:1] in ("{", "[") else names_in(text)

    return pa.array(map(one, values.to_pylist()), pa.list_(pa.string()))


def search_queries(title: Column, splits: bool = True) -> Column:
    """Ways to look a title up, in order: itself, delta as a sign or word, its halves, without chapter and edition endings.

    Without ``splits`` the halves are left out, as they would match other titles wholly.
    """
    chapter = r"(?i)\s*[:\-]?\s*(chapters?\s+\d+(\s*(&|and|,)\s*\d+)*.*|episode\s+\d+.*)$"
    edition = r"(?i)\s*[:\-]?\s*(collection|bundle|pack|anthology|compilation|(complete|definitive|deluxe|ultimate|gold|goty|game\s+of\s+the\s+year)\s+edition)\s*$"
    halves = []
    for sign in (":", " - ", " – ", " — "):
        at = F.instr(title, sign)
        halves += [F.when(at > 0, F.left(title, at - 1)), F.when(at > 0, F.substr(title, at + len(sign)))]
    every = [title, F.when(title.rlike(r"(?i)\bdelta\b"), F.regexp_replace(title, r"(?i)\bdelta\b", "Δ")), F.when(F.contains(title, F.lit("Δ")), F.replace(title, F.lit("Δ"), F.lit("Delta"))), *(halves if splits else []), F.regexp_replace(title, chapter, ""), F.regexp_replace(title, edition, "")]
    trimmed = F.transform(F.array_compact(F.array(*every)), lambda v: F.trim(v))
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


#: Words that end or rule out a title in a headline; a list of our own can be given instead.
HEADLINE_BREAKS = ["review", "trailer", "gets", "is", "adds", "reveals", "announced", "release", "update", "patch", "launches", "has", "will", "and", "with"]
HEADLINE_STARTS = ["how", "why", "what", "the", "this", "when", "where", "who"]
HEADLINE_REJECTS = ["deal", "deals", "sale", "guide", "podcast", "movie", "film"]
HEADLINE_MINOR = ["of", "the", "and", "in", "to", "a", "for", "on"]
_ROMAN = "^[ivxlcdm]+$"


def inferred_title(headline: Column, breaks: list[str] = HEADLINE_BREAKS, starts: list[str] = HEADLINE_STARTS, rejects: list[str] = HEADLINE_REJECTS, minor: list[str] = HEADLINE_MINOR, most: int = 8) -> Column:
    """The title that a headline seems to begin with: its words up to the first of ``breaks``, two to ``most``; null if it is doubtful."""
    words = F.filter(F.split(F.regexp_replace(F.lower(headline), "[^a-z0-9]+", " "), " "), lambda w: (w != "") & (w != "s"))

    def of(w: Column) -> Column:
        cut = F.array_min(F.filter(F.transform(w, lambda x, i: F.when((i > 0) & x.isin(*breaks), i)), lambda i: i.isNotNull()))
        head = F.slice(w, F.lit(1), F.coalesce(cut, F.size(w)))
        last = F.coalesce(F.array_max(F.transform(head, lambda x, i: F.when(~x.isin(*minor), i + 1))), F.lit(0))
        return let(F.slice(head, F.lit(1), F.least(last, F.lit(most))), lambda some: F.when(
            (F.size(some) >= 2) & ~F.element_at(some, 1).isin(*starts) & ~F.element_at(some, 1).rlike(r"^\d+$") & ~F.exists(some, lambda x: x.isin(*rejects)),
            F.array_join(F.transform(some, lambda x, i: F.when(x.rlike(_ROMAN), F.upper(x)).when((i > 0) & x.isin(*minor), x).otherwise(F.initcap(x))), " "),
        ))

    return let(words, of)
