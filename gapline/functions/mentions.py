"""How a title stands in a text: followed by a sequel's number, only referred to, ambiguous, near telling words.

Texts and titles are arrays of normalised words; word lists are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .titles import let

#: Words behind and before a title, and phrases before it, that make it a mere reference.
REFERENCE_SUFFIX = ["inspired", "like"]
REFERENCE_PREFIX = ["channeling", "channels", "echoes", "echoing", "evokes", "evoking", "like", "meets"]
REFERENCE_PHRASES = ["fan of", "fans of", "homage to", "inspired by", "similar to", "spiritual successor to", "successor to", "tribute to"]
PREPOSITIONS = ["at", "by", "for", "from", "in", "into", "of", "on", "to", "with", "without"]
#: A short title's letters, how often a word of one or two may stand in titles, how far context reaches.
SHORT_TITLE, OFTEN_ONE, OFTEN_TWO, NEAR = 5, 1, 10, 3
_SEQUEL = "^([2-9]|1[0-9]|20)$"
_NUMERAL = r"^(\d+|[ivxlcdm]+)$"


def normalized(text: Column) -> Column:
    """Lower-case words; curly quotes, ordinals and possessives made plain."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[’‘]", "'")
    out = F.regexp_replace(F.regexp_replace(out, r"\b(\d+)(st|nd|rd|th)\b", "$1"), r"\b([a-z0-9]+)'s\b", "$1")
    return F.trim(F.regexp_replace(F.replace(out, F.lit("'"), F.lit("")), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(normalized(text), " "), lambda w: w != "")


def places(text: Column, title: Column) -> Column:
    """Where a title's words stand next to each other, from 1."""
    n = F.size(title)
    fits = (F.size(text) >= n) & (n > 0)
    first = let(F.get(title, F.lit(0)), lambda w: spots(text, w))
    return F.when(fits, F.filter(first, lambda i: (n == 1) | (F.slice(text, i, n) == title))).otherwise(F.expr("cast(array() as array<int>)"))


def spots(text: Column, word: Column) -> Column:
    """Where a word stands, from 1."""
    return F.coalesce(F.array_compact(F.transform(text, lambda w, i: F.when(w == word, i + 1))), F.expr("cast(array() as array<int>)"))


def _at(text: Column, i: Column) -> Column:
    """The word at ``i``, from 1; empty beyond the ends."""
    return F.coalesce(F.get(text, i - 1), F.lit(""))


def sequel_follows(text: Column, title: Column) -> Column:
    return F.exists(places(text, title), lambda i: _at(text, i + F.size(title)).rlike(_SEQUEL))


def numbered(text: Column) -> Column:
    """The words that a sequel's number stands behind; only titles that end with one of them are followed by one."""
    return F.array_distinct(F.filter(text, lambda _, i: _at(text, i + 2).isin(*map(str, range(2, 21)))))


def only_referred_to(text: Column, title: Column) -> Column:
    """Whether every place of a title of several words is a comparison with it."""
    def referred(i: Column) -> Column:
        before = F.array_join(F.slice(text, F.greatest(F.lit(1), i - 3), F.least(i - 1, F.lit(3))), " ")
        return _at(text, i + F.size(title)).isin(*REFERENCE_SUFFIX) | ((i > 1) & _at(text, i - 1).isin(*REFERENCE_PREFIX)) | before.rlike(f"(^| )({'|'.join(REFERENCE_PHRASES)})$")

    # Titles of one word, which are most, are not looked for.
    return F.when(F.size(title) >= 2, let(places(text, title), lambda found: (F.size(found) > 0) & F.forall(found, referred))).otherwise(False)


def primary_word(title: Column, stop: list[str]) -> Column:
    telling = F.filter(title, lambda w: ~w.isin(*stop))
    return F.coalesce(F.get(telling, F.lit(0)), F.get(title, F.lit(0)))


def ambiguous(title: Column, often: Column, common: list[str], stop: list[str]) -> Column:
    """Whether a title collides with plain prose: one common, short or repeated word, or two common or very frequent ones.

    ``often`` is how many titles its most frequent telling word stands in.
    """
    def judged(telling: Column) -> Column:
        one = F.get(telling, F.lit(0))
        single = (F.size(telling) == 1) & ~one.rlike(_NUMERAL) & (one.isin(*common) | (F.length(one) <= SHORT_TITLE) | (often > OFTEN_ONE))
        return single | ((F.size(telling) == 2) & (F.forall(telling, lambda w: w.isin(*common)) | (often > OFTEN_TWO)))

    return F.coalesce(let(F.filter(title, lambda w: ~w.isin(*stop)), judged), F.lit(False))


def risky(title: Column, common: list[str], stop: list[str]) -> Column:
    """A title of one common or short word, whatever others have."""
    def judged(telling: Column) -> Column:
        one = F.get(telling, F.lit(0))
        return (F.size(telling) == 1) & ~one.rlike(_NUMERAL) & (one.isin(*common) | (F.length(one) <= SHORT_TITLE))

    return F.coalesce(let(F.filter(title, lambda w: ~w.isin(*stop)), judged), F.lit(False))


def near_context(text: Column, word: Column, context: list[str], at: Column | None = None) -> Column:
    """Whether a telling word or a number stands within NEAR words of ``word``, where no preposition touches it; ``at`` are its spots, if known."""
    def telling(i: Column) -> Column:
        around = F.concat(F.slice(text, F.greatest(F.lit(1), i - NEAR), F.least(i - 1, F.lit(NEAR))), F.slice(text, i + 1, F.lit(NEAR)))
        touched = _at(text, i - 1).isin(*PREPOSITIONS) & (i > 1) | _at(text, i + 1).isin(*PREPOSITIONS)
        return ~touched & F.exists(around, lambda w: w.isin(*context) | w.rlike(_NUMERAL))

    return F.exists(spots(text, word) if at is None else at, telling)


def other_word_before(text: Column, word: Column, allowed: list[str], at: Column | None = None) -> Column:
    """Whether ``word`` somewhere ends a longer phrase: a word that isn't ``allowed``, nor a number, stands before it; ``at`` are its spots, if known."""
    return F.exists(spots(text, word) if at is None else at, lambda i: (i > 1) & ~_at(text, i - 1).isin(*allowed) & ~_at(text, i - 1).rlike(_NUMERAL))


def generic_lead(text: Column, word: Column, followups: list[str]) -> Column:
    return (F.size(text) >= 2) & (_at(text, F.lit(1)) == word) & _at(text, F.lit(2)).isin(*followups)


def adjustment(text: Column, title: Column, primary: Column, is_ambiguous: Column, is_risky: Column, lists: dict[str, list[str]], headline: bool, followed: Column, at: Column) -> Column:
    """What a headline's or description's flags add to a candidate's score; ``followed`` are the text's ``numbered`` words, ``at`` an ambiguous title's spots of ``primary``."""
    a, b, c, d, e = (-130, -140, 25, -130, -140) if headline else (-100, -110, 15, 0, -110)
    last = F.get(title, F.size(title) - 1)
    sequel = F.when(F.array_contains(followed, last) & sequel_follows(text, title), F.when(last.rlike(_SEQUEL), c).otherwise(b)).otherwise(0)
    lead = F.when(is_ambiguous & generic_lead(text, primary, lists["followups"]) & primary.isin(*lists["common"]), d).otherwise(0)
    phrase = F.when(is_ambiguous & is_risky & other_word_before(text, primary, [*lists["stop"], *PREPOSITIONS, *lists["followups"], *lists["context"]], at), e).otherwise(0)
    return F.when(only_referred_to(text, title), a).otherwise(0) + sequel + lead + phrase


def numeral_variants(title: Column, romans: list[str]) -> Column:
    """The title's words as text, with each numeral to twenty in figures or as a roman numeral, in every combination."""
    table = F.array(*map(F.lit, romans))

    def ways(w: Column) -> Column:
        at = F.array_position(table, w)
        figure = w.rlike("^([1-9]|1[0-9]|20)$")
        return F.when(at > 0, F.array(w, at.cast("string"))).when(figure, F.array(w, F.get(table, w.try_cast("int") - 1))).otherwise(F.array(w))

    start = F.expr("array(cast(array() as array<string>))")
    every = F.aggregate(words(title), start, lambda acc, w: F.flatten(F.transform(acc, lambda a: F.transform(ways(w), lambda v: F.array_append(a, v)))))
    return F.array_distinct(F.transform(every, lambda a: F.array_join(a, " ")))


def segments_match(text: Column, title: Column) -> Column:
    """Whether the parts of a title around its colons stand in a text in order, whatever is between; null for titles without two parts."""
    parts = F.filter(F.transform(F.split(title, ":"), normalized), lambda p: F.length(p) >= 3)
    pattern = F.concat(F.lit("(^| )"), F.array_join(parts, "( |$).*?(^| )"), F.lit("( |$)"))
    return F.when(F.size(parts) >= 2, F.regexp(normalized(text), pattern))
