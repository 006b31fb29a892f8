"""Score expressions: normalisation to 0-100, bands, priors, decay."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letter grades and words that are no score.
LETTERS = {"A+": 97, "A": 93, "A-": 90, "B+": 87, "B": 83, "B-": 80, "C+": 77, "C": 73, "C-": 70, "D+": 67, "D": 63, "D-": 60, "F": 50}
UNSCORED = [
    "N/A", "TBD", "UNSCORED", "-", "", "NA", "NONE", "NO SCORE", "RECOMMENDED", "NOT RECOMMENDED", "YES", "NO", "BUY", "BUY IT", "DON'T BUY", "SKIP", "SKIP IT", "ESSENTIAL", "MUST-PLAY", "MUST PLAY", "AVOID",
    "WORTH PLAYING", "WORTH IT", "NOT WORTH IT", "EDITORS' CHOICE", "EDITOR'S CHOICE", "EDITORS CHOICE", "PLATINUM", "GOLD", "SILVER", "BRONZE", "THUMBS UP", "THUMBS DOWN",
]
#: Bands of the share of positive votes.
BANDS = [(95, "Overwhelmingly Positive"), (80, "Very Positive"), (70, "Mostly Positive"), (40, "Mixed"), (20, "Mostly Negative"), (None, "Overwhelmingly Negative")]
#: Fixed values of the trend score: half-life, weights by age in days, boosts from (mentions, sources) on.
HALF_LIFE_HOURS = 24
AGE_WEIGHTS = [(120, 1.0), (180, 0.75), (365, 0.25), (730, 0.2), (1825, 0.15), (None, 0.1)]
BOOSTS = [(10, 5, 0.15), (16, 6, 0.2)]
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """A plain decimal number; null for what only one language's parser would take."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def normalize(raw: Column, scale: Column) -> Column:
    """struct<score double, scale string> of a raw score on 0-100, rounded to 2 digits; both null if it is none.

    Letters, percentages and fractions first; then numbers, by the given scale
    (a value above it but at most 100 is taken as a percentage) or by the
    scale that the value suggests.
    """
    text = F.upper(F.trim(raw))
    letters = F.create_map(*[F.lit(x) for k, v in LETTERS.items() for x in (k, float(v))])
    two = lambda x: F.round(x, 2)
    found = lambda score, scale: F.struct(score.cast("double").alias("score"), scale.cast("string").alias("scale"))
    none = found(F.lit(None), F.lit(None))
    percent = number(F.regexp_extract(text, r"^(.*)%$", 1))
    fraction = r"^([\d.]+)\s*/\s*([\d.]+)$"
    top, bottom = number(F.regexp_extract(text, fraction, 1)), number(F.regexp_extract(text, fraction, 2))
    value, given = number(text), number(F.trim(scale))
    shown = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    guess = detect_scale(value)
    by_guess = two(F.least(value * F.create_map(F.lit("5"), F.lit(20.0), F.lit("10"), F.lit(10.0), F.lit("20"), F.lit(5.0), F.lit("100"), F.lit(1.0))[guess], F.lit(100.0)))
    by_scale = F.when((value >= 0) & (value <= given), found(two(value / given * 100), shown(given))).when((value > given) & (value >= 0) & (value <= 100), found(two(value), F.lit("100"))).otherwise(none)
    return (
        F.when(text.isNull() | text.isin(*UNSCORED), none)
        .when(F.try_element_at(letters, text).isNotNull(), found(F.try_element_at(letters, text), F.lit("letter")))
        .when(percent.isNotNull(), found(two(percent), F.lit("100")))
        .when(bottom > 0, found(two(F.try_divide(top, bottom) * 100), shown(bottom)))
        .when(value.isNull(), none)
        .when(given > 0, by_scale)
        .otherwise(found(by_guess, guess))
    )


def detect_scale(value: Column) -> Column:
    return F.when(value > 20, "100").when(value > 10, "20").when(value > 5, "10").otherwise("5")


def corrected(raw: Column, scale: Column, stored: Column) -> Column:
    """struct<score, corrected>: the score recomputed from its raw form where that works."""
    again = normalize(raw, scale)["score"]
    return F.struct(F.coalesce(again, stored).alias("score"), (again.isNotNull() & ~again.eqNullSafe(stored)).alias("corrected"))


def positive_share(positive: Column, negative: Column) -> Column:
    return F.round(F.try_divide(positive.cast("double"), positive + negative) * 100, 2)


def tenfold(score: Column) -> Column:
    return F.round(score * 10, 2)


def ladder(value: Column, bands: list[tuple]) -> Column:
    """The first band whose bound the value reaches; the last has none."""
    out = F.lit(bands[-1][1])
    for bound, name in reversed(bands[:-1]):
        out = F.when(value >= bound, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def vote_band(score: Column) -> Column:
    return ladder(score, BANDS)


def disparity_band(d: Column) -> Column:
    return ladder(F.abs(d), [(15, "extreme"), (10, "high"), (5, "moderate"), (None, "low")])


def leaning(d: Column) -> Column:
    return F.when(d >= 5, "generous").when(d <= -5, "critical").when(d.isNotNull(), "aligned")


def known(score: Column) -> Column:
    """Providers write negative numbers where there is no score."""
    return F.when(score >= 0, score)


def staff_id(author: Column, outlet: Column) -> Column:
    """The author, or the outlet's stand-in member where there is none."""
    return F.coalesce(author.cast("long"), -(F.lit(1_000_000_000).cast("long") + outlet))


def recommendation(kind: Column, name: Column, base: Column) -> Column:
    """Whether a score format is a recommendation and no number."""
    words = F.lower(F.concat_ws(" ", kind, name))
    return F.coalesce(words.rlike(r"recommend|yes/no|thumb|verdict|binary"), F.lit(False)) | base.isNull() | base.isin(0, 1)


def decay(hours: Column) -> Column:
    return F.exp(F.lit(-math.log(2)) * F.greatest(hours, F.lit(0.0)) / HALF_LIFE_HOURS)


def news_score(weighted: Column, sources: Column, momentum: Column) -> Column:
    return weighted + F.least(sources, F.lit(5)) * 0.35 + F.greatest(F.lit(0.0), F.least(F.lit(2.5), momentum * 0.4))


def age_weight(age_days: Column, mentions: Column, sources: Column) -> Column:
    """What an item's age takes from its trend score; null and future ages take nothing."""
    weight = F.lit(AGE_WEIGHTS[-1][1])
    for days, w in reversed(AGE_WEIGHTS[:-1]):
        weight = F.when(age_days <= days, F.lit(w)).otherwise(weight)
    for n, m, boost in BOOSTS:
        weight = weight + F.when((age_days > AGE_WEIGHTS[0][0]) & (mentions >= n) & (sources >= m), boost).otherwise(0.0)
    return F.when(age_days.isNull() | (age_days <= AGE_WEIGHTS[0][0]), 1.0).otherwise(F.least(weight, F.lit(1.0)))


def quality_prior(reviews: Column, critic: Column, user_a: Column, user_b: Column) -> Column:
    zero = F.lit(0.0)
    users = F.greatest(F.coalesce(user_a, zero), F.coalesce(user_b, zero))
    score = F.least(F.coalesce(reviews, zero) / 150, F.lit(1.0)) * 0.35 + F.least(F.greatest(F.coalesce(critic, zero), zero), F.lit(100.0)) / 100 * 0.35 + users / 100 * 0.30
    return F.greatest(zero, F.least(F.lit(1.0), score))


def confidence_band(score: Column) -> Column:
    return ladder(score, [(0.82, "high"), (0.70, "medium"), (None, "low")])


def share_of(value: Column, divisor: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / F.lit(float(divisor))))


def quantized(score: Column) -> Column:
    """Within 0..1, to four digits, half up."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def derived_score(critic: Column, disparity: Column) -> Column:
    """The users' score that a disparity was taken from; null if either is unknown."""
    return critic - disparity
