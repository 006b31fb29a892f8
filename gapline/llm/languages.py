"""Language identification by cross-parsing entropy.

Labelled text of each language makes a suffix automaton.  A text is parsed
against each: the longest match from where the last one ended is a phrase,
found by walking the automaton until it has no next letter.  A language that
knows the text needs few phrases; those that end within the text are counted.
Their number, times the logarithm of the automaton's text length and over the
letters of the text, estimates the cross entropy in bits a letter; the
language with the least wins.  Texts are walked in stretches of STRETCH
letters, all of a batch at once in numpy; what a parse from a stretch's
beginning gets wrong is walked again from where the stretch before ended.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, kept, merged

UNKNOWN = "und"
#: Labelled documents drawn for each language, and letters taken from each: together the bound of what is fitted.
FIT_DOCS, FIT_PIECE = 512, 320
#: Letters of all automata together; each language has an equal part.
FIT_LETTERS = 120_000
#: The least letters of an automaton: with more labels than have so many each, fitting is an error.
LEAST_LETTERS = 500
#: Texts are in no language if even the best needs more bits a letter than so many times what its own labelled pieces need
#: (an eighth more for texts of 64 letters: the fewer letters, the less certain the rate).
MAX_BITS, SHORT_MARGIN = 2.5, 1.0
#: Letters walked side by side.
STRETCH = 512
#: Letters walked at once.
BATCH = 1 << 20
#: Texts taken out of an Arrow batch at once.
ROWS = 512
GAP, OTHER = 0, 1
LAST_LETTER = 0x3FFFF


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """The automaton of all substrings of ``text``: per state, from 0, the next states by letter."""
    states: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        now = len(states)
        states.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in states[p]:
            states[p][c] = now
            p = link[p]
        if p >= 0:
            q = states[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(states)
                states.append(dict(states[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[now] = copy
                while p >= 0 and states[p].get(c) == q:
                    states[p][c] = copy
                    p = link[p]
        last = now
    return states


@cache
def _lower_letters() -> np.ndarray:
    """Per code point the lower-case letter's, or 32 if it is none; there are none above LAST_LETTER."""
    out = np.full(0x110000, 32, np.int32)
    out[: LAST_LETTER + 1] = [ord(low) if (x := chr(c)).isalpha() and len(low := x.lower()) == 1 else c if x.isalpha() else 32 for c in range(LAST_LETTER + 1)]
    return out


def letters_of(text: str | None) -> str:
    """Lower-case letters; whatever stands between them is one space."""
    if not text:
        return ""
    codes = _lower_letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    return " ".join(codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split())


@dataclass(frozen=True)
class Model:
    """The labels in order, with the text that each one's automaton is made of and the bits a letter that its labelled pieces need."""

    texts: tuple[tuple[str, str], ...]
    usual: tuple[float, ...] = ()

    def bits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text its letters, spaces between words included, and per text and label the estimated bits a letter."""
        return _walker(self).bits(texts)


def _packed(states: list[dict[str, int]], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """An automaton as one sparse table, and each state's place, by which it is known.

    The transition of a state at ``place`` on a symbol stands in the slot
    ``place + symbol`` as (place << 32 | place of the next state); what other
    states have put there tells by its own place that it is not this one's.
    States with many transitions are placed first, each at a random place
    whose slots are all free.
    """
    sizes = np.array([len(s) for s in states])
    first = np.cumsum(sizes) - sizes
    symbol = np.array([number[c] for s in states for c in s], np.int64)
    room = 1 << (2 * max(len(symbol), len(states))).bit_length()
    taken, used = np.zeros(room + len(number) + 2, bool), np.zeros(room, bool)
    place, rng = np.zeros(len(states), np.int64), np.random.default_rng(0)
    for least, most in ((33, 1 << 30), (9, 33), (3, 9), (2, 3), (0, 2)):
        todo = np.flatnonzero((sizes >= least) & (sizes < most))
        while len(todo):
            guess = rng.integers(0, room, len(todo))
            of = np.repeat(np.arange(len(todo)), sizes[todo])
            slot = guess[of] + symbol[_ranges(first[todo], sizes[todo])]
            fails = used[guess] | _again(guess)
            fails[of[taken[slot] | _again(slot)]] = True
            place[todo[~fails]] = guess[~fails]
            used[guess[~fails]], taken[slot[~fails[of]]] = True, True
            todo = todo[fails]
    table = np.full(len(taken), -1, np.int64)
    of = np.repeat(np.arange(len(states)), sizes)
    table[place[of] + symbol] = place[of] << 32 | place[np.array([to for s in states for to in s.values()], np.int64)]
    return table, place


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _again(x: np.ndarray) -> np.ndarray:
    """Whether each value has come before."""
    out = np.ones(len(x), bool)
    out[np.unique(x, return_index=True)[1]] = False
    return out


class _Walker:
    """A model's automata as sparse tables, and the parse of texts against them."""

    def __init__(self, model: Model):
        known = sorted({c for _, text in model.texts for c in text if c != " "})
        of = np.full(0x110000, OTHER, np.int32)
        of[32] = GAP
        of[[ord(c) for c in known]] = np.arange(2, len(known) + 2)
        self.symbol = of[_lower_letters()]
        number = {" ": GAP} | {c: i + 2 for i, c in enumerate(known)}
        self.tables = []
        for _, text in model.texts:
            states = suffix_automaton(text)
            table, place = _packed(states, number)
            begin = np.full(len(known) + 2, place[0])  # where a phrase that begins with a symbol goes
            begin[[number[c] for c in states[0]]] = place[list(states[0].values())]
            self.tables.append((table, begin, place[0]))
        self.logs = np.array([math.log2(len(text) + 1) for _, text in model.texts])

    def bits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        letters, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.tables)))
        begin, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if len(text or "") > BATCH:
                self._note(texts, begin, i, letters, out)
                letters[i], out[i] = self._long(text)
                begin, size = i + 1, 0
            elif size >= BATCH:
                self._note(texts, begin, i + 1, letters, out)
                begin, size = i + 1, 0
        self._note(texts, begin, len(texts), letters, out)
        return letters, out * self.logs / np.maximum(letters, 1)[:, None]

    def _note(self, texts: list[str | None], a: int, b: int, letters: np.ndarray, out: np.ndarray) -> None:
        if a < b:
            lengths, lettered, out[a:b], _, _ = self._some(texts[a:b])
            letters[a:b] = np.where(lettered, lengths, 0)

    def _long(self, text: str) -> tuple[int, np.ndarray]:
        """A text longer than BATCH, taken in parts, each from the states in which the one before left the automata."""
        length, lettered, ended, at, gap = 0, False, np.zeros(len(self.tables)), None, True
        for i in range(0, len(text), BATCH):
            lengths, some, more, at, gap = self._some([text[i : i + BATCH]], at, gap)
            length, lettered, ended = length + int(lengths[0]), lettered or bool(some[0]), ended + more[0]
        return length if lettered else 0, ended

    def _some(self, texts: list[str | None], at: list[int] | None = None, gap_before: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], bool]:
        """Per text its length, whether it has letters, and the phrases that end in it by label; the last one's states and whether it ends in a gap."""
        symbols = [self.symbol[np.frombuffer((t or "").encode("utf-32-le"), np.uint32)] for t in texts]
        starts = np.cumsum([0, *map(len, symbols)])
        joined = np.concatenate(symbols)
        gap = joined == GAP
        after_gap = np.concatenate([[True], gap[:-1]]) if len(gap) else gap
        after_gap[starts[:-1][starts[:-1] < len(gap)]] = gap_before
        keep = ~(gap & after_gap)
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        joined, lengths = joined[keep], np.diff(starts)
        parts = -(-lengths // STRETCH)
        of_text = np.repeat(np.arange(len(texts)), parts)
        number = np.arange(len(of_text)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = starts[of_text] + number * STRETCH
        size = np.minimum(STRETCH, lengths[of_text] - number * STRETCH)
        order = np.argsort(-size, kind="stable")
        lane_of = np.empty_like(order)
        lane_of[order] = np.arange(len(order))
        before = np.where(number > 0, lane_of[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order]
        of_text, first, size = of_text[order], first[order], size[order]
        longest = int(size[0]) if len(size) else 0
        lanes = joined[np.minimum(first + np.arange(longest)[:, None], max(0, len(joined) - 1))] if longest else np.empty((0, 0), np.int32)
        lettered = np.bincount(np.repeat(np.arange(len(texts)), lengths), joined != GAP, len(texts)) > 0
        out, left = np.zeros((len(texts), len(self.tables))), []
        for k, (table, begin, root) in enumerate(self.tables):
            ended, state = _walk(table, begin, np.full(len(size), root if at is None else at[k]), root, lanes, size, before)
            out[:, k] = np.bincount(of_text, ended, len(texts))
            left.append(int(state[lane_of[-1]]) if len(size) else root if at is None else at[k])
        return lengths, lettered, out, left, bool(joined[-1] == GAP) if len(joined) else gap_before


def _walk(table: np.ndarray, begin: np.ndarray, entry: np.ndarray, root: int, lanes: np.ndarray, size: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases that end in each stretch of symbols, and the state after it.

    ``lanes`` has the stretches as columns, the longest first, ``size`` their
    lengths, ``before`` each one's predecessor in its text (-1: none).  All are
    walked at once as if each began a phrase.  Then each is walked anew from
    where its predecessor ended, until it is in the state that it was in
    before: from there on the two parses are one.  Stretches whose end changes
    by this have their successors walked again.
    """
    follows = before >= 0
    state = np.where(follows, root, entry)
    states, misses = np.empty(lanes.shape, np.int32), np.zeros(lanes.shape, bool)
    for t, n in enumerate(np.searchsorted(-size, -np.arange(len(lanes)))):
        here, symbol = state[:n], lanes[t, :n]
        found = table[here + symbol]
        miss = np.not_equal(found >> 32, here, out=misses[t, :n])
        state[:n] = np.where(miss, begin[symbol], found & 0xFFFFFFFF)
        states[t, :n] = state[:n]
    after = np.full(len(size), -1)
    after[before[follows]] = np.flatnonzero(follows)
    todo = np.flatnonzero(follows)
    todo = todo[state[before[todo]] != root]
    while len(todo):
        walking, here, t, changed = todo, state[before[todo]], 0, []
        while len(walking):
            done = size[walking] == t
            if done.any():
                changed.append(walking[done])
                state[walking[done]] = here[done]
                walking, here = walking[~done], here[~done]
                continue
            symbol = lanes[t, walking]
            found = table[here + symbol]
            miss = (found >> 32) != here
            here = np.where(miss, begin[symbol], found & 0xFFFFFFFF)
            other = states[t, walking] != here
            misses[t, walking], states[t, walking] = miss, here
            walking, here, t = walking[other], here[other], t + 1
        todo = after[np.concatenate(changed)] if changed else todo[:0]
        todo = todo[todo >= 0]
    return misses.sum(axis=0), state


def _walker(model: Model) -> _Walker:
    return kept(model, lambda: _Walker(model))


def _draw(docs: DataFrame, learnable: Column, key: str, text: str, lang: str) -> list[tuple[str, str]]:
    """(label, piece): from each label's FIT_DOCS buckets of documents the one of least hash, from which FIT_PIECE letters.

    The least hashes are combined before they are shuffled; only they come back for their pieces.
    """
    usable = merged(docs).filter(learnable & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("fit")).alias("h")
    ).withColumn("bucket", F.pmod("h", F.lit(FIT_DOCS)))
    least = cut(usable.groupBy("label", "bucket").agg(F.min("h").alias("h")), FIT_DOCS * FIT_LETTERS // LEAST_LETTERS)  # FIT_DOCS rows of each label
    labels = least.select("label").distinct().limit(FIT_LETTERS // LEAST_LETTERS + 1).count()
    if labels * LEAST_LETTERS > FIT_LETTERS:
        raise ValueError(f"over {FIT_LETTERS // LEAST_LETTERS} labels: raise FIT_LETTERS, so that each has enough text to learn from")
    wide = FIT_PIECE * 2
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - wide)).cast("int") + 1
    pieces = usable.withColumn("piece", F.substring(F.col("text"), start, F.lit(wide))).drop("text")
    found = pieces.join(broadcast_if_small(least, 64), ["label", "bucket", "h"]).groupBy("label", "bucket").agg(F.min("piece").alias("piece"))
    return sorted((label, letters_of(piece)[:FIT_PIECE]) for label, piece in found.select("label", "piece").collect())  # as many rows


def _joined(drawn: list[tuple[str, str]], each: int, usual: dict[str, float] | None = None) -> Model:
    texts: dict[str, str] = {}
    for label, piece in drawn:
        if len(texts.get(label, "")) < each:
            texts[label] = f"{texts.get(label, '')} {piece}".strip()
    made = tuple(sorted((label, text[:each]) for label, text in texts.items() if text))
    return Model(made, tuple((usual or {}).get(label, math.inf) for label, _ in made))


def fit(docs: DataFrame, learnable: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows of ``docs`` that have a label and letters and meet ``learnable``.

    At most FIT_DOCS pieces of FIT_PIECE letters are drawn for each label,
    wherever in the text a hash puts them.  Labels can be wrong, so each half
    of the pieces is first judged by the automata of the other half and goes if
    these name another language; the bits that the others need there, in the
    middle, are usual for their language.  Labels, ids and sources have no part
    in a prediction.
    """
    learnable = F.lit(True) if learnable is None else learnable
    drawn = [x for x in _draw(docs, learnable, key, text, lang) if x[1]]
    each = FIT_LETTERS // max(1, len({label for label, _ in drawn}))
    halves = [drawn[0::2], drawn[1::2]]
    clean, needed = [], {}
    for own, other in (halves, halves[::-1]):
        judge = _joined(other, each // 4)
        place = {label: i for i, (label, _) in enumerate(judge.texts)}
        bits = judge.bits([piece for _, piece in own])[1] if own and place else np.empty((len(own), 0))
        for x, row in zip(own, bits, strict=True):
            i = place.get(x[0])
            if i is None or row[i] <= row.min():
                clean.append(x)
                needed.setdefault(x[0], []).extend([] if i is None else [float(row[i])])
    usual = {label: float(np.median(x)) for label, x in needed.items() if x}
    # Pieces of many documents in turn, so that those left out at the end are of all kinds.
    return _joined(sorted(clean), each, usual)


def predictor(model: Model):
    """An Arrow function of a text column: struct<lang_pred string, score double, bits double, known boolean>."""
    labels, limits = [label for label, _ in model.texts], np.array(model.usual or [math.inf] * len(model.texts)) * MAX_BITS
    names = ["lang_pred", "score", "bits", "known"]

    @F.arrow_udf("struct<lang_pred:string,score:double,bits:double,known:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        n = len(texts)
        if not labels:
            return pa.StructArray.from_arrays([pa.array([UNKNOWN] * n), pa.array([0.0] * n), pa.array([None] * n, pa.float64()), pa.array([False] * n)], names)
        found = [model.bits(texts.slice(i, ROWS).to_pylist()) for i in range(0, n, ROWS)] or [(np.empty(0), np.empty((0, len(labels))))]
        letters, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        best, none = bits.argmin(axis=1), letters == 0  # ties go to the label that comes first
        least = bits.min(axis=1)
        second = np.partition(bits, 1, axis=1)[:, 1] if len(labels) > 1 else np.full(len(bits), np.inf)
        score = np.where(none | (second == 0), 0.0, 1 - least / np.maximum(second, 1e-300))
        named = [UNKNOWN if x else labels[i] for i, x in zip(best, none, strict=True)]
        known = ~none & (least <= limits[best] * (1 + SHORT_MARGIN / np.sqrt(np.maximum(letters, 1))))
        return pa.StructArray.from_arrays([pa.array(named), pa.array(score), pa.array(least, mask=none), pa.array(known)], names)

    return predict


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, lang_pred, score, bits, known.

    ``score`` is how much less the winner needs than the next language, 0 to
    1; ``bits`` what the winner needs a letter; ``known`` whether that is
    little enough for a text in that language.  Null texts and texts without
    letters are ``und`` with score 0 and null bits, and so is every text if
    nothing was learned.  Texts of any length are parsed whole, in parts.  Rows stay where they are.
    """
    return merged(docs).select(F.col(key), predictor(model)(F.col(text)).alias("_found")).select(key, "_found.lang_pred", "_found.score", "_found.bits", "_found.known")


def in_a_known_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are in a language of the model, unchanged.

    Rejected are ``und`` and texts for which even the best language needs
    several times the bits of its labelled texts: other scripts, languages
    that were not learned, letters at random.
    """
    return merged(docs).withColumn("_gapline_found", predictor(model)(F.col(text))).filter("_gapline_found.known").drop("_gapline_found")
