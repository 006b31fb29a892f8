"""Web pages as tables of elements: a tokenizer as a state machine, and a table function over it.

The machine knows text, tags, attributes quoted and bare, comments and
declarations, and elements whose contents are no markup.  It reads any text to
its end and never fails.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without contents, those whose contents are text as it stands, and those in which only entities are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW, ESCAPED = frozenset(["script", "style"]), frozenset(["title", "textarea"])
#: An element of the same kind that is still open ends where one of these begins, but not beyond one of the second.
ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())
HOLDS = frozenset("ul ol dl table tbody thead tfoot select div article section main body blockquote".split())
SCHEMA = "n int, parent int, depth int, path string, tag string, attributes map<string,string>, text string, begin int, end int"
_NAME, _SPACE = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"\s+")


def tokens(text: str) -> Iterator[tuple]:
    """("text", begin, end), ("raw", begin, end), ("start", begin, end, name, attributes), ("end", begin, end, name) in order; comments and declarations are left out."""
    at, begin, size = 0, 0, len(text)
    while at < size:
        at = text.find("<", at)
        if at < 0:
            break
        opened, closing = at, text.startswith("</", at)
        name = _NAME.match(text, at + 2 if closing else at + 1)
        if name is None and not text.startswith(("<!", "<?"), at) and not closing:
            at += 1  # a sign of its own
            continue
        if begin < opened:
            yield "text", begin, opened
        if name is None:
            end = text.find("-->", at + 4) + 3 if text.startswith("<!--", at) else text.find(">", at) + 1
            at = begin = end if end > 2 or (end > 0 and not text.startswith("<!--", at)) else size
            continue
        at, attributes = _attributes(text, name.end())
        begin = at
        if closing:
            yield "end", opened, at, name[0].lower()
            continue
        tag = name[0].lower()
        yield "start", opened, at, tag, attributes
        if tag in RAW or tag in ESCAPED:
            behind = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(text, at)
            end = behind.start() if behind else size
            if at < end:
                yield "raw" if tag in RAW else "text", at, end
            at = begin = end
    if begin < size:
        yield "text", begin, size


def _attributes(text: str, at: int) -> tuple[int, dict[str, str]]:
    """The position behind a tag, and its attributes, the first of a name; ``at`` is behind the tag's name."""
    out: dict[str, str] = {}
    size, state, name, begin, quote = len(text), "between", "", at, ""

    def put(value: str) -> None:
        if name:
            out.setdefault(name.lower(), html.unescape(value))

    while at < size:
        sign = text[at]
        if state == "quoted":
            if sign == quote:
                put(text[begin:at])
                state, name = "between", ""
        elif state == "bare":
            if sign.isspace() or sign == ">":
                put(text[begin:at])
                state, name = "between", ""
                if sign == ">":
                    return at + 1, out
        elif sign == ">":
            put("") if state != "name" else out.setdefault(text[begin:at].lower(), "")
            return at + 1, out
        elif state == "between":
            if sign == "=" and name:
                state = "value"
            elif not sign.isspace() and sign != "/":
                put("")
                state, begin, name = "name", at, ""
        elif state == "name":
            if sign.isspace() or sign in "=/":
                name = text[begin:at]
                state = "value" if sign == "=" else "between"
        elif state == "value" and not sign.isspace():
            state, begin, quote = ("quoted", at + 1, sign) if sign in "\"'" else ("bare", at, "")
        at += 1
    return size, out


def elements(text: str | None, entities: list[str] | None = None) -> list[list]:
    """The elements of a page in order, as SCHEMA has them.

    ``text`` is what stands in the element itself, not in those within it,
    with single spaces; ``begin`` is where its tag begins and ``end`` where the
    element ends.  End tags without a beginning are ignored; elements that
    aren't ended end with the one around them.  Of ``entities`` (name, sign,
    name, sign, ...) only those are read in texts, in that order.
    """
    out: list[list] = []
    open_: list[int] = []
    said: list[list[str]] = []

    def close(down_to: int, at: int) -> None:
        while len(open_) > down_to:
            out[open_.pop()][8] = at

    def read(piece: str) -> str:
        if entities is None:
            return html.unescape(piece)
        for name, sign in zip(entities[::2], entities[1::2], strict=True):
            piece = piece.replace(name, sign)
        return piece

    for token in tokens(text or ""):
        kind, begin, end = token[:3]
        if kind in ("text", "raw"):
            if open_:
                piece = text[begin:end]
                said[open_[-1]].append(piece if kind == "raw" else read(piece))
        elif kind == "start":
            tag = token[3]
            if tag in ENDS_ITSELF:
                for k in range(len(open_) - 1, -1, -1):
                    if out[open_[k]][4] == tag:
                        close(k, begin)
                        break
                    if out[open_[k]][4] in HOLDS:
                        break
            parent = open_[-1] if open_ else None
            path = f"{out[parent][3]}/{tag}" if parent is not None else tag
            out.append([len(out), parent, len(open_), path, tag, token[4], "", begin, end])
            said.append([])
            if tag not in VOID:
                open_.append(len(out) - 1)
        else:
            for k in range(len(open_) - 1, -1, -1):
                if out[open_[k]][4] == token[3]:
                    close(k + 1, begin)
                    close(k, end)
                    break
    close(0, len(text or ""))
    for row, pieces in zip(out, said, strict=True):
        row[6] = _SPACE.sub(" ", "".join(pieces)).strip()
    return out


@F.udtf(returnType=SCHEMA)
class HtmlElements:
    """``html_elements(html)`` as a table function: a row an element."""

    def eval(self, page: str, entities: list[str] | None = None):
        for row in elements(page, entities):
            yield tuple(row)


def page_elements(pages: DataFrame, key: str, page: str, entities: list[tuple[str, str]] | None = None) -> DataFrame:
    """key and SCHEMA: the elements of each page, in the page's own order by ``n``; a page that is null or has none has no row.

    In texts all entities are read, or just ``entities`` (name, sign), one after the other.
    """
    told = [] if entities is None else [F.array(*[F.lit(x) for one in entities for x in one])]
    return pages.select(key, F.col(page).alias("_page")).lateralJoin(HtmlElements(F.col("_page").outer(), *told)).drop("_page")


def heads(found: DataFrame, key: str) -> DataFrame:
    """key, language, title, heading, links, paragraphs of pages, from their elements."""
    first = lambda tag, column: F.min_by(F.when(F.col("tag") == tag, F.col(column)), F.when(F.col("tag") == tag, F.col("n")))
    language = F.try_element_at("attributes", F.lit("lang"))
    return found.withColumn("language", language).groupBy(key).agg(first("html", "language").alias("language"), first("title", "text").alias("title"), first("h1", "text").alias("heading"), F.count_if((F.col("tag") == "a") & F.map_contains_key("attributes", F.lit("href"))).alias("links"), F.count_if(F.col("tag") == "p").alias("paragraphs"))


def linked_data(found: DataFrame, key: str) -> DataFrame:
    """key, n, json: the blocks of linked data, as they stand in their script elements."""
    kind = F.lower(F.trim(F.try_element_at("attributes", F.lit("type"))))
    return found.filter((F.col("tag") == "script") & (kind == "application/ld+json")).select(key, "n", F.col("text").alias("json"))


def review_summary(found: DataFrame, key: str) -> DataFrame:
    """key, total, positive, negative: the first sentence on how many of the users' reviews are positive, in a text or an attribute.

    Positive reviews are rounded half to even, as the share is given in whole hundredths.
    """
    each = found.select(key, "n", F.explode(F.concat(F.array("text"), F.map_values("attributes"))).alias("said"))
    sentence = r"(?i)(\d{1,3})% of the ([\d,]+) user reviews (?:[^\"<]* )?are positive"
    share, total = F.regexp_extract("said", sentence, 1).try_cast("long"), F.regexp_replace(F.regexp_extract("said", sentence, 2), ",", "").try_cast("long")
    met = each.withColumns({"share": share, "total": total}).filter("total > 0").groupBy(key).agg(F.min_by(F.struct("share", "total"), F.struct("n", "said")).alias("s"))
    positive = F.bround(F.col("s.share") * F.col("s.total") / 100, 0).cast("long")
    return met.select(key, F.col("s.total").alias("total"), positive.alias("positive"), F.greatest(F.col("s.total") - positive, F.lit(0)).alias("negative"))
