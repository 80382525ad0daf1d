"""Extraction of links, articles, comments and reactions from stored pages.

The rules name elements by tag, one attribute and ancestors.  A page is read once for all rules, by a
scan of its tags in Arrow batches (see scan.py) that hands back the fragments of HTML that the
rules want; text is made of those by built-in functions.  A record ends at its own closing tag,
or at the next record of the same kind if that comes first.
"""

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark import fixed_values as fv
from moodspark.functions.text import bind, digits_or_zero, is_blank, squeeze, strip
from moodspark.functions.urls import resolve_url
from moodspark.sources.scan import Element, Found, Scan, apart, visible, within


@dataclass(frozen=True)
class ArticleRule:
    title: Element
    paragraph: Element | None = None  # body = non-blank paragraphs, one per line
    body: Element | None = None  # body = text of one element


@dataclass(frozen=True)
class CommentRule:
    block: Element
    text: Element | None  # None: the block itself is the text
    numbers: dict[str, Element] = field(default_factory=dict)
    required: tuple[Element, ...] = ()  # an incomplete record is skipped; text never kept


@dataclass(frozen=True)
class ReactionRule:
    block: Element
    name_attribute: str
    count: Element


@dataclass(frozen=True)
class PageRules:
    """What is read from each page, in one pass."""

    article: ArticleRule | None = None
    comments: CommentRule | None = None
    text_only: bool = False  # comments are the text elements of each block
    reactions: ReactionRule | None = None
    links: bool = False
    links_inside: Element | None = None  # tells links within such an element


def _element(spec) -> Element:
    return Element(*spec)


VOTED_ARTICLE = ArticleRule(
    title=_element(fv.VOTED_TITLE), paragraph=_element(fv.VOTED_PARAGRAPH)
)
VOTED_COMMENTS = CommentRule(
    block=_element(fv.VOTED_COMMENT),
    text=Element("p"),
    numbers={
        "upvotes": _element(fv.VOTED_COMMENT_UP),
        "downvotes": _element(fv.VOTED_COMMENT_DOWN),
    },
    required=(_element(fv.VOTED_COMMENT_AUTHOR),),
)
REACTION_PAGE_ARTICLE = ArticleRule(
    title=_element(fv.REACTION_PAGE_TITLE), body=_element(fv.REACTION_PAGE_BODY)
)
REACTION_PAGE_COMMENTS = CommentRule(block=_element(fv.REACTION_PAGE_COMMENT), text=Element("p"))
REACTIONS = ReactionRule(
    block=_element(fv.REACTION_ITEM),
    name_attribute="title",
    count=_element(fv.REACTION_ITEM_COUNT),
)
POST_ARTICLE = ArticleRule(title=_element(fv.POST_CAPTION))
POST_COMMENTS = CommentRule(
    block=Element(*fv.POST_COMMENT, inside=(Element(fv.POST_COMMENT_WITHIN[0]),) * fv.POST_COMMENT_WITHIN[1]), text=None
)

# named character references of HTML; &amp; is decoded last, so that nothing is decoded twice
NAMED_REFERENCES = {n: chr(p) for n, p in name2codepoint.items() if n != "amp"} | {"apos": "'"}


def _decode_numbers(text: Column) -> Column:
    """Decimal and hexadecimal character references, each distinct one replaced in turn."""
    pattern = r"&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))

    def put(acc: Column, code: Column) -> Column:
        hexadecimal = F.conv(F.substring(code, 2, 6), 16, 10)
        point = F.when(F.lower(code).startswith("x"), hexadecimal).otherwise(code).try_cast("int")
        valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.when(valid, F.replace(acc, F.concat(F.lit("&#"), code, F.lit(";")), char)).otherwise(
            acc
        )

    return F.aggregate(codes, text, put)


def _decode_names(text: Column) -> Column:
    # a constant of the plan once it is optimised
    known = F.from_json(F.lit(json.dumps(NAMED_REFERENCES)), "map<string,string>")
    names = F.array_distinct(F.regexp_extract_all(text, F.lit("&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)))

    def put(acc: Column, name: Column) -> Column:
        char = F.try_element_at(known, name)
        reference = F.concat(F.lit("&"), name, F.lit(";"))
        return F.when(char.isNotNull(), F.replace(acc, reference, char)).otherwise(acc)

    return F.aggregate(names, text, put)


def _decode(text: Column) -> Column:
    text = bind(text, _decode_names)
    text = bind(text, lambda t: F.when(t.contains("&#"), _decode_numbers(t)).otherwise(t))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def inner_text(fragment: Column) -> Column:
    """Text of an HTML fragment: line breaks kept, tags dropped, character references decoded."""

    def without_tags(t: Column) -> Column:
        lines = F.regexp_replace(t, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6])\s*>", "\n")
        return F.when(t.contains("<"), F.regexp_replace(lines, r"<[^>]*>", "")).otherwise(t)

    text = bind(squeeze(fragment), without_tags)
    text = bind(text, lambda t: F.when(t.contains("&"), _decode(t)).otherwise(t))
    return strip(F.regexp_replace(text, r" *\n[ \n]*", "\n"))


_HREF = re.compile(r"""(?:^|\s)href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I | re.A)

#: Characters of pages whose fragments are Python objects at a time, but for the last page of them.
CHARS_HELD = 1 << 20

FRAGMENTS = """struct<title string, paragraphs array<string>,
    comments array<struct<position int, part int, fields array<string>>>,
    reactions array<struct<position int, name string, count string>>,
    links array<struct<href string, inside boolean>>>"""

_ARROW = pa.struct(
    [
        ("title", pa.string()),
        ("paragraphs", pa.list_(pa.string())),
        ("comments", pa.list_(pa.struct([("position", pa.int32()), ("part", pa.int32()), ("fields", pa.list_(pa.string()))]))),
        ("reactions", pa.list_(pa.struct([("position", pa.int32()), ("name", pa.string()), ("count", pa.string())]))),
        ("links", pa.list_(pa.struct([("href", pa.string()), ("inside", pa.bool_())]))),
    ]
)


class Reader:
    """The fragments that rules want of a page."""

    def __init__(self, rules: PageRules):
        self.rules = rules
        self.elements: list[Element] = []
        article, comments, reactions = rules.article, rules.comments, rules.reactions
        wanted = [article and (article.title, article.paragraph, article.body)]
        wanted += [comments and (comments.block, comments.text, *comments.numbers.values(), *comments.required)]
        wanted += [reactions and (reactions.block, reactions.count)]
        if rules.links:
            inside = rules.links_inside
            wanted.append((Element("a"), inside and Element("a", inside=(*inside.inside, inside))))
        self.elements = list(dict.fromkeys(e for group in wanted if group for e in group if e))
        self.scan = Scan(self.elements)
        if reactions:
            self.name = re.compile(rf"(?:^|\s){reactions.name_attribute}\s*=\s*[\"']([^\"']*)[\"']", re.I | re.A)

    def __call__(self, html: str | None) -> dict:
        text = visible(html or "")
        found = dict(zip(self.elements, self.scan(text), strict=True))
        rules, out = self.rules, {}
        if rules.article:
            title = found[rules.article.title]
            out["title"] = text[title[0].start : title[0].end] if title else None
            body = rules.article.paragraph or rules.article.body
            parts = found[body] if body else []
            parts = apart(parts) if rules.article.paragraph else parts[:1]
            out["paragraphs"] = [text[f.start : f.end] for f in parts]
        if rules.comments:
            blocks = apart(found[rules.comments.block])
            read = self._texts if rules.text_only else self._records
            out["comments"] = list(read(text, found, blocks))
        if rules.reactions:
            out["reactions"] = list(self._reactions(text, found))
        if rules.links:
            heads = rules.links_inside
            inside = {f.tag for f in found[Element("a", inside=(*heads.inside, heads))]} if heads else ()
            links = ((_HREF.search(f.attributes), f.tag) for f in found[Element("a")])
            out["links"] = [{"href": m[1].strip("\"'") if m[1][0] in "\"'" else m[1], "inside": at in inside} for m, at in links if m]
        return out

    def _records(self, text: str, found: dict, blocks: list[Found]) -> Iterator[dict]:
        rule = self.rules.comments
        for position, block in enumerate(blocks):
            parts = [block] if rule.text is None else []
            wanted = [*([rule.text] if rule.text else []), *rule.numbers.values(), *rule.required]
            parts += [next(within(found[e], block), None) for e in wanted]
            if all(parts):
                fields = parts[: 1 + len(rule.numbers)]
                yield {"position": position, "part": 0, "fields": [text[f.start : f.end] for f in fields]}

    def _texts(self, text: str, found: dict, blocks: list[Found]) -> Iterator[dict]:
        for position, block in enumerate(blocks):
            for part, f in enumerate(apart(list(within(found[self.rules.comments.text], block)))):
                yield {"position": position, "part": part, "fields": [text[f.start : f.end]]}

    def _reactions(self, text: str, found: dict) -> Iterator[dict]:
        rule = self.rules.reactions
        for position, block in enumerate(apart(found[rule.block])):
            name, count = self.name.search(block.attributes), next(within(found[rule.count], block), None)
            if name and count:
                yield {"position": position, "name": name[1], "count": text[count.start : count.end]}


def _read(pages: pa.Array, reader: Reader) -> pa.Array:
    """The fragments of a batch's pages; Python objects of a few pages are held at a time, as a batch can be large."""
    parts, rows, chars = [], [], 0
    for page in pages:
        html = page.as_py()
        rows.append(reader(html))
        chars += len(html or "")
        if chars >= CHARS_HELD:
            parts.append(pa.array(rows, _ARROW))
            rows, chars = [], 0
    return pa.concat_arrays([*parts, pa.array(rows, _ARROW)])


def fragments(html: Column, rules: PageRules) -> Column:
    """A struct of what the rules want of a page, as HTML.  Each page is read once."""

    @F.arrow_udf(FRAGMENTS)
    def read(pages: pa.Array) -> pa.Array:
        return _read(pages, Reader(rules))

    return read(html)


def _numbered(rule: CommentRule, fields: Column) -> list[Column]:
    return [
        inner_text(F.get(fields, F.lit(k))).try_cast("int").alias(name) for k, name in enumerate(rule.numbers, 1)
    ]


def extract_pages(pages: DataFrame, rules: PageRules) -> DataFrame:
    """page_id, url and, for each rule that is given, what it finds.

    ``title`` and ``content`` are '' where they are missing; content is the non-blank paragraphs, one
    per line, or the text of the first body element.  ``comments`` is an array of (position, comment,
    the rule's numbers), or with text_only of (position, part, comment) without blank ones; a
    record that lacks a field is skipped, a number that is no number is null.  ``reactions`` is an
    array of (position, emotion, count); a count that is not all digits is 0.  ``links`` is an
    array of (href, inside).  A page without HTML has none of them.
    """
    read = pages.select("page_id", "url", fragments(F.col("html"), rules).alias("_found"))
    found = F.col("_found")
    columns = []
    if rules.article:
        texts = F.transform(found["paragraphs"], inner_text)
        columns.append(F.coalesce(inner_text(found["title"]), F.lit("")).alias("title"))
        columns.append(F.array_join(F.filter(texts, lambda t: ~is_blank(t)), "\n").alias("content"))
    if rules.comments:
        position, text = (lambda r: r["position"].alias("position")), (lambda r: inner_text(r["fields"][0]).alias("comment"))
        if rules.text_only:
            records = F.transform(found["comments"], lambda r: F.struct(position(r), r["part"].alias("part"), text(r)))
            records = F.filter(records, lambda r: ~is_blank(r["comment"]))
        else:
            records = F.transform(
                found["comments"], lambda r: F.struct(position(r), text(r), *_numbered(rules.comments, r["fields"]))
            )
        columns.append(records.alias("comments"))
    if rules.reactions:
        counters = F.transform(
            found["reactions"],
            lambda r: F.struct(
                r["position"].alias("position"),
                inner_text(r["name"]).alias("emotion"),
                digits_or_zero(inner_text(r["count"])).alias("count"),
            ),
        )
        columns.append(counters.alias("reactions"))
    if rules.links:
        columns.append(found["links"].alias("links"))
    return read.select("page_id", "url", *columns)


def extract_links(
    pages: DataFrame,
    href_pattern: str = "",
    base: str | None = None,
    inside: Element | None = None,
    dedupe: bool = True,
) -> DataFrame:
    """Absolute links whose href matches; ``inside`` also accepts any link within an element.

    Character references in hrefs are decoded.  A link in every page's menu is reduced on the map
    side by the distinct.
    """
    found = extract_pages(pages, PageRules(links=True, links_inside=inside))
    found = found.select("url", F.inline("links")).where(F.col("href").rlike(href_pattern) | F.col("inside"))
    href = F.when(F.col("href").contains("&"), _decode(F.col("href"))).otherwise(F.col("href"))
    origin = F.lit(base) if base else F.col("url")
    resolved = found.where("href <> ''").select(bind(href, lambda h: resolve_url(origin, h)).alias("link"))
    return resolved.distinct() if dedupe else resolved


def extract_articles(pages: DataFrame, rule: ArticleRule = VOTED_ARTICLE) -> DataFrame:
    """page_id, url, title, content; a missing title or body is ''."""
    return extract_pages(pages, PageRules(article=rule))


def extract_comments(pages: DataFrame, rule: CommentRule, text_only: bool = False) -> DataFrame:
    """page_id, url and the comments of extract_pages, a row each."""
    return extract_pages(pages, PageRules(comments=rule, text_only=text_only)).select("page_id", "url", F.inline("comments"))


def extract_reactions(pages: DataFrame, rule: ReactionRule = REACTIONS) -> DataFrame:
    """page_id, url and the reactions of extract_pages, a row each."""
    return extract_pages(pages, PageRules(reactions=rule)).select("page_id", "url", F.inline("reactions"))
