"""One pass over a page's tags that finds every element that rules name.

Tags are read in order; open elements are a stack, so each element knows its depth and its
ancestors.  The scan gives places in the text; what is read out of them is cleaned by Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

# --- fixed values: tags without content, and tags whose start ends an open paragraph ----
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table tbody td"
    " tfoot th thead tr ul".split()
)

_HIDDEN = re.compile(r"<(?:!--|(script|style)(?![A-Za-z0-9_]))", re.I)
_ENDS = {None: re.compile("-->"), "script": re.compile("</script[^>]*>", re.I), "style": re.compile("</style[^>]*>", re.I)}
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.A)


@dataclass(frozen=True)
class Element:
    """An element with a tag (None: any) and, if given, an attribute that holds a value.

    ``inside`` names ancestors, outermost first; others may stand between them.
    """

    tag: str | None
    attribute: str | None = None
    value: str | None = None
    inside: tuple[Element, ...] = ()

    def attributes(self) -> re.Pattern | None:
        """Pattern of the text behind the tag's name."""
        if self.attribute is None:
            return None
        # class is a list of words, any other attribute is compared whole
        before, after = (r"(?:[^\"']*\s)?", r"(?:\s[^\"']*)?") if self.attribute == "class" else ("", "")
        return re.compile(
            rf"(?:^|\s)(?i:{self.attribute})\s*=\s*[\"']{before}{re.escape(self.value or '')}{after}[\"']", re.A
        )


class Found:
    """An element of a page: where its tag starts, where its content starts and ends."""

    __slots__ = ("tag", "start", "end", "attributes")

    def __init__(self, tag: int, start: int, end: int, attributes: str):
        self.tag, self.start, self.end, self.attributes = tag, start, end, attributes


def visible(html: str) -> str:
    """Without scripts, styles and comments, which no reader sees.  One that never ends stays."""
    kept, at, endless = [], 0, set()
    while (begun := _HIDDEN.search(html, at)) is not None:
        kind = begun[1] and begun[1].lower()
        end = None if kind in endless else _ENDS[kind].search(html, begun.end())
        if end is None:
            endless.add(kind)
        kept.append(html[at : begun.start() if end else begun.end()])
        at = end.end() if end else begun.end()
    return "".join([*kept, html[at:]]) if at else html


class Scan:
    """Finds elements in one pass; calling it gives a list of Found for each, in page order.

    An element ends at its own closing tag, or where the element around it ends.  A block's
    start ends an open paragraph, a closing tag of text mark-up does not reach out of its block,
    and closing tags of nothing are passed over.  What is never closed goes to the end.
    """

    def __init__(self, elements: list[Element]):
        self.size = len(elements)
        chains = list(dict.fromkeys(e.inside for e in elements if e.inside))
        tests = [(e, e.attributes()) for e in elements]
        self.wanted: dict[str | None, list[tuple]] = {}
        for k, (e, pattern) in enumerate(tests):
            chain = chains.index(e.inside) if e.inside else None
            name = e.tag and e.tag.lower()
            self.wanted.setdefault(name, []).append((k, e.value, pattern, chain, len(e.inside)))
        self.chains = [[(a.tag and a.tag.lower(), a.attributes()) for a in chain] for chain in chains]

    def _names(self, name: str) -> Iterator[tuple]:
        yield from self.wanted.get(name, ())
        yield from self.wanted.get(None, ())

    def __call__(self, html: str) -> list[list[Found]]:
        found: list[list[Found]] = [[] for _ in range(self.size)]
        stack: list[tuple] = []  # name, elements found at this tag, ancestors met of each chain
        places: dict[str, list[int]] = {}  # of the open elements with a name
        blocks: list[int] = []
        none = (0,) * len(self.chains)
        by_name = {}

        def close(down_to: int, at: int) -> None:
            while len(stack) > down_to:
                name, begun, _ = stack.pop()
                places[name].pop()
                if name in BLOCKS:
                    blocks.pop()
                for f in begun:
                    f.end = at

        # up to the last >, so that every tag that begins also ends
        for m in _TAG.finditer(html, 0, html.rfind(">") + 1):
            closing, name, rest = m.groups()
            name = name.lower()
            if closing:
                if (open_at := places.get(name)) and (name in BLOCKS or not blocks or open_at[-1] > blocks[-1]):
                    close(open_at[-1], m.start())
                continue
            if name in BLOCKS and places.get("p"):
                close(places["p"][-1], m.start())
            met = stack[-1][2] if stack else none
            begun = []
            if (tests := by_name.get(name)) is None:
                tests = by_name[name] = list(self._names(name))
            for k, value, pattern, chain, length in tests:
                if pattern is not None and (value not in rest or not pattern.search(rest)):
                    continue
                if chain is None or met[chain] == length:
                    f = Found(m.start(), m.end(), len(html), rest)
                    found[k].append(f)
                    begun.append(f)
            if name in VOID:
                for f in begun:
                    f.end = f.start
                continue
            if self.chains:
                met = tuple(map(self._step, self.chains, met, [name] * len(met), [rest] * len(met)))
            places.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks.append(len(stack))
            stack.append((name, begun, met))
        return found

    @staticmethod
    def _step(chain: list[tuple], met: int, name: str, rest: str) -> int:
        if met == len(chain):
            return met
        tag, pattern = chain[met]
        return met + ((tag is None or tag == name) and (pattern is None or pattern.search(rest) is not None))


def apart(found: list[Found]) -> list[Found]:
    """The elements, each up to the next of its kind at most."""
    for one, after in zip(found, found[1:], strict=False):
        one.end = min(one.end, max(after.tag, one.start))
    return found


def within(found: list[Found], block: Found) -> Iterator[Found]:
    """The elements that begin in a block, up to the block's end at most."""
    k = bisect_left(found, block.start, key=lambda f: f.tag)
    while k < len(found) and found[k].tag < block.end:
        f = found[k]
        yield Found(f.tag, f.start, min(f.end, block.end), f.attributes)
        k += 1
