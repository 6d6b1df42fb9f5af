"""A page as a tree of elements, read leniently: what the template removal needs of HTML, and no more."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from html import unescape

# Raw elements and comments are passed over whole; what is caught: the name of an end tag, that of a start tag, its attributes.
TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)"
    r"|((?i:script|style|textarea|title|noscript|iframe|xmp|noembed|noframes))(?=[\s/>]).*?(?:</(?i:\1)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    r"|/([a-zA-Z][^\s/>]*+)?[^>]*+(?:>|\Z)|([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z))",
    re.DOTALL,
)
TOLD = re.compile("class|id|role|style", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
SPLIT = re.compile(r"[^a-z0-9]+")

# How HTML's elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr input button select option optgroup meter progress script style noscript template iframe link meta picture source svg canvas map area audio video embed object".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}

# Elements, roles and words of classes and ids that say that something isn't the article.
OUT_TAGS = frozenset("head template svg canvas object audio video map form fieldset button select input nav footer aside dialog menu".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar comment comments disqus replies respond "
    "share sharing social related recommended recommendations widget widgets pagination pager".split()
)
NEVER_OUT = frozenset("html body main h1 h2 h3 h4 h5 h6".split())


class Page:
    """Elements in page order: ``tag``, ``parent``, ``said`` (class and id), ``kids`` (texts and numbers of elements)."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.said, self.out, self.kids = [""], [-1], [""], [False], [[]]
        self.read(html)

    def add(self, tag: str, attrs: str, above: int) -> int:
        k = len(self.tag)
        said, out = told(tag, attrs) if attrs and TOLD.search(attrs) else ("", tag in OUT_TAGS)
        self.tag.append(tag)
        self.parent.append(above)
        self.said.append(said)
        self.out.append(out)
        self.kids.append([])
        self.kids[above].append(k)
        return k

    def read(self, html: str) -> None:
        stack, parts = [0], TAG.split(html)
        kids = self.kids
        for i in range(0, len(parts), 5):
            if text := parts[i]:
                kids[stack[-1]].append(unescape(text))
            if i + 1 == len(parts):
                return
            _, closed, name, attrs = parts[i + 1 : i + 5]
            if closed:
                self.close(stack, closed.lower())
            elif name:
                name = name.lower()
                if name in ("html", "body", "head") and any(self.tag[k] == name for k in stack):
                    continue
                if name not in INLINE or name in CLOSES:
                    self.make_room(stack, name)
                k = self.add(name, attrs, stack[-1])
                if name not in VOID:
                    stack.append(k)

    def make_room(self, stack: list[int], name: str) -> None:
        """End what a start tag ends by itself: a paragraph before any block, an item before the next."""
        ends, holds = CLOSES.get(name, ()), HOLDS.get(name, ())
        if name not in INLINE:
            for i in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[i]]
                if tag == "p" or (tag in HEADINGS and name in HEADINGS):
                    del stack[i:]
                    break
                if tag not in INLINE:
                    break
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag in holds:
                return
            if tag in ends:
                del stack[i:]
                if name not in ("tr", "tbody"):
                    return

    def close(self, stack: list[int], name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag == name:
                del stack[i:]
                return
            if name in INLINE and tag not in INLINE:
                return

    def sizes(self) -> tuple[list[int], list[int]]:
        """Of each element: its characters, blanks in one, and those in links."""
        n = len(self.tag)
        chars, linked = [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            chars[k] += sum(len(" ".join(t.split())) for t in self.kids[k] if isinstance(t, str))
            if self.tag[k] == "a":
                linked[k] = chars[k]
            chars[self.parent[k]] += chars[k]
            linked[self.parent[k]] += linked[k]
        return chars, linked

    def hashes(self) -> list[int]:
        """Of each block element the hash of its subtree: names, classes, ids and words, no other attributes. Inline elements have none."""
        n = len(self.tag)
        made, keys = [0] * n, [""] * n
        for k in range(n - 1, -1, -1):
            inner = chr(0).join(" ".join(x.split()) if isinstance(x, str) else keys[x] for x in self.kids[k])
            keys[k] = f"<{self.tag[k]} {self.said[k]}>{inner}"
            if self.tag[k] not in INLINE:
                made[k] = int.from_bytes(hashlib.blake2b(keys[k].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                keys[k] = f"<{made[k]}>"
        return made


@lru_cache(100_000)
def told(tag: str, attrs: str) -> tuple[str, bool]:
    """Class and id of an element, and whether it is unwanted by what it is."""
    found = {a.lower(): unescape(x or y or z) for a, x, y, z in ATTRIBUTE.findall(attrs)}
    said = f"{found.get('class', '')} {found.get('id', '')}".strip()
    if tag in NEVER_OUT:
        return said, False
    if tag in OUT_TAGS or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in OUT_ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return said, True
    words = [w for w in SPLIT.split(CAMEL.sub(" ", said).lower()) if w]
    words += [a + b for a, b in zip(words, words[1:], strict=False)]
    return said, not OUT_WORDS.isdisjoint(words) and (tag != "article" or not {"comment", "comments"}.isdisjoint(words))
