"""Query strings, parsed on the driver (a query is a scalar)."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class ParsedQuery:
    phrases: tuple[str, ...]
    terms: tuple[str, ...]
    any_term: bool

    @property
    def empty(self) -> bool:
        return not self.phrases and not self.terms

    def index_terms(self) -> list[str]:
        """The words that candidates are looked up by, each once, in order."""
        said = " ".join(normalize_query(x) for x in (*self.phrases, *self.terms))
        return list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", said)))

    def snippet_terms(self) -> list[str]:
        return list(dict.fromkeys(t for x in (*self.phrases, *self.terms) if len(t := x.lower().strip()) > 1 or x in self.phrases and t))


def parse_query(text: str) -> ParsedQuery:
    """Quoted phrases of more than one character, terms of more than one, and whether OR stands
    anywhere outside quotes (then one term is enough)."""
    text = re.sub("[“”]", '"', text)
    phrases = tuple(p for x in re.findall(r'"([^"]*)"', text) if len(p := x.strip()) > 1)
    bare = re.sub(r'"[^"]*"', "", text)
    alone = re.compile(r"(?<![A-Za-z0-9_])or(?![A-Za-z0-9_])", re.IGNORECASE)
    terms = tuple(t for t in alone.sub(" ", bare).split() if len(t) > 1)
    return ParsedQuery(phrases, terms, bool(alone.search(bare)))


def normalize_query(text: str) -> str:
    """Lower case, everything but letters, digits, blanks, apostrophes and hyphens blanked."""
    kept = "".join(c if c.isalnum() or c in "'-" else " " for c in text.lower())
    return " ".join(kept.split())
