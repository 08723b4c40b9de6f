"""The search language: terms, quoted phrases, ``in:``, ``after:``, ``before:``, ``like:`` and a leading ``~``."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo


def utf16_length(term: str) -> int:
    return len(term.encode("utf-16-le")) // 2


@dataclass
class Query:
    """What a search string asks for; ``after`` and ``before`` are UTC instants."""

    terms: list[str] = field(default_factory=list)
    source: str | None = None
    after: dt.datetime | None = None
    before: dt.datetime | None = None
    like: int | None = None
    visual_only: bool = False

    @property
    def long_terms(self) -> list[str]:
        """Terms that the full-text rule handles: at least three UTF-16 units."""
        return [t for t in self.terms if utf16_length(t) >= 3]

    @property
    def short_terms(self) -> list[str]:
        return [t for t in self.terms if utf16_length(t) < 3]

    @property
    def phrase(self) -> str:
        return " ".join(self.terms)


def tokenize(text: str) -> list[str]:
    """Split at white space outside quotes; quotes are dropped, an open one runs to the end."""
    out, word, quoted = [], "", False
    for c in text:
        if c == '"':
            quoted = not quoted
        elif c.isspace() and not quoted:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def parse_date(text: str, tz: str = "UTC") -> dt.datetime | None:
    """The UTC instant at which the named local day, month or year begins; null for anything else."""
    for pattern, form in ((r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"), (r"\d{4}-\d{2}", "%Y-%m"), (r"\d{4}", "%Y")):
        if re.fullmatch(pattern, text):
            try:
                return dt.datetime.strptime(text, form).replace(tzinfo=ZoneInfo(tz)).astimezone(dt.timezone.utc)
            except ValueError:
                return None
    return None


def _filter(token: str, tz: str) -> tuple[str, object] | None:
    """(field, value) if the token is a well-formed filter."""
    low = token.lower()
    if low.startswith("in:") and len(token) > 3:
        return "source", token[3:]
    for name in ("after", "before"):
        if low.startswith(f"{name}:") and (day := parse_date(token[len(name) + 1 :], tz)):
            return name, day
    if low.startswith("like:") and re.fullmatch(r"#?\d+", token[5:]):
        return "like", int(token[5:].lstrip("#"))
    return None


def parse(text: str, tz: str = "UTC") -> Query:
    """Filters are recognised in any case; the last of a kind wins; malformed ones are terms."""
    stripped = text.lstrip()
    query = Query(visual_only=stripped.startswith("~"))
    for token in tokenize(stripped[1:] if query.visual_only else stripped):
        found = _filter(token, tz)
        if found:
            setattr(query, *found)
        else:
            query.terms.append(token)
    return query


def filters(text: str, tz: str = "UTC") -> str:
    """Only the source and date filters of a string, joined by spaces; quotes are not kept."""
    return " ".join(t for t in tokenize(text) if (f := _filter(t, tz)) and f[0] != "like")


def dispatch(query: Query, has_visual: bool = True, has_meaning: bool = True) -> str:
    """Which ranker answers: like, none, visual, text or hybrid."""
    if query.like is not None:
        return "like"
    if query.visual_only:
        return "visual" if query.terms and has_visual else "none"
    if not query.terms or not (has_visual or has_meaning):
        return "text"
    return "hybrid"
