"""A recursive-descent grammar for SVMlight text that recovers from errors.

    text    := record (line-end record)*
    record  := blank? [label (blank pair)*] blank? [comment]
    label   := number equal to -1, 0 or 1
    pair    := index ':' number
    comment := '#' (plain | quoted)*
    quoted  := '"' (any character but '"')* '"'

A rule that fails notes where and why and the parser goes on at the next separator, so one
pass finds every error of a record. A quoted part may run over line ends; if its closing
quote is missing, parsing resumes at the next anchor: a line start where a valid label and a
valid pair (or the line end) stand.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

#: Reasons, first to last: the earliest of them that a record meets is its reason.
REASONS = ("label", "pair", "index", "value", "quote", "count")

_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_TOKEN = re.compile(r"[^ \t]+")
_PAIR = re.compile(rf"([0-9]{{1,18}}):({_NUMBER.pattern})")
_DIGITS = re.compile(r"[0-9]+")
_COUNT = re.compile(r"(?:^| )n=([0-9]+)")
_ANCHOR = re.compile(
    r"[ \t]*[+-]?(?:0*1(?:\.0*)?|0+(?:\.0*)?|\.0+)(?:[eE][+-]?0+)?(?:[ \t]+[0-9]+:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?(?=[ \t#\r\n]|$)|[ \t]*(?=[#\r\n]|$))"
)
#: Python refuses to read integers of more digits than this.
_LONGEST_INT = 4000


@dataclass
class Record:
    """One parsed record; errors holds (rank of the reason, offset, token)."""

    label: float | None = None
    index: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    comment: str | None = None
    n_pairs: int = 0
    empty: bool = True
    errors: list[tuple[int, int, str]] = field(default_factory=list)
    line: int = 0

    @property
    def reason(self) -> str | None:
        return REASONS[min(self.errors)[0]] if self.errors else None


def number(token: str) -> float | None:
    """The finite double that an ASCII number spells, else None."""
    if _NUMBER.fullmatch(token):
        x = float(token)
        if math.isfinite(x):
            return x
    return None


class _Parser:
    def __init__(self, first: int | None, n_features: int | None):
        self.low = first
        self.high = None if first is None or n_features is None else first + n_features - 1

    def record(self, text: str) -> Record:
        """record, over text that holds one record and no line end of its own."""
        out = Record()
        body, mark, comment = text.partition("#")
        tokens = _TOKEN.finditer(body)
        head = next(tokens, None)
        if head is None:
            if mark:
                out.comment = comment
            return out
        out.empty = False
        self.label(out, head.group(), head.start())
        last = -1
        for t in tokens:
            out.n_pairs += 1
            last = self.pair(out, t.group(), t.start(), last)
        if mark:
            out.comment = comment
            self.comment(out, comment, len(body) + 1)
        return out

    def label(self, out: Record, token: str, at: int) -> None:
        out.label = number(token)
        if out.label not in (-1.0, 0.0, 1.0):
            out.errors.append((0, at, token))

    def pair(self, out: Record, token: str, at: int, last: int) -> int:
        plain = _PAIR.fullmatch(token)
        if plain:
            index, value = int(plain[1]), float(plain[2])
            if index > last and (self.low is None or index >= self.low) and (self.high is None or index <= self.high) and math.isfinite(value):
                out.index.append(index)
                out.value.append(value)
                return index
        left, colon, right = token.partition(":")
        if not (left and colon and right) or ":" in right:
            out.errors.append((1, at, token))
            return last
        index = self.index(out, left, at, last)
        value = number(right)
        if value is None:
            out.errors.append((3, at + len(left) + 1, right))
        elif index is not None:
            out.index.append(index)
            out.value.append(value)
        return last if index is None else index

    def index(self, out: Record, token: str, at: int, last: int) -> int | None:
        if _DIGITS.fullmatch(token):
            digits = token.lstrip("0") or "0"
            if len(digits) <= _LONGEST_INT:
                i = int(digits)
                if (self.low is None or i >= self.low) and (self.high is None or i <= self.high) and i < 1 << 63 and i > last:
                    return i
        out.errors.append((2, at, token))
        return None

    def comment(self, out: Record, text: str, at: int) -> None:
        if text.count('"') % 2:
            out.errors.append((4, at + text.rindex('"'), text[text.rindex('"') :]))
        said = _COUNT.search(text)
        if said and (len(said[1]) > _LONGEST_INT or int(said[1]) != out.n_pairs):
            out.errors.append((5, at + said.start(1), said[1]))


def parse_record(text: str, first: int | None = None, n_features: int | None = None) -> Record:
    """Parse one delivered line; one carriage return at its end is dropped.

    first and n_features bound the legal indices; None leaves that side open.
    """
    return _Parser(first, n_features).record(text[:-1] if text.endswith("\r") else text)


def parse_text(text: str, first: int | None = None, n_features: int | None = None):
    """Yield the records of a whole text, empty ones included, with their line numbers from 1.

    A comment's quoted part may run over line ends. Where its end is missing before the next
    anchor, the record ends with its own line and is reported with reason 'quote'.
    """
    parser, at, line = _Parser(first, n_features), 0, 1
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        hash_at = text.find("#", at, end)
        stop = end
        if hash_at >= 0 and text.count('"', hash_at, end) % 2:
            stop = _quote_end(text, end)
        out = parser.record(text[at:stop].removesuffix("\r"))
        out.line = line
        yield out
        line += text.count("\n", at, stop) + 1
        at = stop + 1


def anchor(text: str, at: int) -> int | None:
    """The first line start from at on where an anchor stands, None if there is none.

    at is taken for a line start. At an anchor outside of a well-formed quote a record begins,
    whatever went wrong before it.
    """
    while at < len(text):
        if _ANCHOR.match(text, at):
            return at
        end = text.find("\n", at)
        if end < 0:
            return None
        at = end + 1
    return None


def _quote_end(text: str, end: int) -> int:
    """Where the record ends whose quote is open at the line end given."""
    at = end
    while at < len(text):
        if _ANCHOR.match(text, at + 1):
            return end
        stop = text.find("\n", at + 1)
        stop = len(text) if stop < 0 else stop
        if text.count('"', at + 1, stop) % 2:
            return stop
        at = stop
    return end
