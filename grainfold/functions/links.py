"""Links and bullets in lines of Markdown, by scanning, and the concepts that link targets name."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

TITLE_ENDS = {'"': '"', "'": "'", "(": ")"}


@dataclass(frozen=True)
class Link:
    """A link in a line: where its label, its whole and its destination (with angle brackets) begin and end, and whether it has a title."""

    label: tuple[int, int]
    lead: int
    begin: int
    end: int
    titled: bool

    def target(self, line: str) -> str:
        return line[self.begin : self.end]


def past_blanks(line: str, at: int) -> int:
    while at < len(line) and line[at].isspace():
        at += 1
    return at


def destination_end(line: str, at: int) -> int:
    """End of the destination that begins here, or -1: up to the closing angle bracket, else to a blank or a round bracket."""
    if line[at : at + 1] == "<":
        return line.find(">", at) + 1 or -1
    while at < len(line) and not line[at].isspace() and line[at] not in "()":
        at += 1
    return at


def title_end(line: str, at: int) -> int:
    """End of the title in quotes or round brackets that begins here, or -1."""
    close = TITLE_ENDS.get(line[at : at + 1])
    end = line.find(close, at + 1) if close else -1
    return -1 if end < 0 or (close == ")" and "(" in line[at + 1 : end]) else end + 1


def inline_links(line: str) -> Iterator[Link]:
    """The links [label](destination "title") of a line, pictures too."""
    at = line.find("](")
    while at >= 0:
        lead = at + 2
        begin = past_blanks(line, lead)
        end = destination_end(line, begin)
        close = past_blanks(line, end) if end >= 0 else -1
        titled = False
        if close > end >= 0 and line[close : close + 1] not in ("", ")"):
            close = title_end(line, close)
            titled = close >= 0
            close = past_blanks(line, close) if titled else -1
        if close >= 0 and line[close : close + 1] == ")":
            yield Link((line.rfind("[", 0, at) + 1, at), lead, begin, end, titled)
            at = line.find("](", close)
        else:
            at = line.find("](", lead)


def definition(line: str) -> Link | None:
    """The destination of a definition [label]: destination, indented by three blanks at most."""
    start = len(line) - len(line.lstrip(" \t"))
    close = line.find("]", start)
    if start > 3 or line[start : start + 1] != "[" or close <= start + 1 or line[close + 1 : close + 2] != ":":
        return None
    begin = close + 2
    while line[begin : begin + 1] in (" ", "\t"):
        begin += 1
    end = line.find(">", begin) + 1 if line[begin : begin + 1] == "<" else 0
    if not end:
        end = begin
        while end < len(line) and not line[end].isspace():
            end += 1
    return Link((start + 1, close), close + 2, begin, end, False) if end > begin else None


def bullet(line: str) -> str | None:
    """What a list item says, without its sign and without a number in square brackets before it; None if the line is no item."""
    sign, _, rest = line.strip().partition(" ")
    numbered = sign[:-1].isdigit() and sign[-1:] in (".", ")")
    noted = sign[:1] == "[" and sign[-1:] == "]" and sign[1:-1].isdigit()
    if not rest or not (sign in ("-", "*", "+") or numbered or noted):
        return None
    rest = rest.strip()
    note, _, behind = rest.partition(" ")
    if behind and not noted and note[:1] == "[" and note[-1:] == "]" and note[1:-1].isdigit():
        rest = behind.strip()
    return rest


def has_scheme(target: str) -> bool:
    name, colon, _ = target.partition(":")
    return bool(colon) and name[:1].isascii() and name[:1].isalpha() and all(c.isascii() and (c.isalnum() or c in "+.-") for c in name)


def autolink(text: str) -> str | None:
    """The first address or path in angle brackets."""
    for piece in text.split("<")[1:]:
        inner, close, _ = piece.partition(">")
        if close and inner and not any(c.isspace() for c in inner) and (has_scheme(inner) or inner.startswith(("/", "./", "../"))):
            return inner
    return None


def bare_url(text: str) -> str | None:
    """The first web address, up to the next blank."""
    at = min((k for k in (text.find("http://"), text.find("https://")) if k >= 0), default=-1)
    found = text[at:].split(None, 1)[0] if at >= 0 else ""
    return found if found not in ("", "http://", "https://") else None


def prose(lines: list[str]) -> list[bool]:
    """Which lines are outside fenced code: a fence opens with three or more backticks or tildes, and only the same sign, at least as long, closes it."""
    fence, out = "", []
    for line in lines:
        bare = line.lstrip()
        mark = bare[: len(bare) - len(bare.lstrip(bare[:1]))] if bare[:1] in ("`", "~") else ""
        mark = mark if len(mark) >= 3 else ""
        out.append(not fence and not mark)
        if not fence:
            fence = mark
        elif mark and mark[0] == fence[0] and len(mark) >= len(fence):
            fence = ""
    return out


def resolve(target: str, directory: str) -> str | None:
    """Concept that a link target names, or None."""
    target = target.strip()
    if target.startswith("<") and target.endswith(">"):
        target = target[1:-1].strip()
    if not target or has_scheme(target):
        return None
    try:
        decoded = unquote(target, errors="strict") if re.fullmatch(r"(?:[^%]|%[0-9A-Fa-f]{2})*", target) else target
    except UnicodeDecodeError:
        decoded = target
    path = decoded.split("#")[0].split("?")[0]
    if not path.endswith(".md"):
        return None
    segments: list[str] = []
    for s in (path if path.startswith("/") or not directory else f"{directory}/{path}").split("/"):
        if s == "..":
            if not segments:
                return None
            segments.pop()
        elif s not in ("", "."):
            segments.append(s)
    return "/".join(segments).removeprefix("wiki/").removesuffix(".md")


def prose_targets(content: str) -> Iterator[str]:
    """Targets of the links and definitions outside fenced code, in order."""
    lines = content.replace("\r\n", "\n").split("\n")
    for line, shown in zip(lines, prose(lines)):
        if shown and "]" in line:
            yield from (x.target(line) for x in inline_links(line))
            if found := definition(line):
                yield found.target(line)
