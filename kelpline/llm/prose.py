"""The prose blocks of notebook cells: paragraphs, quote blocks, list items and headings, with offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The cell kinds (lower-cased) that hold text.
TEXT_KINDS = ("text", "markdown", "md")

LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]+|$)")
QUOTE = re.compile(r"[ \t]{0,3}(?:>[ \t]?)+")
BULLET = re.compile(r"[ \t]*[-*+•](?:[ \t]+|$)")
NUMBER = re.compile(r"[ \t]*(\d{1,9})[.)](?:[ \t]+|$)")
IMAGE = re.compile(r"(?:\s*(?:!\[[^\]]*\]\([^)\s]*(?:\s+\"[^\"]*\")?\)|<img\b[^>]*>))+\s*$")
RULE = re.compile(r"[ \t]{0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
UNDERLINE = re.compile(r"[ \t]{0,3}(?:=+|-{2,})[ \t]*$")
DELIMITER = re.compile(r"\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$")
MATH = re.compile(r"\s*(\$\$|\\\[|\\begin\{(\w+\*?)\})")


#: Characters that a line with a marker of its own may begin with.
SPECIAL = set("`~$\\|!<#=-*_>+•:0123456789")


def _lines(text: str) -> list[tuple[int, str]]:
    """(offset, line without its break); CR, LF and CRLF are breaks."""
    if text.count("\r") != text.count("\r\n"):
        return [(m.start(), m.group().rstrip("\r\n")) for m in LINE.finditer(text) if m.group()]
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line[:-1] if line.endswith("\r") else line))
        at += len(line) + 1
    return out


@dataclass(slots=True)
class Block:
    kind: str  # 'p' paragraph, 'q' quote, 'l' list item, 'h' heading
    spans: list[tuple[int, int]]  # of each line's content within the cell

    @property
    def start(self) -> int:
        return self.spans[0][0]

    @property
    def end(self) -> int:
        return self.spans[-1][1]


def blocks(text: str) -> list[Block]:
    """The prose blocks of one text cell. Fenced code, tables, display formulas, image lines and rules are
    passed over; a block goes on over lines without a marker of their own."""
    out: list[Block] = []
    lines = _lines(text)
    i, now = 0, None
    while i < len(lines):
        at, line = lines[i]
        bare = line.strip()
        i += 1
        if not bare:
            now = None
            continue
        if bare[0] not in SPECIAL and "|" not in line:
            if now is None:
                now = Block("p", [])
                out.append(now)
            now.spans.append((at, at + len(line)))
            continue
        if m := FENCE.match(line):
            mark = m.group(1)
            while i < len(lines):
                inner = lines[i][1].strip()
                i += 1
                if inner and set(inner) == {mark[0]} and len(inner) >= len(mark):
                    break
            now = None
            continue
        if m := MATH.match(line):
            close = {"$$": "$$", "\\[": "\\]"}.get(m.group(1), f"\\end{{{m.group(2)}}}")
            rest = line[m.end() :]
            while close not in rest and i < len(lines):
                rest = lines[i][1]
                i += 1
            now = None
            continue
        if bare.startswith("|") or DELIMITER.match(line) or (i < len(lines) and "|" in line and DELIMITER.match(lines[i][1])):
            while i < len(lines) and "|" in lines[i][1]:
                i += 1
            now = None
            continue
        if IMAGE.match(line):
            now = None
            continue
        if m := HEADING.match(line):
            span = (at + m.end(), at + len(re.sub(r"[ \t]+#+[ \t]*$", "", line)))
            if span[1] > span[0]:
                out.append(Block("h", [span]))
            now = None
            continue
        if now and now.kind == "p" and len(now.spans) == 1 and UNDERLINE.match(line) and len(bare) >= 3:
            now.kind, now = "h", None
            continue
        if RULE.match(line):
            now = None
            continue
        if m := QUOTE.match(line):
            span = (at + m.end(), at + len(line))
            if not line[m.end() :].strip():
                now = None
            elif now and now.kind == "q":
                now.spans.append(span)
            else:
                now = Block("q", [span])
                out.append(now)
            continue
        m = BULLET.match(line)
        if not m and (n := NUMBER.match(line)) and (now is None or now.kind == "l" or n.group(1) == "1"):
            m = n
        if m:
            now = Block("l", [(at + m.end(), at + len(line))])
            out.append(now)
            continue
        if now is None:
            now = Block("p", [])
            out.append(now)
        now.spans.append((at, at + len(line)))
    return [b for b in out if text[b.start : b.end].strip()]


def text_cells(text: str, cells) -> list[tuple[int, int]]:
    """(start, end) of the text cells, cut to the text; cells with null or empty ranges are passed over."""
    out = []
    for c in cells if cells is not None else ():
        if c is None or c["kind"] is None or c["start_pos"] is None or c["end_pos"] is None:
            continue
        if c["kind"].strip().lower() in TEXT_KINDS:
            a, b = max(0, int(c["start_pos"])), min(len(text), int(c["end_pos"]))
            if b > a:
                out.append((a, b))
    return out
