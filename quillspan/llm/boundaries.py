"""Natural boundaries of a text: sentences, headings, paragraphs, list items."""

from __future__ import annotations

import re
from typing import NamedTuple

# Abbreviations (folded, without the final point) after which a text goes on.
ABBREVIATIONS = frozenset(
    """al aprox art arts av bros ca cap caps cf ch col comp coord dr dra drs ed eds ej esp est fig figs
    gen gob hno ing inc jr lic ltd mr mrs ms no nro num núm op p pág págs par pp prof profa profs prov
    rev s sec sr sra sras sres srta ss st sto sta tab trad ud uds univ v vid viz vol vols vs"""
    .split()
)
OPENING = "¿¡«“‘\"'([{‹„"
CLOSING = "»”’\"')]}›"

SENTENCE, LINE, ITEM, PARAGRAPH, HEADING = 1, 2, 3, 4, 5

_ITEM = re.compile(r"(?:[-*•‣▪◦·–—+]|\(?\d{1,3}[.)]|\(?[a-zA-Z][)])[ \t ]+(?=\S)")
_NUMBERED = re.compile(r"\(?(?:\d{1,3}[.)]|[a-zA-Z][)])[ \t ]")
_HEADING = re.compile(r"#{1,6}[ \t]+\S|\d{1,3}(?:\.\d{1,3})+\.?[ \t]+\S")
_STOP = re.compile(r"([.!?…]+)([" + re.escape(CLOSING) + r"]*)(\s+)")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x85  ]|$)")
_TAIL = re.compile(r"[^\s" + re.escape(OPENING) + r"]*$")


class Boundary(NamedTuple):
    position: int
    strength: int


class _Line(NamedTuple):
    start: int  # first character that is not blank
    end: int  # after the last one
    text: str


def _lines(text: str) -> list[_Line | None]:
    """The lines of a text; None for a blank one."""
    out: list[_Line | None] = []
    for match in _LINE.finditer(text):
        if match.start() == match.end():
            break
        bare = match.group().strip()
        if bare:
            start = match.start() + len(match.group()) - len(match.group().lstrip())
            out.append(_Line(start, start + len(bare), bare))
        else:
            out.append(None)
    return out


def _ends(line: str) -> bool:
    return bool(re.search(r"[.!?…:][" + re.escape(CLOSING) + r"]*$", line))


def _continues(line: str) -> bool:
    """Whether a line reads as the rest of a sentence begun above it."""
    first = line.lstrip(OPENING)[:1]
    return first.islower() or first in ",;:)]" or (first.isdigit() and not _NUMBERED.match(line))


def _sentence_starts(block: str, base: int) -> list[int]:
    found = []
    for match in _STOP.finditer(block):
        stop, nxt = match.group(1), match.end()
        rest = block[nxt : nxt + 8]
        if not rest:
            continue
        opened = rest[0] in OPENING
        first = rest.lstrip(OPENING)[:1]
        if not first or first.islower() or not (first.isalnum() or opened or first in "-–—*•"):
            continue
        if "…" in stop or stop.startswith(".."):
            # a pause: only an opening mark shows that a new sentence follows
            if not opened or rest[0] == "(":
                continue
        elif stop == "." and not match.group(2):
            token = _TAIL.search(block, max(0, match.start() - 40), match.start())
            word = token.group() if token else ""
            if len(word) == 1 and word.isalpha() and word.isupper():
                continue
            if word.lower() in ABBREVIATIONS and not (opened and rest[0] in "¿¡«“"):
                continue
            if re.fullmatch(r"(?:[a-zA-Z]\.)+[a-zA-Z]", word):
                continue
        found.append(base + nxt)
    return found


def boundaries(text: str | None) -> list[Boundary]:
    """Where the natural units of ``text`` begin, in order, with their strength.

    The first unit's beginning is included. A line break inside a sentence is no
    boundary; a null or blank text has none.
    """
    if not text or not text.strip():
        return []
    lines = _lines(text)
    width = max((len(x.text) for x in lines if x), default=0)
    out: list[Boundary] = []
    block_start = None
    block_end = 0

    def close() -> None:
        if block_start is not None:
            body = text[block_start:block_end]
            for at in _sentence_starts(body, block_start):
                gap = text[:at].rstrip()
                out.append(Boundary(at, LINE if "\n" in text[len(gap) : at] else SENTENCE))

    before_blank, previous, previous_heading, previous_item = True, None, False, False
    for i, line in enumerate(lines):
        if line is None:
            before_blank = True
            continue
        following = lines[i + 1] if i + 1 < len(lines) else None
        item = bool(_ITEM.match(line.text)) and not _HEADING.match(line.text)
        if item and not before_blank and previous is not None and _NUMBERED.match(line.text):
            item = _ends(previous.text) or previous_item or previous_heading
        marked = bool(_HEADING.match(line.text)) and not _ends(line.text) and (before_blank or previous is None or _ends(previous.text) or previous_item or previous_heading)
        plain = (
            not item
            and (before_blank or previous_heading or (previous is not None and _ends(previous.text)))
            and not re.search(r"[.!?…,;:][" + re.escape(CLOSING) + r"]*$", line.text)
            and len(line.text) <= 80
            and line.text[:1] not in OPENING
            and not line.text[:1].islower()
            and (following is None and i + 1 < len(lines) or (following is not None and not _continues(following.text) and len(line.text) < 0.6 * width))
            and len(line.text.split()) <= 10
        )
        heading = marked or plain
        # below a line that may be a heading, a word in lower case shows that it was none
        starts = before_blank or item or heading or previous_heading
        if starts:
            close()
            out.append(Boundary(line.start, HEADING if heading else PARAGRAPH if before_blank and not item else ITEM))
            block_start = line.start
        block_end = line.end
        before_blank, previous, previous_heading, previous_item = False, line, heading, item or (previous_item and not starts)
    close()
    return sorted(set(out))
