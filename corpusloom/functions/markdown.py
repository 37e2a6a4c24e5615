"""A small CommonMark parser: the blocks at a document's top level, as plain text, and its links.

Kept: ATX and setext headings, fenced and indented code, lists, tables, quotes, HTML blocks and thematic breaks; inline
code, links, images, autolinks, emphasis, breaks and reference links.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`\s]*)[^`]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"( {0,3})([-*+]|(\d{1,9})([.)]))(?:([ \t]+)(.*)|[ \t]*)$")
QUOTE = re.compile(r" {0,3}> ?")
HTML = re.compile(r" {0,3}<(?:!--|[A-Za-z/?!])")
COMMENT = re.compile(r" {0,3}<!--")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
REFERENCE = re.compile(r" {0,3}\[([^\]]+)\]:[ \t]*<?(\S+?)>?(?:[ \t]+[\"'(].*)?$")
LINK = re.compile(r"(!?)\[((?:[^\[\]]|\[[^\]]*\])*)\](?:\(\s*<?([^\s)>]*)>?(?:\s+[\"'(][^)]*)?\)|\[([^\]]*)\])?")


@dataclass
class Block:
    type: str
    content: str
    level: int = 0
    language: str = ""


class Document:
    def __init__(self, text: str):
        self.references: dict[str, str] = {}
        self.links: list[tuple[str, str]] = []
        lines = text.expandtabs(4).replace("\r\n", "\n").split("\n")
        self.blocks = self.parse(lines)

    # --- blocks

    def parse(self, lines: list[str]) -> list[Block]:
        lines = self.take_references(lines)
        out, i = [], 0
        while i < len(lines):
            i = self.block(lines, i, out)
        return out

    def take_references(self, lines: list[str]) -> list[str]:
        kept, fenced = [], False
        for line in lines:
            fenced ^= bool(FENCE.match(line))
            m = None if fenced else REFERENCE.match(line)
            if m:
                self.references.setdefault(m[1].lower(), m[2])
            else:
                kept.append(line)
        return kept

    def starts(self, line: str) -> bool:
        """Does the line end a paragraph by what it begins?"""
        item = ITEM.match(line)
        return bool(ATX.match(line) or FENCE.match(line) or RULE.match(line) or QUOTE.match(line) or HTML.match(line) or (item and item[6] and (not item[3] or item[3] == "1")))

    def block(self, lines: list[str], i: int, out: list[Block]) -> int:
        line = lines[i]
        if not line.strip():
            return i + 1
        if m := ATX.match(line):
            out.append(Block("heading", self.inline(m[2] or ""), len(m[1])))
            return i + 1
        if m := FENCE.match(line):
            return self.fence(lines, i, m, out)
        if RULE.match(line):
            out.append(Block("thematic_break", line.strip()))
            return i + 1
        if line.startswith("    "):
            j = i
            while j < len(lines) and (lines[j].startswith("    ") or not lines[j].strip()):
                j += 1
            out.append(Block("code_block", "\n".join(x[4:] for x in lines[i:j]).rstrip()))
            return j
        if QUOTE.match(line):
            j = i
            while j < len(lines) and lines[j].strip() and (QUOTE.match(lines[j]) or not self.starts(lines[j])):
                j += 1
            inner = self.parse([QUOTE.sub("", x, count=1) for x in lines[i:j]])
            out.append(Block("blockquote", "\n".join(b.content for b in inner)))
            return j
        if ITEM.match(line):
            j = self.list_end(lines, i)
            out.append(Block("list", "\n".join(self.render_list(lines[i:j]))))
            return j
        if HTML.match(line):
            j = i + 1
            if COMMENT.match(line):
                while "-->" not in lines[j - 1] and j < len(lines):
                    j += 1
            else:
                while j < len(lines) and lines[j].strip():
                    j += 1
            out.append(Block("html", "\n".join(lines[i:j])))
            return j
        if "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and DELIMITER.match(lines[i + 1]):
            rows, j = [line], i + 2
            while j < len(lines) and lines[j].strip() and not self.starts(lines[j]):
                rows.append(lines[j])
                j += 1
            cells = [[self.inline(c.strip().replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", r.strip().removeprefix("|").removesuffix("|"))] for r in rows]
            out.append(Block("table", "\n".join(" | ".join(r) for r in cells)))
            return j
        j = i + 1
        while j < len(lines) and lines[j].strip() and not self.starts(lines[j]):
            if SETEXT.match(lines[j]):
                out.append(Block("heading", self.inline("\n".join(lines[i:j])), 1 if "=" in lines[j] else 2))
                return j + 1
            j += 1
        if j < len(lines) and SETEXT.match(lines[j]) and lines[j].strip():
            out.append(Block("heading", self.inline("\n".join(lines[i:j])), 1 if "=" in lines[j] else 2))
            return j + 1
        out.append(Block("paragraph", self.inline("\n".join(x.lstrip() for x in lines[i:j]))))
        return j

    def fence(self, lines: list[str], i: int, m: re.Match, out: list[Block]) -> int:
        close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
        j = i + 1
        while j < len(lines) and not close.match(lines[j]):
            j += 1
        indent = len(m[1])
        body = [x[min(indent, len(x) - len(x.lstrip(" "))) :] for x in lines[i + 1 : j]]
        out.append(Block("code_block", "\n".join(body), language=m[3]))
        return j + 1

    def list_end(self, lines: list[str], i: int) -> int:
        first = ITEM.match(lines[i])
        kind = first[4] or first[2]
        j, blank = i + 1, False
        while j < len(lines):
            line = lines[j]
            m = ITEM.match(line)
            if not line.strip():
                blank = True
            elif line.startswith("  ") or (m and (m[4] or m[2]) == kind and not RULE.match(line)):
                blank = False
            elif blank or self.starts(line):
                break
            j += 1
        while j > i and not lines[j - 1].strip():
            j -= 1
        return j

    def render_list(self, lines: list[str]) -> list[str]:
        """Markers are kept, numbers count from the first; what an item holds besides its text is indented."""
        items: list[list[str]] = []
        base = len(ITEM.match(lines[0])[1])
        width, start, mark = 0, None, ""
        for line in lines:
            m = ITEM.match(line)
            if m and len(m[1]) <= base + 1 and (not items or len(m[1]) < width):
                width = len(m[1]) + len(m[2]) + min(len(m[5] or " "), 4)
                if start is None:
                    start, mark = (int(m[3]) if m[3] else 0), (m[4] or m[2])
                items.append([m[6] or ""])
            else:
                items[-1].append(line[min(width, len(line) - len(line.lstrip(" "))) :])
        out = []
        for n, item in enumerate(items):
            marker = f"{max(1, start) + n}{mark} " if mark in ".)" else f"{mark} "
            own = []
            for b in self.parse(item):
                if b.type == "code_block":
                    own += [f"```{b.language}", *b.content.split("\n"), "```"]
                else:
                    own += b.content.split("\n")
            own = own or [""]
            out.append(marker + own[0])
            out += [" " * len(marker) + x if x else x for x in own[1:]]
        return out

    # --- inline text

    def inline(self, text: str) -> str:
        spans: list[str] = []

        def keep(value: str) -> str:
            spans.append(value)
            return f"\x00{len(spans) - 1}\x01"

        text = re.sub(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: keep(f"`{m[2].strip() if m[2].strip() else m[2]}`".replace("\n", " ")), text, flags=re.S)
        text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m[1]), text)
        text = re.sub(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>", lambda m: keep(m[1]), text)
        text = re.sub(r"</?[A-Za-z][^<>]*>|<!--.*?-->", lambda m: keep(m[0]), text, flags=re.S)
        text = LINK.sub(self.link, text)
        text = re.sub(r"(?: {2,}|\\)\n[ ]*", lambda m: keep("\n"), text)
        text = re.sub(r"[ ]*\n[ ]*", " ", text)
        for pattern in (r"(\*{1,3})(?=\S)(.+?)(?<=\S)\1", r"(?<!\w)(_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", r"(~~)(?=\S)(.+?)(?<=\S)\1"):
            before = None
            while before != text:
                before, text = text, re.sub(pattern, r"\2", text, flags=re.S)
        while "\x00" in text:
            text = re.sub("\x00(\\d+)\x01", lambda m: spans[int(m[1])], text)
        return text.strip()

    def link(self, m: re.Match) -> str:
        image, label, target, name = m[1], m[2], m[3], m[4]
        if target is None:
            target = self.references.get((name or label).lower())
            if target is None:
                return m[0]
        if not image:
            self.links.append((target, label))
        return label


def parse(text: str | None) -> Document:
    return Document(text or "")
