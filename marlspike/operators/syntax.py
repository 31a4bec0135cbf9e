"""Source text by its syntax: what is code, string, pattern or comment, and the statements and members that brackets enclose.

One pass blanks out whatever is no code, so that brackets inside strings,
templates, patterns and comments no longer count; statements are then cut from the
blanked text, and contents are taken from the text itself.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

#: What stands for a character of a string, template or pattern in blanked text.
OPAQUE = "\x01"
_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|[`{}/]", re.S)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.S)
#: A division follows a value; anything else before a slash begins a pattern.
_VALUE = re.compile(r"(?:[\w$)\]}\x01])\s*\Z")
_WORD_BEFORE = re.compile(r"(?<![\w$.])(?:return|typeof|case|in|of|do|else|void|delete|throw|new|await|yield)\s*\Z")
_OPEN, _CLOSE = "([{", ")]}"
#: Characters and words that a statement does not end with, or the next does not begin with.
_GOES_ON = set("=+-*%&|^<>?:,.!~/")
_CONTINUES = set(".,?:=+-*%&|^<>)]([")
_NEEDS_MORE = re.compile(
    r"(?<![\w$.])(?:export|default|async|const|let|var|type|interface|class|function|extends|implements|new|typeof|await|from|of|in|instanceof|as|declare|abstract|namespace|enum|else|do|try|finally)\Z"
)
_BELONGS = re.compile(r"(?:else|catch|finally|instanceof|in|of|extends|implements|from|as|satisfies)\b")
_LOOP = re.compile(r"do\b")
#: Statements that end with the bracket that closes their body.
_DECLARES = re.compile(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|interface|enum|namespace|module|if|for|while|switch|try|do)\b|\{")
_DECORATED = re.compile(r"(?:@[\w$.]+(?:\([^@]*\))?\s*)+\Z")
_KIND = re.compile(r"(?:@[\w$.]+(?:\([^@]*?\))?\s*)*(export\b)?\s*(?:default\b)?\s*(?:declare\b)?\s*(?:abstract\b)?\s*(?:async\b)?\s*(import|function|class|interface|type|enum|const|let|var|export)\b\s*\*?\s*([\w$]+)?")
_FUNCTION = re.compile(r"[^=]*=\s*(?:async\b)?\s*(?:function\b|<[^=]*>\s*\(|\(|[\w$]+\s*=>)")
_MEMBER = re.compile(r"(?:@[\w$.]+(?:\([^@]*?\))?\s*)*(?:(?:public|private|protected|static|async|override|abstract|readonly|declare|accessor|get|set)\b\s*(?![(=:;?!]))*\*?\s*([#\w$]+|\[[^\]]*\]|\x01+)\s*[?!]?\s*(<|\()?")


def blanked(text: str) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with comments as spaces and literals as ``OPAQUE``, line breaks kept; and the comments as (start, end)."""
    out: list[str] = []
    comments: list[tuple[int, int]] = []
    at = done = 0
    braces: list[bool] = []  # open braces: whether a template goes on behind them
    keep = lambda s, c: "".join("\n" if x == "\n" else c for x in s)

    def put(end: int, c: str | None) -> None:
        nonlocal done
        out.append(text[done:end] if c is None else keep(text[done:end], c))
        done = end

    while m := _TOKEN.search(text, at):
        t, at = m[0], m.end()
        if t[0] == "{":
            braces.append(False)
        elif t[0] == "}" and not (braces and braces.pop()):
            continue
        elif t[0] in "`}":  # a template, from its start or behind a hole
            put(m.start(), None)
            end = _TEMPLATE.match(text, at)
            at = end.end()
            put(at, OPAQUE)
            if end[1] == "${":
                braces.append(True)
        elif t[:2] in ("//", "/*"):
            put(m.start(), None)
            put(at, " ")
            comments.append(m.span())
        elif t == "/":
            before = "".join(x[-40:] for x in out[-4:]) + text[max(done, m.start() - 40) : m.start()]
            if not _VALUE.search(before) or _WORD_BEFORE.search(before):
                if p := _PATTERN.match(text, m.start()):
                    put(m.start(), None)
                    at = p.end()
                    put(at, OPAQUE)
        else:
            put(m.start(), None)
            put(at, OPAQUE)
    put(len(text), None)
    return "".join(out), comments


@dataclass
class Item:
    """A statement or member: its place in the text, what it is, and its lines with the comment that belongs to it."""

    start: int
    end: int
    kind: str
    name: str
    exported: bool
    lines: tuple[int, int]  # the first, and past the last


_PUNCTUATION = re.compile(r"[()\[\]{};\n]")


@dataclass
class Source:
    """A text with its blanked twin and what is asked of it."""

    text: str
    bare: str = ""
    comments: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.bare, self.comments = blanked(self.text)
        self.lines = self.text.split("\n")
        self.at = list(accumulate((len(x) + 1 for x in self.lines), initial=0))
        # the first line of the block comment that ends in a line and begins one
        self.docs = {}
        for s, e in self.comments:
            first, last = self.line(s), self.line(max(s, e - 1))
            if self.text[s : s + 2] == "/*" and not self.text[self.at[first] : s].strip() and not self.bare[e : self.at[last + 1]].strip():
                self.docs[last] = first

    def line(self, at: int) -> int:
        return bisect_right(self.at, at) - 1

    def spans(self, start: int, end: int, members: bool) -> Iterator[tuple[int, int]]:
        """Statements, or members of a class, between two places, by brackets, semicolons and line ends."""
        bare, depth, first = self.bare, 0, self._code(start, end)
        at = start
        while first < end and (m := _PUNCTUATION.search(bare, at, end)):
            c, at = m[0], m.end()
            if c in _OPEN:
                depth += 1
            elif c in _CLOSE:
                depth = max(0, depth - 1)
                if c != "}" or depth:
                    continue
            if depth:
                continue
            if m.start() < first:
                continue
            so_far = bare[first:at].rstrip()
            after = self._code(at, end)
            following = bare[after : after + 12] if after < end else ""
            if c == ";":
                done = True
            elif c == "}":
                # a body closes what declares it, unless more of the head follows
                declares = "=" not in self._flat(first, at) if members else bool(_DECLARES.match(so_far))
                done = declares and following[:1] not in (_CONTINUES | {"{", ";"}) - {"[", "(", "*"} and not _BELONGS.match(following) and not (_LOOP.match(so_far) and following.startswith("while"))
            elif c == "\n":
                if not so_far or so_far[-1] in _GOES_ON or _NEEDS_MORE.search(so_far) or _DECORATED.fullmatch(so_far):
                    continue
                done = following[:1] not in (_CONTINUES - {"[", "*"} if members else _CONTINUES) | {"{"} and not _BELONGS.match(following)
            else:
                continue
            if done:
                yield first, first + len(so_far)
                first = after
        if first < end:
            yield first, first + len(bare[first:end].rstrip())

    def _code(self, start: int, end: int) -> int:
        """The next place that is no white space, or ``end``."""
        m = re.compile(r"\S").search(self.bare, start, end)
        return m.start() if m else end

    def _flat(self, start: int, end: int) -> str:
        """A span without what its brackets enclose."""
        out, depth = [], 0
        for c in self.bare[start:end]:
            if c in _OPEN:
                depth += 1
            elif c in _CLOSE:
                depth -= 1
            elif not depth:
                out.append(c)
        return re.sub(r"[=!<>]=+|=>", "", "".join(out))

    def _lines(self, start: int, end: int) -> tuple[int, int]:
        first = self.line(start)
        # the block comment that ends right above, blank lines and line comments between left aside
        above = first - 1
        while above >= 0 and above not in self.docs and not self.bare[self.at[above] : self.at[above + 1]].strip():
            above -= 1
        return self.docs.get(above, first), self.line(max(start, end - 1)) + 1

    def statements(self) -> list[Item]:
        out = []
        for s, e in self.spans(0, len(self.text), False):
            bare = self.bare[s:e]
            m = _KIND.match(bare)
            kind, name = (m[2], m[3] or "") if m else ("other", "")
            if kind in ("const", "let", "var"):
                kind = "function" if _FUNCTION.match(bare) else "variable"
            elif kind in ("export", "enum"):
                kind = "other"
            elif kind == "type" and not name:
                kind = "other"
            if kind in ("import", "other"):
                name = ""
            if bare != ";":
                out.append(Item(s, e, kind, name, bool(m and (m[1] or m[2] == "export")), self._lines(s, e)))
        return out

    def members(self, item: Item) -> list[Item]:
        """Methods and properties of a class."""
        body = self.bare.find("{", item.start, item.end)
        while body >= 0 and self._inside_head(item.start, body):
            body = self.bare.find("{", body + 1, item.end)
        out = []
        for s, e in self.spans(body + 1, item.end - 1, True) if body >= 0 else ():
            m = _MEMBER.match(self.bare[s:e])
            if m:
                name = self.text[s + m.start(1) : s + m.end(1)].strip("'\"")
                out.append(Item(s, e, "method" if m[2] else "property", name, False, self._lines(s, e)))
        return out

    def _inside_head(self, start: int, at: int) -> bool:
        """Whether a brace stands inside the type arguments of a class's head."""
        head = self.bare[start:at].replace("=>", "")
        return head.count("<") > head.count(">") or head.count("(") > head.count(")")

    def cut(self, lines: tuple[int, int]) -> str:
        return "\n".join(self.lines[slice(*lines)])


# What a class without a name is called, and the line between its fields and a method.
UNNAMED = "AnonymousClass"
ELLIPSIS = "  // ..."


def units(text: str) -> list[tuple[str, str, bool, str]]:
    """``(kind, name, exported, content)`` of a source text: imports together first, then statements in order, classes as their members.

    A unit has the lines of its statement, and the block comment right above. A
    method has the first line of its class and its properties before it. A class
    without members stays whole; export is no part of a statement's kind.
    """
    source = Source(text)
    items = source.statements()
    brought = [i for i in items if i.kind == "import"]
    out = []
    if brought:
        lines = source.line(brought[0].start), source.line(brought[-1].end - 1) + 1
        if sum(i.kind != "import" and lines[0] <= source.line(i.start) < lines[1] for i in items):  # others stand between them
            out.append(("module", "", False, "\n".join(source.cut((source.line(i.start), source.line(i.end - 1) + 1)) for i in brought)))
        else:
            out.append(("module", "", False, source.cut(lines)))
    for i in items:
        if i.kind == "import":
            continue
        members = source.members(i) if i.kind == "class" else []
        if not members:
            out.append((i.kind, i.name, i.exported, source.cut(i.lines)))
            continue
        name = UNNAMED if i.name in ("", "extends", "implements") else i.name
        fields = [source.cut((source.line(p.start), p.lines[1])) for p in members if p.kind == "property"]
        head = "\n".join([source.lines[source.line(i.start)].rstrip(), *fields, ELLIPSIS])
        for p in members:
            content = source.cut(p.lines)
            out.append((p.kind, f"{name}.{p.name}", i.exported, f"{head}\n{content}" if p.kind == "method" else content))
    return out
