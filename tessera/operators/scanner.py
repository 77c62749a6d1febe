"""One pass over XML bytes: well-formedness diagnostics and a columnar structural index.

The scanner accepts a document in any number of pieces and gives the same result
for every way of cutting it. It works on lexemes: where a whole, faultless
construct (tag, text run, comment, CDATA section, processing instruction) lies in
the current piece one compiled pattern consumes it; anything else goes byte by byte
through small per-state handlers, which also hold what must survive a cut.

Positions are bytes; lines and columns start at 1. A newline belongs to the line it
ends, but counts as soon as its byte is read, so an element whose name is followed
by a newline is on the next line. ``end`` is exclusive. Depth starts at 0 for a root.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np

NO_PARENT = -1
UNKNOWN, PENDING = -1, -2

#: Messages and repairs of the diagnostics.
MESSAGES: dict[str, tuple[str, str | None]] = {
    "D01": ("Document contains more than one root element (<{0}>). XML 1.0 §2.1 [1] document ::= prolog element Misc*", "Wrap both elements in a single root element"),
    "D02": ("Malformed entity/character reference '&{0};'. XML 1.0 §4.1 [67] Reference", "Escape the ampersand as &amp;"),
    "D03": ("The sequence ']]>' is not allowed in element content. XML 1.0 §2.4 [14] CharData", "Escape as ]]&gt;"),
    "D04": ("Non-whitespace character data before the root element (or missing root). XML 1.0 §2.1", "Remove the stray text or move it inside the root element"),
    "D05": ("Non-whitespace character data after the root element. XML 1.0 §2.1 [27] Misc", "Remove the stray text or move it inside the root element"),
    "D06": ("Unterminated entity reference. XML 1.0 §4.1", "Escape the ampersand as &amp;"),
    "D07": ("Unescaped '&' (entity reference must be terminated by ';'). XML 1.0 §4.1 [68] EntityRef", "Replace '&' with '&amp;'"),
    "D08": ("'<' must be followed by an element name, '/', '?' or '!'. XML 1.0 §3.1 [40] STag", "Escape the '<' as &lt;"),
    "D09": ("Invalid character in element name. XML 1.0 §2.3 [5] Name", None),
    "D10": ("Unexpected character in start tag; expected attribute name, '/' or '>'. XML 1.0 §3.1 [40]", "Quote attribute values and separate attributes with whitespace"),
    "D11": ("Attribute '{0}' specified more than once. XML 1.0 §3.1 [WFC: Unique Att Spec]", "Remove the duplicate attribute"),
    "D12": ("Attribute '{0}' must be followed by '='. XML 1.0 §3.1 [41] Attribute", 'Insert =""'),
    "D13": ("Expected '=' after attribute name. XML 1.0 §3.1 [41]", 'Insert =""'),
    "D14": ("Attribute value must be quoted. XML 1.0 §3.1 [10] AttValue", "Enclose the value in double quotes"),
    "D15": ("'<' is not allowed in attribute values. XML 1.0 §3.1 [WFC: No < in Attribute Values]", "Escape as &lt;"),
    "D16": ("Expected '>' after '/' in empty-element tag. XML 1.0 §3.1 [44] EmptyElemTag", None),
    "D17": ("End tag must start with a name (no whitespace after '</'). XML 1.0 §3.1 [42] ETag", None),
    "D18": ("Unexpected end tag </{0}> — no element is open. XML 1.0 §3.1 [WFC: Element Type Match]", "Delete this end tag"),
    "D19": ("End tag </{0}> does not match start tag <{1}>. XML 1.0 §3.1 [WFC: Element Type Match]", None),
    "D20": ("Unexpected character in end tag. XML 1.0 §3.1 [42] ETag", None),
    "D21": ("Unknown markup declaration after '<!'. XML 1.0 §2.8 [29] markupdecl", None),
    "D22": ("Comment must start with '<!--'. XML 1.0 §2.5 [15] Comment", None),
    "D23": ("'--' is not allowed inside comments. XML 1.0 §2.5 [15]", "Replace '--' with '- -'"),
    "D24": ("Malformed CDATA section start; expected '<![CDATA['. XML 1.0 §2.7 [19] CDStart", None),
    "D25": ("Document is empty or has no root element. XML 1.0 §2.1 [1]", "Add a root element"),
    "D26": ("Unexpected end of file inside markup (unterminated tag, comment, CDATA or PI).", None),
    "D27": ("Unexpected end of file: {0} element(s) not closed: {1}", None),
}

_START = rb"A-Za-z_:\x80-\xff"
_NAME = rb"[" + _START + rb"][" + _START + rb"0-9.\-]*"
_S = rb"[ \t\r\n]"
_TAG = re.compile(rb"<(" + _NAME + rb")((?:" + _S + rb"+" + _NAME + _S + rb"*=" + _S + rb"*(?:\"[^\"<&]*\"|'[^'<&]*'))*)" + _S + rb"*(/?)>")
_ATTRIBUTE = re.compile(rb"(" + _NAME + rb")" + _S + rb"*=" + _S + rb"*(?:\"([^\"]*)\"|'([^']*)')")
_END = re.compile(rb"</(" + _NAME + rb")[ \t\r]*>")
_NAME_RUN = re.compile(rb"[" + _START + rb"0-9.\-]+")
_TEXT_STOP = re.compile(rb"[<&\]]")
_REFERENCE = re.compile(r"(?:#x[0-9a-fA-F]+|#[0-9]+|[A-Za-z_:][A-Za-z0-9_:.\-]*)\Z")
_WHITE = b" \t\r\n"
_IS_START = [chr(b).isalpha() and b < 128 or b in b"_:" or b >= 128 for b in range(256)]
_IS_NAME = [_IS_START[b] or b in b"0123456789-." for b in range(256)]
_REF_LIMIT, _ATTRIBUTE_LIMIT = 32, 64


@dataclass(frozen=True)
class ScanConfig:
    """Budgets. None means unlimited; ``contents`` also collects text, comment and attribute spans."""

    max_indexed: int | None = None
    stride: int = 32
    max_errors: int | None = None
    contents: bool = True
    fast: bool = True


@dataclass
class Diagnostic:
    code: str
    offset: int
    line: int
    col: int
    msg: str
    fix: str | None = None
    severity: str = "error"

    def __str__(self) -> str:
        return f"{self.severity}: Ln {self.line}, Col {self.col}: {self.msg}"


@dataclass
class Index:
    """Parallel lists, one entry an indexed element in document order, and totals over the whole document."""

    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    line: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    name: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    names: list[bytes] = field(default_factory=list)
    checkpoints: list[int] = field(default_factory=lambda: [0])
    errors: list[Diagnostic] = field(default_factory=list)
    #: (element, name, value start, value end)
    attributes: list[tuple[int, bytes, int, int]] = field(default_factory=list)
    #: (parent element, kind, start, end) of text, cdata, comment and pi
    contents: list[tuple[int, str, int, int]] = field(default_factory=list)
    stride: int = 32
    total_elements: int = 0
    total_attributes: int = 0
    max_depth: int = 0
    error_count: int = 0
    line_count: int = 1
    file_len: int = 0

    @property
    def indexed(self) -> int:
        return len(self.start)

    def name_of(self, i: int) -> str:
        return self.names[self.name[i]].decode("utf-8", "replace")

    def children_of(self, i: int) -> list[int]:
        return [c for c in range(i + 1, len(self.start)) if self.parent[c] == i]

    def seek_line(self, line: int) -> tuple[int, int]:
        """Checkpoint before a line (counted from 0) and the lines to skip from it."""
        block = min(line // self.stride, len(self.checkpoints) - 1)
        return self.checkpoints[block], line - block * self.stride

    def heap_bytes(self) -> int:
        """Size of the index as packed arrays."""
        return 34 * len(self.start) + 8 * len(self.checkpoints) + sum(24 + len(n) for n in self.names)


class Scanner:
    """Feed pieces in order, then ``finish``. ``index`` is usable at any time."""

    def __init__(self, config: ScanConfig = ScanConfig()):
        self.config, self.index = config, Index(stride=config.stride)
        self.limit = config.max_indexed if config.max_indexed is not None else 1 << 60
        self.error_limit = config.max_errors if config.max_errors is not None else 1 << 60
        self.seen, self.finished = 0, False
        self.line0, self.start0 = 1, 0  # line and its start before the current piece
        self.newlines: list[int] = []
        self.ids: dict[bytes, int] = {}
        self.open_ids: list[int] = []
        self.open_at: list[int] = []
        self.root_seen = self.root_closed = self.stray = False
        self.state, self.resume = self._bom, self._text
        self.matched = self.brackets = self.nesting = self.quote = 0
        self.tag_at = self.name_at = self.value_at = self.ref_at = 0
        self.text_at = 0
        self.buffer, self.reference = bytearray(), ""
        self.tag_names: list[bytes] = []
        self.current = self.closed_place = -1
        self.attribute = b""

    # positions ------------------------------------------------------------

    def _line(self, at: int) -> int:
        return self.line0 + bisect_right(self.newlines, at)

    def _line_start(self, at: int) -> int:
        n = bisect_right(self.newlines, at)
        return self.newlines[n - 1] + 1 if n else self.start0

    @property
    def line(self) -> int:
        return self.line0 + len(self.newlines)

    def progress(self) -> dict[str, int]:
        return {"line": self.line, "elements": self.index.total_elements, "errors": self.index.error_count}

    def report(self, code: str, offset: int, at: int, *names: str, fix: str | None = None) -> None:
        """``at`` is the byte being read when the fault shows; it decides line and column."""
        self.index.error_count += 1
        if len(self.index.errors) < self.error_limit:
            msg, usual = MESSAGES[code]
            self.index.errors.append(Diagnostic(code, offset, self._line(at), max(0, offset - self._line_start(at)) + 1, msg.format(*names), fix or usual))

    # elements -------------------------------------------------------------

    def _id(self, name: bytes) -> int:
        if (found := self.ids.get(name)) is None:
            found = self.ids[name] = len(self.ids)
            self.index.names.append(name)
        return found

    def _open(self, name: bytes, at: int) -> None:
        index, depth, name_id = self.index, len(self.open_ids), self._id(name)
        index.total_elements += 1
        if self.root_closed and not depth:
            self.report("D01", self.tag_at, at, name.decode("utf-8", "replace"))
        self.root_seen = True
        count, place = len(index.start), -1
        if (count < self.limit or depth <= 1) and count < 2 * self.limit:
            place = count
            index.start.append(self.tag_at)
            index.end.append(UNKNOWN)
            index.line.append(self._line(at))
            index.parent.append(self.open_at[-1] if depth else NO_PARENT)
            index.name.append(name_id)
            index.depth.append(depth)
        self.open_ids.append(name_id)
        self.open_at.append(place)
        if depth + 1 > index.max_depth:
            index.max_depth = depth + 1
        self.tag_names, self.current = [], place

    def _close(self, end: int) -> None:
        if self.open_ids:
            self.open_ids.pop()
            if (place := self.open_at.pop()) >= 0:
                self.index.end[place] = end
            self.closed_place = place
            if not self.open_ids:
                self.root_closed = True

    def _settle(self, end: int) -> None:
        """The end tag of the element closed last is complete."""
        place = self.closed_place
        if place >= 0 and self.index.end[place] == PENDING:
            self.index.end[place] = end

    def _keep(self, kind: str, start: int, end: int) -> None:
        if self.config.contents and end > start or kind != "text" and self.config.contents:
            self.index.contents.append((self.open_at[-1] if self.open_at else NO_PARENT, kind, start, end))

    # pieces ---------------------------------------------------------------

    def feed(self, piece: bytes) -> None:
        base, n = self.seen, len(piece)
        if not n:
            return
        self.newlines = (np.flatnonzero(np.frombuffer(piece, np.uint8) == 10) + base).tolist()
        first = self.line0
        for k in range(-(first) % self.config.stride, len(self.newlines), self.config.stride):
            self.index.checkpoints.append(self.newlines[k] + 1)
        i = 0
        while i < n:
            if self.config.fast and self.state == self._text and (j := self._lexeme(piece, i, base)) > i:
                i = j
                continue
            i += self.state(piece[i], base + i, piece, i)
        self.seen = base + n
        self.line0, self.start0, self.newlines = self.line, self._line_start(self.seen), []

    def _lexeme(self, piece: bytes, i: int, base: int) -> int:
        """Consume faultless constructs from a text position; returns where the first other one starts."""
        index, find = self.index, piece.find
        collect = self.config.contents
        while True:
            j = find(b"<", i)
            if j != i:
                if self.brackets:
                    return i
                run = piece[i : j if j >= 0 else len(piece)]
                if b"&" in run or b"]" in run or not self.open_ids and run.strip(_WHITE):
                    return i
                if j < 0:
                    return len(piece)
                i = j
            at = base + i
            mark = piece[i + 1 : i + 2]
            if mark == b"/":
                m = _END.match(piece, i)
                if not m or not self.open_ids or self.ids.get(m[1]) != self.open_ids[-1]:
                    return i
                self._text_ends(at)
                self._close(base + m.end())
                i = m.end()
            elif mark == b"!":
                if piece.startswith(b"<!--", i):
                    j = find(b"-->", i + 4)
                    if j < 0 or find(b"--", i + 4, j) >= 0 or j > i + 4 and piece[j - 1] == 45:
                        return i
                    self._text_ends(at)
                    self._keep("comment", at + 4, base + j)
                elif piece.startswith(b"<![CDATA[", i):
                    j = find(b"]]>", i + 9)
                    if j < 0:
                        return i
                    self._text_ends(at)
                    self._keep("cdata", at + 9, base + j)
                else:
                    return i
                i = j + 3
            elif mark == b"?":
                j = find(b"?>", i + 2)
                if j < 0:
                    return i
                self._text_ends(at)
                self._keep("pi", at + 2, base + j)
                i = j + 2
            else:
                m = _TAG.match(piece, i)
                if not m:
                    return i
                self._text_ends(at)
                self.tag_at = at
                self._open(m[1], base + m.end(1))
                if m.end(2) > m.start(2):
                    seen: set[bytes] = set()
                    for a in _ATTRIBUTE.finditer(piece, m.start(2), m.end(2)):
                        index.total_attributes += 1
                        if a[1] in seen:
                            after = a.end(1)
                            self.report("D11", base + a.start(1), base + after, a[1].decode("utf-8", "replace"))
                        elif len(self.tag_names) < _ATTRIBUTE_LIMIT:
                            seen.add(a[1])
                        if len(self.tag_names) < _ATTRIBUTE_LIMIT:
                            self.tag_names.append(a[1])
                        if collect and self.current >= 0:
                            value = 2 if a[2] is not None else 3
                            index.attributes.append((self.current, a[1], base + a.start(value), base + a.end(value)))
                if m[3]:
                    self._close(base + m.end())
                i = m.end()
            self.text_at = base + i
            self.brackets = 0
            if i >= len(piece):
                return i

    def _text_ends(self, at: int) -> None:
        if at > self.text_at and self.config.contents:
            self.index.contents.append((self.open_at[-1] if self.open_at else NO_PARENT, "text", self.text_at, at))

    # states: each reads one byte (or a run) and returns how many it consumed; 0 dispatches the byte again

    def _bom(self, b, at, piece, i):
        if self.matched == 0:
            if b != 0xEF:
                self.state = self._text
                return 0
        elif self.matched == 1:
            if b != 0xBB:
                self.state, self.text_at = self._text, at + 1
                return 1
        else:
            self.state = self._text
            self.text_at = at + (b == 0xBF)
            return int(b == 0xBF)
        self.matched += 1
        return 1

    def _to_text(self, at: int) -> None:
        self.state, self.text_at = self._text, at

    def _text(self, b, at, piece, i):
        if b == 60:
            self._text_ends(at)
            self.state, self.tag_at, self.brackets = self._less, at, 0
        elif b == 38:
            self._refer(at, self._text)
        elif b == 93:
            self.brackets += 1
        elif b == 62 and self.brackets >= 2:
            self.report("D03", max(0, at - 2), at)
            self.brackets = 0
        else:
            self.brackets = 0
            if not self.open_ids and b not in _WHITE and not self.stray:
                self.stray = True
                self.report("D05" if self.root_seen else "D04", at, at)
            elif self.open_ids:
                m = _TEXT_STOP.search(piece, i + 1)
                return (m.start() if m else len(piece)) - i
        return 1

    def _refer(self, at: int, back) -> None:
        self.resume, self.reference, self.ref_at, self.state = back, "", at, self._ref

    def _ref(self, b, at, piece, i):
        if b == 59:
            if not _REFERENCE.match(self.reference):
                self.report("D02", self.ref_at, at, self.reference)
            self.state = self.resume
        elif _IS_NAME[b] or b == 35:
            # the limit counts the UTF-8 bytes of the widened characters
            if len(self.reference.encode()) < _REF_LIMIT:
                self.reference += chr(b)
            else:
                self.report("D06", self.ref_at, at)
                self.state = self.resume
        else:
            self.report("D07", self.ref_at, at)
            self.state = self.resume
            return 0
        return 1

    def _less(self, b, at, piece, i):
        if b == 47:
            self.state, self.buffer = self._end_name, bytearray()
        elif b == 63:
            self.state = self._pi
        elif b == 33:
            self.state = self._bang
        elif _IS_START[b]:
            self.state, self.buffer = self._start_name, bytearray((b,))
        else:
            self.report("D08", at, at)
            self._to_text(self.tag_at)
        return 1

    def _name_run(self, piece, i) -> int:
        run = _NAME_RUN.match(piece, i)[0]
        self.buffer += run
        return len(run)

    def _start_name(self, b, at, piece, i):
        if _IS_NAME[b]:
            return self._name_run(piece, i)
        if b not in b" \t\r\n>/":
            self.report("D09", at, at)
        self._open(bytes(self.buffer), at)
        if b == 62:
            self._to_text(at + 1)
        else:
            self.state = self._empty if b == 47 else self._in_tag
        return 1

    def _in_tag(self, b, at, piece, i):
        if b in _WHITE:
            pass
        elif b == 62:
            self._to_text(at + 1)
        elif b == 47:
            self.state = self._empty
        elif _IS_START[b]:
            self.buffer, self.name_at, self.state = bytearray((b,)), at, self._attribute
        else:
            self.report("D10", at, at)
        return 1

    def _attribute(self, b, at, piece, i):
        if _IS_NAME[b]:
            return self._name_run(piece, i)
        name = bytes(self.buffer)
        self.attribute = name
        self.index.total_attributes += 1
        if name in self.tag_names:
            self.report("D11", self.name_at, at, name.decode("utf-8", "replace"))
        if len(self.tag_names) < _ATTRIBUTE_LIMIT:
            self.tag_names.append(name)
        if b == 61:
            self.state = self._before_value
        elif b in _WHITE:
            self.state = self._equals
        else:
            self.report("D12", at, at, name.decode("utf-8", "replace"))
            self.state = self._in_tag
            return 0
        return 1

    def _equals(self, b, at, piece, i):
        if b in _WHITE:
            return 1
        if b == 61:
            self.state = self._before_value
            return 1
        self.report("D13", at, at)
        self.state = self._in_tag
        return 0

    def _before_value(self, b, at, piece, i):
        if b in _WHITE:
            return 1
        if b in b"\"'":
            self.quote, self.value_at, self.state = b, at + 1, self._value
        else:
            self.report("D14", at, at)
            self.state = self._in_tag
        return 1

    def _value(self, b, at, piece, i):
        if b == self.quote:
            self.state = self._in_tag
            if self.current >= 0 and self.config.contents:
                self.index.attributes.append((self.current, self.attribute, self.value_at, at))
        elif b == 60:
            self.report("D15", at, at)
        elif b == 38:
            self._refer(at, self._value)
        return 1

    def _empty(self, b, at, piece, i):
        if b == 62:
            self._close(at + 1)
            self._to_text(at + 1)
        else:
            self.report("D16", at, at)
            self.state = self._in_tag
        return 1

    def _end_name(self, b, at, piece, i):
        if _IS_NAME[b]:
            return self._name_run(piece, i)
        if not self.buffer:
            self.report("D17", at, at)
            self.state = self._end_rest
            return 1
        self._match_end(bytes(self.buffer), at)
        if b == 62:
            self._settle(at + 1)
            self._to_text(at + 1)
        else:
            self.state = self._end_rest
        return 1

    def _match_end(self, name: bytes, at: int) -> None:
        name_id, shown = self._id(name), name.decode("utf-8", "replace")
        if not self.open_ids:
            self.report("D18", self.tag_at, at, shown)
        elif self.open_ids[-1] == name_id:
            self._close(PENDING)
        else:
            label = lambda k: self.index.names[k].decode("utf-8", "replace")
            expected = label(self.open_ids[-1])
            if name_id in self.open_ids:
                skipped = 0
                while self.open_ids[-1 - skipped] != name_id:
                    skipped += 1
                fix = "Insert " + "".join(f"</{label(k)}>" for k in self.open_ids[: -1 - skipped : -1])
            else:
                skipped, fix = 0, f"Change to </{expected}>"
            self.report("D19", self.tag_at, at, shown, expected, fix=fix)
            for _ in range(skipped + 1):
                self._close(at + 1)

    def _end_rest(self, b, at, piece, i):
        if b == 62:
            self._settle(at + 1)
            self._to_text(at + 1)
        elif b not in _WHITE:
            self.report("D20", at, at)
        return 1

    def _pi(self, b, at, piece, i):
        if b == 63:
            self.state = self._pi_end
            return 1
        j = piece.find(b"?", i)
        return (j if j >= 0 else len(piece)) - i

    def _pi_end(self, b, at, piece, i):
        if b == 62:
            self._keep("pi", self.tag_at + 2, at - 1)
            self._to_text(at + 1)
        elif b != 63:
            self.state = self._pi
        return 1

    def _bang(self, b, at, piece, i):
        if b == 45:
            self.state = self._comment_start
        elif b == 91:
            self.state, self.matched = self._cdata_start, 0
        elif b in b"Dd":
            self.state, self.nesting = self._doctype, 0
        else:
            self.report("D21", at, at)
            self._to_text(at + 1)
        return 1

    def _comment_start(self, b, at, piece, i):
        if b == 45:
            self.state = self._comment
        else:
            self.report("D22", at, at)
            self._to_text(at + 1)
        return 1

    def _comment(self, b, at, piece, i):
        if b == 45:
            self.state = self._comment_dash
            return 1
        j = piece.find(b"-", i)
        return (j if j >= 0 else len(piece)) - i

    def _comment_dash(self, b, at, piece, i):
        self.state = self._comment_dashes if b == 45 else self._comment
        return 1

    def _comment_dashes(self, b, at, piece, i):
        if b == 62:
            self._keep("comment", self.tag_at + 4, at - 2)
            self._to_text(at + 1)
        else:
            self.report("D23", max(0, at - 2), at)
            if b != 45:
                self.state = self._comment
        return 1

    def _cdata_start(self, b, at, piece, i):
        if b == b"CDATA["[self.matched]:
            self.matched += 1
            if self.matched == 6:
                self.state, self.matched = self._cdata, 0
        else:
            self.report("D24", at, at)
            self._to_text(at + 1)
        return 1

    def _cdata(self, b, at, piece, i):
        """``matched`` counts the closing brackets just seen, two at most."""
        if b == 93:
            self.matched = min(2, self.matched + 1)
        elif b == 62 and self.matched == 2:
            self._keep("cdata", self.tag_at + 9, at - 2)
            self._to_text(at + 1)
        else:
            self.matched = 0
            j = piece.find(b"]", i)
            return (j if j >= 0 else len(piece)) - i
        return 1

    def _doctype(self, b, at, piece, i):
        if b == 91:
            self.nesting += 1
        elif b == 93:
            self.nesting -= 1
        elif b == 62 and self.nesting <= 0:
            self._to_text(at + 1)
        return 1

    # end ------------------------------------------------------------------

    def finish(self) -> Index:
        if self.finished:
            return self.index
        self.finished, total = True, self.seen
        if not self.root_seen:
            self.report("D25", 0, total)
        if self.state not in (self._text, self._bom):
            self.report("D26", total, total)
        elif self.state == self._text:
            self._text_ends(total)
        if depth := len(self.open_ids):
            listed = [self.index.names[k].decode("utf-8", "replace") for k in self.open_ids[: -6 : -1]]
            self.report("D27", total, total, str(depth), ", ".join(f"<{n}>" for n in listed) + (", …" if depth > 5 else ""), fix="Append " + "".join(f"</{n}>" for n in listed))
            while self.open_ids:
                self._close(total)
        self.index.file_len, self.index.line_count = total, self.line
        return self.index

    def snapshot(self) -> Index:
        """The index so far, without closing anything."""
        self.index.file_len, self.index.line_count = self.seen, self.line
        return self.index


def scan_bytes(content: bytes, config: ScanConfig = ScanConfig()) -> Index:
    scanner = Scanner(config)
    if content:
        scanner.feed(content)
    return scanner.finish()
