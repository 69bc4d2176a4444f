"""Patterns as trees: what literals a match must hold, whether Java would recurse, and the pattern for other engines.

A node is a tuple whose first item names it:

    ("lit", character, caseless)      ("set", source, characters or None, caseless)
    ("anchor", source)                ("any", dotall)
    ("cat", nodes)                    ("alt", nodes)
    ("rep", node, least, most or None, lazy)
    ("group", head, node)

What the parser doesn't know raises ``Unparsed``; callers then do without.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .text import fold_literal

#: Strings that a set of literals may have; larger products are given up.
MOST = 16

#: A group repeated more often than this is one that Java matches by recursion.
SAFE_REPEATS = 50


class Unparsed(ValueError):
    """The parser doesn't know something in the pattern."""


#: Escapes that stand for one character.
CONTROLS = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "a": "\a", "v": "\v"}

_CLASS_ITEM = re.compile(r"\[:\^?\w+:\]|\\x\{[0-9A-Fa-f]+\}|\\x[0-9A-Fa-f]{2}|\\[pP](?:\{[^}]*\}|\w)|\\.|.", re.S)
_ESCAPE = re.compile(r"\\(?:x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|[pP](?:\{[^}]*\}|\w)|(.))", re.S)
_COUNT = re.compile(r"\{(\d+)(,?)(\d*)\}")
_HEAD = re.compile(r"\((?:\?(?:P?<[A-Za-z_]\w*>|([ims]*)(?:-([ims]+))?(:|\))))?")


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self) -> tuple:
        node = self.alternatives(frozenset())
        if self.i < len(self.p):
            raise Unparsed("an unopened bracket")
        return node

    def alternatives(self, flags: frozenset) -> tuple:
        options, items = [], []
        while self.i < len(self.p) and self.p[self.i] != ")":
            if self.p[self.i] == "|":
                options.append(("cat", items))
                items, self.i = [], self.i + 1
                continue
            set_flags = _HEAD.match(self.p, self.i)
            if set_flags and set_flags[3] == ")":
                flags = (flags | set(set_flags[1])) - set(set_flags[2] or "")
                self.i = set_flags.end()
                continue
            items.append(self.repeated(self.atom(flags)))
        options.append(("cat", items))
        return options[0] if len(options) == 1 else ("alt", options)

    def repeated(self, node: tuple) -> tuple:
        while self.i < len(self.p):
            c, most = self.p[self.i], None
            if c in "*+?":
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
                self.i += 1
            elif c == "{":
                m = _COUNT.match(self.p, self.i)
                if not m:
                    raise Unparsed("a brace that is no count")
                least = int(m[1])
                most = int(m[3]) if m[3] else None if m[2] else least
                self.i = m.end()
            else:
                break
            lazy = self.i < len(self.p) and self.p[self.i] == "?"
            self.i += lazy
            if self.i < len(self.p) and self.p[self.i] == "+":
                raise Unparsed("possessive repetition")
            node = ("rep", node, least, most, lazy)
        return node

    def atom(self, flags: frozenset) -> tuple:
        c, caseless = self.p[self.i], "i" in flags
        if c == "(":
            head = _HEAD.match(self.p, self.i)
            if not head or head[0] == "(" and self.p.startswith("(?", self.i):
                raise Unparsed("an unknown group")
            inner = (flags | set(head[1] or "")) - set(head[2] or "")
            self.i = head.end()
            node = self.alternatives(inner)
            if self.i == len(self.p):
                raise Unparsed("an unclosed group")
            self.i += 1
            return ("group", head[0], node)
        if c == "[":
            return self.set_(caseless)
        if c == "\\":
            m = _ESCAPE.match(self.p, self.i)
            if not m:
                raise Unparsed("a backslash ends the pattern")
            self.i = m.end()
            if m[1] or m[2]:
                return ("set", m[0], None, caseless)
            if m[3] is None or m[3] in "dDwWsShHV":
                return ("set", m[0], None, caseless)
            if m[3] in "bBAz":
                return ("anchor", m[0])
            if m[3] in CONTROLS:
                return ("lit", CONTROLS[m[3]], caseless)
            if m[3].isalnum():
                raise Unparsed(f"the escape {m[0]}")
            return ("lit", m[3], caseless)
        self.i += 1
        if c == ".":
            return ("any", "s" in flags)
        if c in "^$":
            if "m" in flags:
                return ("anchor", c + "m")
            return ("anchor", c)
        if c in "*+?{}":
            raise Unparsed(f"{c} without something to repeat")
        return ("lit", c, caseless)

    def set_(self, caseless: bool) -> tuple:
        start, self.i = self.i, self.i + 1
        negated = self.p.startswith("^", self.i)
        self.i += negated
        found: set[str] | None = set()
        last, first = None, True
        while True:
            m = _CLASS_ITEM.match(self.p, self.i)
            if not m:
                raise Unparsed("an unclosed class")
            item = m[0]
            if item == "]" and not first:
                self.i = m.end()
                break
            if item in ("[", "&&") or self.p.startswith("&&", self.i):
                raise Unparsed("classes in classes")
            self.i, first = m.end(), False
            if item == "-" and last and not self.p.startswith("]", self.i):
                m = _CLASS_ITEM.match(self.p, self.i)
                end = _one(m[0]) if m else None
                if end is None or ord(end) < ord(last):
                    raise Unparsed("an odd range")
                self.i = m.end()
                if found is not None:
                    found = found | {chr(x) for x in range(ord(last), ord(end) + 1)} if ord(end) - ord(last) < 4 * MOST else None
                last = None
                continue
            last = _one(item)
            found = found | {last} if found is not None and last is not None else None
        return ("set", self.p[start : self.i], None if negated or not found else frozenset(found), caseless)


def _one(item: str) -> str | None:
    """The character that an item of a class stands for, if it is one."""
    if len(item) == 1:
        return item
    if item[:1] == "\\" and len(item) == 2:
        return CONTROLS.get(item[1], None if item[1].isalnum() else item[1])
    return None


def parse(pattern: str) -> tuple:
    return _Parser(pattern).parse()


# --- what Java would do ----------------------------------------------------------


def recurses(node: tuple) -> bool:
    """Whether a group may be repeated so often that Java's matcher runs out of stack."""
    kind = node[0]
    if kind in ("cat", "alt"):
        return any(map(recurses, node[1]))
    if kind == "group":
        return recurses(node[2])
    if kind == "rep":
        inner = node[1]
        while inner[0] == "group" and inner[2][0] == "cat" and len(inner[2][1]) == 1:
            inner = inner[2][1][0]
        often = node[3] is None or node[3] > SAFE_REPEATS
        return often and (inner[0] not in ("lit", "set", "any", "anchor") or node[1][0] == "group") or recurses(node[1])
    return False


# --- literals ---------------------------------------------------------------------


@dataclass
class Known:
    """Of a node's matches: all of them, or what they begin and end with; and a set of which each holds one."""

    exact: frozenset | None
    starts: frozenset
    ends: frozenset
    held: frozenset | None


NOTHING = frozenset([""])
ANYTHING = Known(None, NOTHING, NOTHING, None)


def _all(strings: frozenset) -> Known:
    return Known(strings, strings, strings, strings)


def worth(strings: frozenset | None) -> tuple:
    """Longer is better, then fewer."""
    return (min(map(len, strings)), -len(strings)) if strings else (0, -MOST)


def _cross(a: frozenset, b: frozenset) -> frozenset | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= MOST else None


def _then(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and (both := _cross(a.exact, b.exact)) is not None:
        return _all(both)
    middle = _cross(a.ends, b.starts)
    starts = (_cross(a.exact, b.starts) if a.exact is not None else None) or a.starts
    ends = (_cross(a.ends, b.exact) if b.exact is not None else None) or b.ends
    return Known(None, starts, ends, max((a.held, b.held, middle, starts, ends), key=worth))


def _or(a: Known, b: Known) -> Known:
    def union(x: frozenset | None, y: frozenset | None) -> frozenset | None:
        return x | y if x is not None and y is not None and len(x | y) <= MOST else None

    exact = union(a.exact, b.exact)
    if exact is not None:
        return _all(exact)
    return Known(None, union(a.starts, b.starts) or NOTHING, union(a.ends, b.ends) or NOTHING, union(a.held, b.held))


def _character(c: str, caseless: bool, folded: bool) -> str | None:
    """What stands for the character in the text searched; None if it may be several things."""
    if caseless:
        # letters with partners that folding doesn't join: dotless and dotted i, long s
        return c.lower() if folded and c.isascii() and c not in "iIsS" else None
    return fold_literal(c) if folded else c


def known(node: tuple, folded: bool) -> Known:
    kind = node[0]
    if kind == "lit":
        c = _character(node[1], node[2], folded)
        return ANYTHING if c is None else _all(frozenset([c]))
    if kind == "set":
        if node[2] is None:
            return ANYTHING
        made = [_character(c, node[3], folded) for c in node[2]]
        return ANYTHING if None in made or len(made) > MOST else _all(frozenset(made))
    if kind == "anchor":
        return _all(NOTHING)
    if kind == "cat":
        out = _all(NOTHING)
        for part in node[1]:
            out = _then(out, known(part, folded))
        return out
    if kind == "alt":
        first, *rest = [known(part, folded) for part in node[1]]
        for part in rest:
            first = _or(first, part)
        return first
    if kind == "group":
        return known(node[2], folded)
    if kind == "rep":
        inner, least, most = known(node[1], folded), node[2], node[3]
        if most == 0:
            return _all(NOTHING)
        if least == 0:
            return _or(_all(NOTHING), inner) if most == 1 else ANYTHING
        out = inner
        for _ in range(min(least, 8) - 1):
            out = _then(out, inner)
        return out if least == most and least <= 8 else Known(None, out.starts, out.ends if least <= 8 else inner.ends, out.held)
    return ANYTHING


def required(pattern: str, folded: bool = False) -> list[str] | None:
    """Literals of which a match holds one, each of three characters or more; None if there are no such.

    ``folded``: literals in folded text, so caseless patterns have some too.
    """
    try:
        found = known(parse(pattern), folded)
    except Unparsed:
        return None
    best = max((found.held, found.starts, found.ends), key=worth)
    return sorted(best) if worth(best)[0] >= 3 else None


# --- other engines -----------------------------------------------------------------

#: Unicode's white space, and what Java counts as part of a word.
SPACE = r"\t-\r\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}"
LINE_ENDS = r"\n\r\x{85}\x{2028}\x{2029}"
INSIDE = {"d": r"\p{Nd}", "w": WORD, "s": SPACE, "h": r"\t\x{20}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"}
NEGATED = {"D": r"\P{Nd}"}


class Untranslated(ValueError):
    """The linear matcher has no such thing."""


def _quoted(c: str) -> str:
    return c if c.isalnum() or c in " _" or ord(c) > 127 else f"\\x{{{ord(c):X}}}"


def linear(node: tuple) -> str:
    """The pattern for a linear-time matcher with explicit Unicode classes; raises Untranslated for word bounds and the like."""
    kind = node[0]
    if kind == "lit":
        return f"(?i:{_quoted(node[1])})" if node[2] else _quoted(node[1])
    if kind == "any":
        return "(?s:.)" if node[1] else f"[^{LINE_ENDS}]"
    if kind == "anchor":
        if node[1] in ("^", r"\A"):
            return r"\A"
        if node[1] == r"\z":
            return r"\z"
        raise Untranslated(node[1])
    if kind == "set":
        made = _linear_set(node[1])
        return f"(?i:{made})" if node[3] else made
    if kind == "cat":
        return "".join(map(linear, node[1]))
    if kind == "alt":
        return "|".join(map(linear, node[1]))
    if kind == "group":
        return f"(?:{linear(node[2])})"
    _, inner, least, most, lazy = node
    if least > 1000 or (most or 0) > 1000:
        raise Untranslated("a count over 1000")
    count = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((least, most)) or f"{{{least},{'' if most is None else most}}}"
    return f"(?:{linear(inner)}){count}{'?' if lazy else ''}"


def _linear_set(source: str) -> str:
    if source[0] == "\\":
        if source[1] in INSIDE:
            return f"[{INSIDE[source[1]]}]"
        if source[1].lower() in INSIDE and source[1].isupper():
            return f"[^{INSIDE[source[1].lower()]}]"
        return _linear_item(source)
    body = source[1:-1]
    negated = body.startswith("^")
    out = []
    for m in _CLASS_ITEM.finditer(body, 1 if negated else 0):
        out.append("-" if m[0] == "-" else _linear_item(m[0]))
    if out and out[0] == "-":
        out[0] = r"\x{2D}"
    if out and out[-1] == "-":
        out[-1] = r"\x{2D}"
    return f"[{'^' if negated else ''}{''.join(out)}]"


def _linear_item(item: str) -> str:
    one = _one(item)
    if one is not None:
        return _quoted(one)
    if item.startswith(r"\x"):
        return f"\\x{{{item[2:].strip('{}')}}}"
    if item[1:] in INSIDE:
        return INSIDE[item[1:]]
    if item[1:] in NEGATED:
        return NEGATED[item[1:]]
    if re.fullmatch(r"\\[pP](\{(L|Lu|Ll|Lt|Lm|Lo|M|Mn|Mc|Me|N|Nd|Nl|No|P|Pc|Pd|Ps|Pe|Pi|Pf|Po|S|Sm|Sc|Sk|So|Z|Zs|Zl|Zp)\}|[LMNPSZ])", item):
        return item
    raise Untranslated(item)
