"""The regular expressions of ``~=``: a dialect that can be matched in linear time.

Refused: groups' look-around, back references, ``\\p``, unknown letter
escapes, octal escapes, and counted repeats the wrong way round.  Matching is
unanchored and ignores case.

A pattern that can't make a backtracking matcher slow runs on the JVM's.  Any
other is run as a set of states that all advance by one character at a time
(``Automaton``), in Arrow batches: its time is in proportion to the text,
whatever the pattern.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.text import SPACE_CLASS, SPACE_CODES


class PatternError(ValueError):
    def __init__(self, message: str, offset: int):
        super().__init__(message)
        self.offset = offset


MAX_STATES = 4096
_CLASS_ESCAPES = {"d": "0-9", "w": "A-Za-z0-9_", "s": SPACE_CLASS}
_MEMBERS = {"d": [(48, 57)], "w": [(48, 57), (65, 90), (95, 95), (97, 122)], "s": [(c, c) for c in SPACE_CODES]}
_CONTROL = {"t": r"\t", "n": r"\n", "r": r"\r", "f": r"\f", "v": r"\x0B", "0": r"\x00"}
_CODES = {"t": 9, "n": 10, "r": 13, "f": 12, "v": 11, "0": 0}
#: Ways through a pattern without unbounded repeats up to which backtracking is harmless.
MAX_WAYS = 256

# A node of a pattern is a tuple: ("in", ranges, negated), where an entry of the ranges may itself be such a
# node; ("seq", nodes); ("alt", nodes); ("rep", node, low, high or None); ("at", one of ^ $ b B).
_ANY = ("in", [(10, 10), (13, 13), (0x2028, 0x2029)], True)


def _one(code: int) -> tuple:
    return ("in", [(code, code)], False)


class _Reader:
    def __init__(self, source: str):
        self.s, self.at, self.states, self.depth = source, 0, 0, 0

    def fail(self, message: str, at: int | None = None):
        raise PatternError(message, self.at if at is None else at)

    def peek(self) -> str:
        return self.s[self.at] if self.at < len(self.s) else ""

    def alternation(self) -> tuple[str, int, tuple]:
        parts, cost, nodes = [], 0, []
        while True:
            text, n, node = self.sequence()
            parts.append(text)
            nodes.append(node)
            cost += n + 1
            if self.peek() != "|":
                return "|".join(parts), cost, nodes[0] if len(nodes) == 1 else ("alt", nodes)
            self.at += 1

    def sequence(self) -> tuple[str, int, tuple]:
        out, cost, nodes = [], 0, []
        while self.peek() and self.peek() not in "|)":
            text, n, node = self.repeated(*self.atom())
            out.append(text)
            nodes.append(node)
            cost += n
            if cost > MAX_STATES:
                self.fail("the pattern is too large")
        return "".join(out), cost, ("seq", nodes)

    def atom(self) -> tuple[str, int, tuple]:
        c, begin = self.peek(), self.at
        self.at += 1
        if c in "*+?":
            self.fail("nothing to repeat", begin)
        if c == "(":
            if self.s.startswith("?", self.at):
                if not self.s.startswith("?:", self.at):
                    self.fail("look-around and named groups are not supported", begin)
                self.at += 2
            inner, n, node = self.alternation()
            if self.peek() != ")":
                self.fail("unclosed group")
            self.at += 1
            return f"(?:{inner})", n, node
        if c == "[":
            text, node = self.brackets(begin)
            return text, 1, node
        if c == "\\":
            text, node = self.escape(begin, False)
            return text, 1, node
        if c == ".":
            return r"[^\n\r\x{2028}\x{2029}]", 1, _ANY
        if c in "^$":
            return ("\\A" if c == "^" else "\\z"), 1, ("at", c)
        return ("\\" + c if c in "{}]#&~-" else c), 1, _one(ord(c))

    def escape(self, begin: int, in_class: bool) -> tuple[str, tuple]:
        c = self.peek()
        if not c:
            self.fail("a pattern cannot end in a backslash", begin)
        self.at += 1
        if c.lower() in _CLASS_ESCAPES:
            body = _CLASS_ESCAPES[c.lower()]
            node = ("in", _MEMBERS[c.lower()], c.isupper())
            if in_class and c.isupper():
                return f"[^{body}]", node
            return body if in_class else f"[{'^' if c.isupper() else ''}{body}]", node
        if c in "bB" and not in_class:
            word = "[A-Za-z0-9_]"
            edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
            return edge if c == "b" else f"(?!{edge})", ("at", c)
        if c == "0" and self.peek().isdigit() or c in "123456789":
            self.fail("back references and octal escapes are not supported", begin)
        if c in _CONTROL:
            return _CONTROL[c], _one(_CODES[c])
        if c in "xu":
            n = 2 if c == "x" else 4
            digits = self.s[self.at : self.at + n]
            if len(digits) < n or any(d not in "0123456789abcdefABCDEF" for d in digits):
                self.fail("a hexadecimal escape needs its digits", begin)
            self.at += n
            return f"\\u{int(digits, 16):04X}", _one(int(digits, 16))
        if c.isalpha():
            self.fail(f"the escape \\{c} is not supported", begin)
        return "\\" + c, _one(ord(c))

    def brackets(self, begin: int) -> tuple[str, tuple]:
        out, items = ["["], []
        if self.peek() == "^":
            out.append("^")
            self.at += 1
        empty = True
        while self.peek() != "]":
            c = self.peek()
            if not c:
                self.fail("unclosed character class", begin)
            self.at += 1
            text, node = self.escape(self.at - 1, True) if c == "\\" else ("\\" + c if c in "[&~^" else c, _one(ord(c)))
            out.append(text)
            items.append((node, c == "-"))
            empty = False
        self.at += 1
        if empty:
            return (r"[\s\S]" if len(out) > 1 else r"[^\s\S]"), ("in", [], len(out) > 1)
        return "".join(out) + "]", ("in", self.ranges([node for node, _ in items], [dash for _, dash in items]), out[1] == "^")

    def ranges(self, nodes: list[tuple], dash: list[bool]) -> list[tuple]:
        """Members of a class; a bare hyphen between two characters makes a range."""
        single = lambda k: not nodes[k][2] and len(nodes[k][1]) == 1 and nodes[k][1][0][0] == nodes[k][1][0][1]
        out, k = [], 0
        while k < len(nodes):
            if k + 2 < len(nodes) and dash[k + 1] and single(k) and single(k + 2):
                low, high = nodes[k][1][0][0], nodes[k + 2][1][0][0]
                if high < low:
                    self.fail("the class's range is the wrong way round")
                out.append((low, high))
                k += 3
            else:
                out += [nodes[k]] if nodes[k][2] else nodes[k][1]
                k += 1
        return out

    def repeated(self, text: str, n: int, node: tuple) -> tuple[str, int, tuple]:
        c, begin = self.peek(), self.at
        if c and c in "*+?":
            self.at += 1
        elif c == "{":
            end = self.s.find("}", self.at)
            body = self.s[self.at + 1 : end] if end > 0 else ""
            low, comma, high = body.partition(",")
            if not low.isdigit() or not (high.isdigit() or high == ""):
                return text, n, node
            if high and int(high) < int(low):
                self.fail("the repeat's bounds are the wrong way round", begin)
            self.at = end + 1
            n *= max(1, int(high or low))
            if n > MAX_STATES:
                self.fail("the pattern is too large", begin)
            bounds = (int(low), int(high) if high else None if comma else int(low))
            c = "{" + body + "}"
        else:
            return text, n, node
        if c in "*+?":
            bounds = (int(c == "+"), 1 if c == "?" else None)
        if self.peek() == "?":
            self.at += 1
            c += "?"
        if self.peek() and self.peek() in "*+":
            self.fail("nothing to repeat")
        return f"(?:{text}){c}", n + 1, ("rep", node, *bounds)


def _read(source: str) -> tuple[str, tuple]:
    reader = _Reader(source)
    text, _, node = reader.alternation()
    if reader.at < len(source):
        reader.fail("unmatched )")
    return f"(?iu){text}", node


def java_pattern(source: str) -> str:
    """The pattern in Java's syntax; raises ``PatternError`` with the offset of what is refused."""
    return _read(source)[0]


def _ways(node: tuple) -> float:
    """How many ways a backtracking matcher can go through a node from one place; infinite with an unbounded repeat."""
    match node:
        case ("seq", nodes):
            out = 1.0
            for x in nodes:
                out *= _ways(x)
            return out
        case ("alt", nodes):
            return float(sum(map(_ways, nodes)))
        case ("rep", inner, low, high):
            return float("inf") if high is None or high > MAX_WAYS else sum(_ways(inner) ** k for k in range(low, high + 1))
    return 1.0


def is_harmless(source: str) -> bool:
    """Whether backtracking costs a bounded number of steps a character.  An unbounded repeat of one class at the very end is harmless too: it succeeds with its least count."""
    _, node = _read(source)
    if node[0] == "seq" and node[1] and node[1][-1][0] == "rep" and node[1][-1][1][0] == "in":
        _, inner, low, _ = node[1][-1]
        node = ("seq", [*node[1][:-1], ("rep", inner, low, low)])
    return _ways(node) <= MAX_WAYS


def _variants(char: str) -> set[int]:
    """A character's code, that of its upper case, and that of the lower case of this; only single characters count."""
    upper = char.upper() if len(char.upper()) == 1 else char
    lower = upper.lower() if len(upper.lower()) == 1 else upper
    return {ord(char), ord(upper), ord(lower)}


def _holds(members: list, negated: bool, codes: set[int]) -> bool:
    hit = any(_holds(m[1], m[2], codes) if m[0] == "in" else any(m[0] <= c <= m[1] for c in codes) for m in members)
    return hit != negated


class Automaton:
    """Whether a text holds a match, by all states at once.

    Sets of states are numbered as they turn up, and what each does on a
    character is kept, up to ``KEPT`` entries; then both start anew.
    """

    KEPT = 20_000

    def __init__(self, source: str):
        self.goes: list[list[int]] = []  # free moves
        self.tests: list[tuple | None] = []  # what a state takes: a class, or a place
        self.then: list[int] = []
        self.end = self._state()
        self.begin = self._build(_read(source)[1], self.end)
        self._forget()

    def _state(self, test: tuple | None = None, then: int = -1) -> int:
        self.goes.append([])
        self.tests.append(test)
        self.then.append(then)
        return len(self.goes) - 1

    def _build(self, node: tuple, after: int) -> int:
        """The state from which a node leads to ``after``."""
        match node:
            case ("in", *_) | ("at", _):
                folded = ("in", [m if m[0] == "in" or m[0] != m[1] else (v, v) for m in node[1] for v in ([0] if m[0] == "in" or m[0] != m[1] else _variants(chr(m[0])))], node[2]) if node[0] == "in" else node
                return self._state(folded, after)
            case ("seq", nodes):
                for x in reversed(nodes):
                    after = self._build(x, after)
                return after
            case ("alt", nodes):
                s = self._state()
                self.goes[s] = [self._build(x, after) for x in nodes]
                return s
        _, inner, low, high = node
        if high is None:
            loop = self._state()
            self.goes[loop] = [self._build(inner, loop), after]
            after = loop
        else:
            final = after
            for _ in range(high - low):
                s = self._state()
                self.goes[s] = [self._build(inner, after), final]
                after = s
        for _ in range(low):
            after = self._build(inner, after)
        return after

    def _forget(self) -> None:
        self.sets: list[tuple[frozenset[int], str]] = []  # states, and what came before: "^", "w" or "-"
        self.number: dict[tuple[frozenset[int], str], int] = {}
        self.moves: dict[tuple[int, str], int] = {}

    def _id(self, states: frozenset[int], before: str) -> int:
        key = (states, before)
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
        return self.number[key]

    def _move(self, now: int, char: str) -> int:
        """The set after a character; -1 where a match ended before it.  An empty ``char`` is the end of the text."""
        states, before = self.sets[now]
        word = char != "" and (char == "_" or char.isascii() and char.isalnum())
        edge = (before == "w") != word
        place = {"^": before == "^", "$": char == "", "b": edge, "B": not edge}
        seen, todo, after = set(states), list(states), set()
        codes = _variants(char) if char else set()
        while todo:
            s = todo.pop()
            if s == self.end:
                return -1
            test = self.tests[s]
            reached = self.goes[s] if test is None else [self.then[s]] if test[0] == "at" and place[test[1]] else []
            if test is not None and test[0] == "in" and char and _holds(test[1], test[2], codes):
                after.add(self.then[s])
            for t in reached:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return self._id(frozenset(after | {self.begin}), "w" if word else "-")

    def search(self, text: str) -> bool:
        now = self._id(frozenset([self.begin]), "^")
        for char in [*text, ""]:
            after = self.moves.get((now, char))
            if after is None:
                if len(self.moves) >= self.KEPT:
                    kept = self.sets[now]
                    self._forget()
                    now = self._id(*kept)
                after = self.moves[now, char] = self._move(now, char)
            if after < 0:
                return True
            now = after
        return False


def _any_found(source: str) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = Automaton(source).search
        for values in batches:
            yield pd.Series([v is not None and any(x is not None and search(x) for x in ([v] if isinstance(v, str) else v)) for v in values], dtype=bool)

    return run


def found(source: str, value: Column, many: bool) -> Column:
    """Whether a value, or with ``many`` some value of an array, holds a match; false for null."""
    if is_harmless(source):
        test = lambda v: v.rlike(java_pattern(source))
        return F.coalesce(F.exists(value, test) if many else test(value), F.lit(False))
    # ``run``'s hints are strings here, so the kind of function is given by annotations that exist.
    run = _any_found(source)
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "boolean")(value)
