"""Regular expressions over bytes, compiled together into one minimal deterministic automaton.

The syntax is what secret rules need: literals, ``\\xNN`` and escaped characters, classes with ranges, groups, ``|``,
``? * + {m} {m,} {m,n}``. Compilation is by Thompson's construction, subset construction over classes of equivalent
bytes, and minimisation by partition refinement.
"""

from __future__ import annotations

from collections import defaultdict

EPS = None


class _Nfa:
    def __init__(self) -> None:
        self.out: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, on: frozenset[int] | None, b: int) -> None:
        self.out[a].append((on, b))


class _Parser:
    """Parse to a tree of ('set', bytes) | ('cat', [..]) | ('alt', [..]) | ('rep', node, least, most)."""

    def __init__(self, pattern: str, ignore_case: bool) -> None:
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def parse(self):
        node = self.alt()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} of {self.p!r}")
        return node

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alt(self):
        parts = [self.cat()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def cat(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.rep())
        return ("cat", parts)

    def rep(self):
        node = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.peek()
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)

    def folded(self, chars: set[int]) -> frozenset[int]:
        return frozenset(chars | {ord(chr(x).swapcase()) for x in chars if chr(x).isalpha() and x < 128}) if self.fold else frozenset(chars)

    def atom(self):
        if self.peek() == "(":
            self.i += 1
            node = self.alt()
            if self.peek() != ")":
                raise ValueError(f"no ) in {self.p!r}")
            self.i += 1
            return node
        if self.peek() == "[":
            self.i += 1
            chars: set[int] = set()
            while self.peek() != "]":
                a = self.char()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    chars |= set(range(a, self.char() + 1))
                else:
                    chars.add(a)
            self.i += 1
            return ("set", self.folded(chars))
        return ("set", self.folded({self.char()}))


def _build(nfa: _Nfa, node, a: int) -> int:
    """Add a node that starts in state a; the state it ends in."""
    kind = node[0]
    if kind == "set":
        b = nfa.state()
        nfa.arc(a, node[1], b)
        return b
    if kind == "cat":
        for x in node[1]:
            a = _build(nfa, x, a)
        return a
    if kind == "alt":
        b = nfa.state()
        for x in node[1]:
            s = nfa.state()
            nfa.arc(a, EPS, s)
            nfa.arc(_build(nfa, x, s), EPS, b)
        return b
    _, inner, low, high = node
    for _ in range(low):
        a = _build(nfa, inner, a)
    if high is None:
        s = nfa.state()
        nfa.arc(a, EPS, s)
        e = _build(nfa, inner, s)
        nfa.arc(e, EPS, s)
        return s
    end = nfa.state()
    nfa.arc(a, EPS, end)
    for _ in range(high - low):
        a = _build(nfa, inner, a)
        nfa.arc(a, EPS, end)
    return end


def _reverse(node):
    if node[0] == "cat":
        return ("cat", [_reverse(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [_reverse(x) for x in node[1]])
    if node[0] == "rep":
        return ("rep", _reverse(node[1]), *node[2:])
    return node


class Dfa:
    """States from 0, the start state; ``table[256 * state + byte]`` is 256 times the next state.

    Accepting states are those from ``accepting`` on; ``accepts[state]`` are the rules a state accepts. ``dead`` is
    the state that no match leaves, -1 if there is none.
    """

    def __init__(self, patterns: list[tuple[str, bool]], anchored: bool, backwards: bool = False) -> None:
        nfa = _Nfa()
        start = nfa.state()
        ends: dict[int, int] = {}
        for k, (pattern, fold) in enumerate(patterns):
            tree = _Parser(pattern, fold).parse()
            s = nfa.state()
            nfa.arc(start, EPS, s)
            ends[_build(nfa, _reverse(tree) if backwards else tree, s)] = k
        self._determinise(nfa, start, ends, anchored)

    def _determinise(self, nfa: _Nfa, start: int, ends: dict[int, int], anchored: bool) -> None:
        by_byte = defaultdict(set)
        sets = {on for arcs in nfa.out for on, _ in arcs if on is not EPS}
        for n, on in enumerate(sets):
            for b in on:
                by_byte[b].add(n)
        groups: dict[frozenset, list[int]] = defaultdict(list)
        for b in range(256):
            groups[frozenset(by_byte.get(b, ()))].append(b)
        classes = list(groups.values())

        def closed(states) -> frozenset[int]:
            todo, seen = list(states), set(states)
            while todo:
                for on, t in nfa.out[todo.pop()]:
                    if on is EPS and t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        first = closed({start})
        ids, todo, rows = {first: 0}, [first], []
        while todo:
            now = todo.pop(0)
            row = []
            for members in classes:
                b = members[0]
                to = {t for s in now for on, t in nfa.out[s] if on is not EPS and b in on}
                nxt = closed(to if anchored else to | {start})
                if nxt not in ids:
                    ids[nxt] = len(ids)
                    todo.append(nxt)
                row.append(ids[nxt])
            rows.append(row)
        accept = [frozenset(ends[s] for s in states if s in ends) for states in ids]
        # Moore's refinement: split by what is accepted, then by where each class of bytes leads.
        block = {a: n for n, a in enumerate(dict.fromkeys(accept))}
        part = [block[a] for a in accept]
        while True:
            seen: dict[tuple, int] = {}
            new = [seen.setdefault((part[s], *(part[t] for t in rows[s])), len(seen)) for s in range(len(rows))]
            if len(seen) == len(set(part)):
                break
            part = new
        some = {p: s for s, p in reversed(list(enumerate(part)))}
        order = sorted(some, key=lambda p: (bool(accept[some[p]]), p != part[0]))
        number = {p: n for n, p in enumerate(order)}
        self.start = number[part[0]]
        self.accepts = [tuple(sorted(accept[some[p]])) for p in order]
        self.accepting = sum(not a for a in self.accepts)
        flat = [0] * (256 * len(order))
        for p in order:
            for members, t in zip(classes, rows[some[p]], strict=True):
                for b in members:
                    flat[256 * number[p] + b] = 256 * number[part[t]]
        dead = [n for n in range(self.accepting) if all(flat[256 * n + b] == 256 * n for b in range(256))]
        self.dead = dead[0] if dead else -1
        shared = list(range(0, 256 * len(order), 256))  # one int object for each state
        self.table = [shared[x >> 8] for x in flat]

    def __len__(self) -> int:
        return len(self.accepts)


class Scanner:
    """All rules in one pass over the bytes: for each rule the leftmost longest matches that don't overlap.

    The combined automaton says where matches first end. From there the rule's reversed automaton finds where the
    match starts, no further back than the rule's last match ended, and its own automaton how far it goes on.
    """

    def __init__(self, rules: list[tuple[str, str, bool]]) -> None:
        self.names = [name for name, _, _ in rules]
        patterns = [(pattern, fold) for _, pattern, fold in rules]
        self.all = Dfa(patterns, anchored=False)
        self.forward = [Dfa([p], anchored=True) for p in patterns]
        self.back = [Dfa([p], anchored=True, backwards=True) for p in patterns]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by rule, then start."""
        table, first = self.all.table, 256 * self.all.accepting
        s, hits = 256 * self.all.start, []
        for i, b in enumerate(data, 1):
            s = table[s + b]
            if s >= first:
                hits.append((i, s >> 8))
        if not hits:
            return []
        out, done = [], [0] * len(self.names)
        accepts = self.all.accepts
        for i, state in hits:
            for k in accepts[state]:
                if i > done[k] and (start := self._start(k, data, i, done[k])) is not None:
                    done[k] = self._end(k, data, start)
                    out.append((start, done[k], k))
        return sorted(out, key=lambda x: (x[2], x[0]))

    def _start(self, k: int, data: bytes, end: int, least: int) -> int | None:
        dfa, found = self.back[k], None
        s, stop = 256 * dfa.start, 256 * dfa.dead
        for i in range(end - 1, least - 1, -1):
            s = dfa.table[s + data[i]]
            if s >= 256 * dfa.accepting:
                found = i
            elif s == stop:
                break
        return found

    def _end(self, k: int, data: bytes, start: int) -> int:
        dfa, end = self.forward[k], start
        s, stop = 256 * dfa.start, 256 * dfa.dead
        for i in range(start, len(data)):
            s = dfa.table[s + data[i]]
            if s >= 256 * dfa.accepting:
                end = i + 1
            elif s == stop:
                break
        return end
