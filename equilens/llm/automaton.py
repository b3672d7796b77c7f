"""Deterministic automata from regexes: subset construction, minimisation, transition arrays.

Syntax: literals, ``\\xHH`` and escaped characters, classes ``[...]`` with ranges, groups, ``|``,
``? * + {m} {m,} {m,n}`` and ``(?i:...)`` for ASCII letters in either case. Regexes are over bytes
and match greedily; they may not match the empty string.
"""

from __future__ import annotations

import numpy as np

FINAL = -1


class _Nfa:
    """Thompson automaton: per node its empty moves and its (byte set, next) moves."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def node(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1


def parse(pattern: str):
    """The regex as a tree: ('set', bytes), ('seq', parts), ('alt', parts), ('rep', part, lo, hi)."""
    at = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2:at], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def either(s: set[int], fold: bool) -> frozenset:
        return frozenset(s | {ord(chr(c).swapcase()) for c in s if fold and chr(c).isalpha()})

    def atom(fold: bool):
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = fold
            if pattern.startswith("?i:", at):
                at, inner = at + 3, True
            elif pattern.startswith("?:", at):
                at += 2
            tree = alternatives(inner)
            at += 1
            return tree
        if pattern[at] == "[":
            at += 1
            found: set[int] = set()
            invert = pattern[at] == "^"
            at += invert
            while pattern[at] != "]":
                lo = hi = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    hi = char()
                found.update(range(lo, hi + 1))
            at += 1
            s = either(found, fold)
            return "set", frozenset(range(256)) - s if invert else s
        return "set", either({char()}, fold)

    def counted(fold: bool):
        nonlocal at
        tree = atom(fold)
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                lo, _, hi = pattern[at:end].partition(",")
                span = int(lo), (int(lo) if "," not in pattern[at:end] else int(hi) if hi else None)
                at = end + 1
            else:
                span = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tree = "rep", tree, *span
        return tree

    def alternatives(fold: bool):
        nonlocal at
        parts, seq = [], []
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                parts.append(("seq", seq))
                seq = []
            else:
                seq.append(counted(fold))
        return "alt", [*parts, ("seq", seq)]

    return alternatives(False)


def _build(nfa: _Nfa, tree, start: int) -> int:  # noqa: ANN001
    """Adds the tree from node ``start`` on; returns the node behind it."""
    kind = tree[0]
    if kind == "set":
        end = nfa.node()
        nfa.moves[start].append((tree[1], end))
        return end
    if kind == "seq":
        for part in tree[1]:
            start = _build(nfa, part, start)
        return start
    end = nfa.node()
    if kind == "alt":
        for part in tree[1]:
            first = nfa.node()
            nfa.empty[start].append(first)
            nfa.empty[_build(nfa, part, first)].append(end)
        return end
    _, part, lo, hi = tree
    for _ in range(lo):
        start = _build(nfa, part, start)
    if hi is None:
        loop = nfa.node()
        nfa.empty[start].append(loop)
        nfa.empty[_build(nfa, part, loop)].append(loop)
        nfa.empty[loop].append(end)
        return end
    nfa.empty[start].append(end)
    for _ in range(hi - lo):
        start = _build(nfa, part, start)
        nfa.empty[start].append(end)
    return end


class Automaton:
    """Minimal automaton of several regexes. ``table[state, byte class]`` is the next state,
    ``accepts[state, rule]`` whether a match of the rule ends there. If ``anchored``, matches begin
    with the first byte, and state 0 is dead. Else they may begin at every byte, each is followed up
    to the first place where it could end, and state 0 is the start, where none is under way."""

    def __init__(self, patterns: list[str], anchored: bool):
        nfa = _Nfa()
        root = nfa.node()
        final: dict[int, int] = {}
        for i, p in enumerate(patterns):
            first = nfa.node()
            nfa.empty[root].append(first)
            final[_build(nfa, parse(p), first)] = i
        closed: dict[int, frozenset] = {}

        def closure(node: int) -> frozenset:
            if node not in closed:
                seen, todo = {node}, [node]
                while todo:
                    for m in nfa.empty[todo.pop()]:
                        if m not in seen:
                            seen.add(m)
                            todo.append(m)
                ends = frozenset(x for x in seen if x in final)
                closed[node] = ends if ends and not anchored else frozenset(x for x in seen if nfa.moves[x]) | ends
            return closed[node]

        # bytes that no move tells apart share a class
        sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
        member = np.array([[b in s for s in sets] for b in range(256)], dtype=bool)
        _, one_of, self.classes = np.unique(member, axis=0, return_index=True, return_inverse=True)
        self.classes = self.classes.reshape(-1).astype(np.uint8)
        start = closure(root)
        if any(x in final for x in start):
            raise ValueError("a rule matches the empty string")
        resting = frozenset() if anchored else start
        number = {resting: 0}
        number.setdefault(start, len(number))
        order = list(number)
        table: list[list[int]] = []
        for state in order:                                # grows while it is read
            row = []
            for b in one_of.tolist():
                to = frozenset().union(resting, *(closure(t) for x in state for s, t in nfa.moves[x] if b in s))
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            table.append(row)
        accepts = np.zeros((len(order), len(patterns)), dtype=bool)
        for i, state in enumerate(order):
            accepts[i, [final[x] for x in state if x in final]] = True
        self.start = number[start]
        self._minimise(np.array(table, dtype=np.int64), accepts)

    def _minimise(self, table: np.ndarray, accepts: np.ndarray) -> None:
        """Merges states that accept alike now and after every byte: blocks are split until the
        blocks reached agree within each. The state of index 0 keeps it."""
        block = np.unique(accepts, axis=0, return_inverse=True)[1].reshape(-1)
        count = block.max() + 1
        while True:
            seen = np.concatenate((block[:, None], block[table]), axis=1)
            block = np.unique(seen, axis=0, return_inverse=True)[1].reshape(-1)
            if block.max() + 1 == count:
                break
            count = block.max() + 1
        first = np.array([np.argmax(block == i) for i in range(count)])
        order = np.argsort(first)
        rename = np.empty(count, dtype=np.int64)
        rename[order] = np.arange(count)
        keep = first[order]
        self.table = rename[block[table[keep]]].astype(np.int32)
        self.accepts = accepts[keep]
        self.start = int(rename[block[self.start]])

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(first, last) end of a match of rule 0 that begins at ``at``; (-1, -1): none. For anchored
        automata."""
        state, first, last = self.start, -1, -1
        table, classes, accepts = self._rows()
        for i in range(at, len(data)):
            state = table[state][classes[data[i]]]
            if not state:
                break
            if accepts[state]:
                last = i + 1
                if first < 0:
                    first = last
        return first, last

    def _rows(self):
        if not hasattr(self, "_lists"):
            self._lists = self.table.tolist(), self.classes.tolist(), self.accepts[:, 0].tolist()
        return self._lists
