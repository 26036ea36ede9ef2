"""Regular expressions over bytes, combined into one minimal deterministic automaton.

Supported: literals, escapes (\\xNN, \\n, \\t, \\r and quoted punctuation), classes with
ranges and negation, groups, alternation, * + ? and {m}, {m,}, {m,n}. Every rule is
parsed to a syntax tree, the trees to one position-less NFA, and that by subset
construction and partition refinement to transition arrays.
"""

from __future__ import annotations

from array import array

EVERY = frozenset(range(256))


class _Parser:
    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def parse(self):
        tree = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alternatives(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("or", branches)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("and", parts)

    def repeated(self):
        atom = self.atom()
        while (c := self.peek()) and c in "*+?{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                atom = ("times", atom, int(low), int(high) if high else None if comma else int(low))
            else:
                atom = ("times", atom, int(c == "+"), 1 if c == "?" else None)
        return atom

    def byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def cased(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found |= {b ^ 0x20 for b in found if 0x41 <= b & ~0x20 <= 0x5A}
        return frozenset(found)

    def atom(self):
        c = self.peek()
        if c == "(":
            self.i += 1
            if self.p.startswith("?:", self.i):
                self.i += 2
            tree = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            return tree
        if c == ".":
            self.i += 1
            return ("set", EVERY - {0x0A})
        if c != "[":
            return ("set", self.cased({self.byte()}))
        self.i += 1
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        while self.peek() != "]":
            low = self.byte()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                found |= set(range(low, self.byte() + 1))
            else:
                found.add(low)
        self.i += 1
        chosen = self.cased(found)
        return ("set", EVERY - chosen if negated else chosen)


def mirrored(tree):
    """The tree of the same words read backwards."""
    if tree[0] == "and":
        return ("and", [mirrored(x) for x in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [mirrored(x) for x in tree[1]])
    if tree[0] == "times":
        return ("times", mirrored(tree[1]), *tree[2:])
    return tree


def shortened(tree):
    """A tree whose words are the tree's words without what a last repetition may add: each match still has one at its start."""
    if tree[0] == "and" and tree[1]:
        return ("and", [*tree[1][:-1], shortened(tree[1][-1])])
    if tree[0] == "or":
        return ("or", [shortened(x) for x in tree[1]])
    if tree[0] == "times" and tree[2] and tree[3] != tree[2]:
        return ("times", tree[1], tree[2], tree[2])
    return tree


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Adds what leads from start through tree; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "and":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        if kind == "or":
            end = self.state()
            for x in tree[1]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(x, begin)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.add(inner, start)
        end = self.state()
        if high is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            self.free[loop].append(end)
            return end
        for _ in range(high - low):
            self.free[start].append(end)
            start = self.add(inner, start)
        self.free[start].append(end)
        return end

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Dfa:
    """table[state * 256 + byte] is the next state times 256; hits[state] holds the accepted rules.

    States from `accepting` on accept something; `dead` is the state that nothing leaves, or -1.
    """

    def __init__(self, table: list[int], hits: list[frozenset[int]], accepting: int, start: int, dead: int):
        self.table, self.hits = array("i", table), hits
        self.accepting, self.start, self.dead = accepting * 256, start * 256, dead * 256

    @property
    def size(self) -> int:
        return len(self.hits)


def determinise(trees: list, anywhere: bool) -> Dfa:
    """Subset construction over all rules at once; anywhere: a match may begin at every byte."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for rule, tree in enumerate(trees):
        begin = nfa.state()
        nfa.free[root].append(begin)
        ends[nfa.add(tree, begin)] = rule
    first = nfa.closed([root])
    number, order, rows = {first: 0}, [first], []
    for states in order:
        row = [0] * 256
        reach: dict[int, set[int]] = {}
        for s in states:
            for chosen, target in nfa.moves[s]:
                for b in chosen:
                    reach.setdefault(b, set()).add(target)
        known: dict[frozenset, int] = {}
        for b in range(256):
            targets = frozenset(reach.get(b, ()))
            if targets not in known:
                closed = nfa.closed(targets | ({root} if anywhere else set()))
                if closed not in number:
                    number[closed] = len(order)
                    order.append(closed)
                known[targets] = number[closed]
            row[b] = known[targets]
        rows.append(row)
    return _minimised(rows, [frozenset(ends[s] for s in states if s in ends) for states in order])


def _minimised(rows: list[list[int]], hits: list[frozenset[int]]) -> Dfa:
    """Refines classes of states until all states of a class move alike."""
    kinds = {h: i for i, h in enumerate(dict.fromkeys(hits))}
    group = [kinds[h] for h in hits]
    count = len(kinds)
    while True:
        seen: dict[tuple, int] = {}
        refined = [seen.setdefault((group[s], *(group[t] for t in row)), len(seen)) for s, row in enumerate(rows)]
        if len(seen) == count:
            break
        group, count = refined, len(seen)
    sample: dict[int, int] = {}
    for s, g in enumerate(group):
        sample.setdefault(g, s)
    order = sorted(sample, key=lambda g: (bool(hits[sample[g]]), sample[g]))
    place = {g: i for i, g in enumerate(order)}
    table = [place[group[t]] * 256 for g in order for t in rows[sample[g]]]
    final = [hits[sample[g]] for g in order]
    accepting = sum(not h for h in final)
    dead = next((i for i, g in enumerate(order) if not final[i] and all(group[t] == g for t in rows[sample[g]])), -1)
    return Dfa(table, final, accepting, place[group[0]], dead)


class CombinedScanner:
    """Leftmost-longest, non-overlapping matches of each rule, found in one pass over the bytes.

    One automaton of all rules runs over every byte and says where a match of some rule
    ends first. Only there, the rule's mirrored automaton goes back to the leftmost start
    (not before the rule's last match) and its own one forward to the longest end.
    """

    def __init__(self, rules: list[tuple[str, bool]]):
        trees = [_Parser(p, fold).parse() for p, fold in rules]
        self.all = determinise([shortened(t) for t in trees], anywhere=True)  # only where a match first ends matters
        self.own = [determinise([t], anywhere=False) for t in trees]
        self.back = [determinise([mirrored(t)], anywhere=False) for t in trees]
        self.rules = len(trees)

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, state times 256) wherever the combined automaton accepts."""
        table, accepting, state = self.all.table, self.all.accepting, self.all.start
        found = []
        for i, b in enumerate(data, 1):
            state = table[state + b]
            if state >= accepting:
                found.append((i, state))
        return found

    @staticmethod
    def _longest(dfa: Dfa, data: bytes) -> int:
        """Length of the longest accepted prefix, or -1."""
        table, accepting, state, dead = dfa.table, dfa.accepting, dfa.start, dfa.dead
        best = 0 if state >= accepting else -1
        for n, b in enumerate(data, 1):
            state = table[state + b]
            if state >= accepting:
                best = n
            elif state == dead:
                break
        return best

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes."""
        found = []
        last = [0] * self.rules
        view, hits = memoryview(data), self.all.hits
        for end, state in self.ends(data):
            for rule in hits[state >> 8]:
                if end <= last[rule]:
                    continue
                back = self._longest(self.back[rule], view[last[rule] : end][::-1])
                if back < 0:
                    continue
                start = end - back
                size = self._longest(self.own[rule], view[start:])
                found.append((start, start + size, rule))
                last[rule] = start + size
        return found
