"""Secret scan by one deterministic automaton for all rules.

Each rule's regex is parsed into a nondeterministic automaton. All of them, read backwards,
become one deterministic automaton by subset construction, which is minimised and stored as
an array of transitions, indexed by state and byte class. It reads each text's bytes once, from
the end, and tells of every byte which rules have a match that starts there. Ends come from
each rule's own deterministic automaton, run forward from the leftmost start until it fails, or is in a state at a place
from which an earlier run has failed:
spans are leftmost, longest and don't overlap within a kind. No regex library takes part.

The pass is made in many lanes at once, each a stretch of the bytes; a lane that doesn't start
in the state that the one before ends in is mended until both agree.

Positions are in code points. Null and empty texts have no spans. Every row is scanned for
itself, so repeated rows get repeated results. Columns with the names of results are replaced;
others stay as they are.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillspark.llm.common import appended

_WORD = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_PEM = r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"
# The base kinds first, in the order in which spans at one place are listed.
# (kind, pattern, what must be long: the whole match or its last run of characters, least length,
#  pattern by which starts are found, where that isn't the first one)
# A base match that is too short goes, and what it covers isn't looked at again for its kind.
# Counters stay out of the combined automaton where they would multiply its states; the rule's own has them.
RULES = (
    ("assign", _WORD + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", "run", 12, None),
    ("access", r"AKIA[A-Z0-9]+", "whole", 18, None),
    ("hex", r"[0-9a-f]+", "whole", 16, r"[0-9a-f]{16}"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "whole", 40, r"gh[pousr]_[A-Za-z0-9]"),
    ("slack", r"xox[abprs]-[A-Za-z0-9\-]{10,}", "whole", 15, r"xox[abprs]-[A-Za-z0-9\-]"),
    ("google", r"AIza[A-Za-z0-9_\-]{35,}", "whole", 39, r"AIza[A-Za-z0-9_\-]"),
    ("stripe", r"[sr]k_(live|test)_[A-Za-z0-9]{16,}", "whole", 24, r"[sr]k_(live|test)_[A-Za-z0-9]"),
    ("jwt", r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}", "whole", 30, r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]"),
    ("pem", _PEM + r"([A-Za-z0-9+/=\x20\t\n\r]+-----END ([A-Z]+ )*PRIVATE KEY-----)?", "whole", 1, _PEM),
    ("url", r"://[A-Za-z0-9._%+\-]+:[!-.0-9;-?A-~]{4,}@[A-Za-z0-9.\-]+", "whole", 4, r"://[A-Za-z0-9._%+\-]+:[!-.0-9;-?A-~]"),
)
KINDS = tuple(r[0] for r in RULES)
BASE = 3
#: Bytes of a pass that are in memory at a time, and lanes that they are read in.
SEGMENT, LANES = 1 << 20, 1024
#: A byte that UTF-8 doesn't have; it stands between texts.
_BETWEEN = 255


class _Nfa:
    """Automaton with empty moves, from a small regex language: sets, groups, |, ?, *, +, {n}, {n,}."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern, 0
        ends = self.choice()
        if self.at != len(pattern):
            raise ValueError(f"not understood from {self.at}: {pattern}")
        return ends

    def reversed(self) -> _Nfa:
        out = _Nfa()
        for _ in self.empty:
            out.state()
        for s in range(len(self.empty)):
            for t in self.empty[s]:
                out.empty[t].append(s)
            for chars, t in self.moves[s]:
                out.moves[t].append((chars, s))
        return out

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def choice(self) -> tuple[int, int]:
        parts = [self.row()]
        while self.peek() == "|":
            self.next()
            parts.append(self.row())
        if len(parts) == 1:
            return parts[0]
        first, last = self.state(), self.state()
        for a, b in parts:
            self.empty[first].append(a)
            self.empty[b].append(last)
        return first, last

    def row(self) -> tuple[int, int]:
        first = last = self.state()
        while self.peek() not in ("", "|", ")"):
            begin = self.at
            a, b = self.atom()
            mark = self.peek()
            if mark == "{":
                after = self.text.index("}", self.at) + 1
                times = self.text[self.at + 1 : after - 1]
                for _ in range(1, int(times.rstrip(","))):
                    self.at = begin
                    c, d = self.atom()
                    self.empty[b].append(c)
                    b, e = d, c
                if times.endswith(","):
                    self.empty[b].append(e if int(times[:-1]) > 1 else a)
                self.at = after
            elif mark and mark in "?*+":
                self.next()
                c, d = self.state(), self.state()
                self.empty[c].append(a)
                self.empty[b].append(d)
                if mark in "?*":
                    self.empty[c].append(d)
                if mark in "*+":
                    self.empty[b].append(a)
                a, b = c, d
            self.empty[last].append(a)
            last = b
        return first, last

    def one(self) -> int:
        c = self.next()
        if c != "\\":
            return ord(c)
        c = self.next()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def atom(self) -> tuple[int, int]:
        c = self.peek()
        if c == "(":
            self.next()
            ends = self.choice()
            self.next()
            return ends
        if c == "[":
            self.next()
            outside = self.peek() == "^"
            self.at += outside
            found: set[int] = set()
            while self.peek() != "]":
                low = self.one()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.next()
                    found.update(range(low, self.one() + 1))
                else:
                    found.add(low)
            self.next()
            chars = frozenset(set(range(256)) - found if outside else found)
        else:
            chars = frozenset([self.one()])
        a, b = self.state(), self.state()
        self.moves[a].append((chars, b))
        return a, b


class Automaton:
    """classes: byte -> class; step: state << bits | class -> state << bits; found: state -> rules that it accepts.

    States from final on (shifted) accept; with anywhere, a match may begin at any byte.
    """

    def __init__(self, nfa: _Nfa, starts: list[int], ends: dict[int, int], anywhere: bool):
        sets = sorted({m[0] for moves in nfa.moves for m in moves}, key=sorted)
        kinds: dict[tuple, int] = {(): 0}
        classes = [kinds.setdefault((*(b in s for s in sets),), len(kinds)) if b != _BETWEEN else 0 for b in range(256)]
        sample = [classes.index(c) for c in range(len(kinds))]

        def closed(states) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(s for s in seen if nfa.moves[s] or s in ends)

        closures = [closed([s]) for s in range(len(nfa.empty))]
        first = frozenset().union(*(closures[s] for s in starts))
        number, rows, rules, todo = {first: 0}, [], [], [first]
        for own in todo:  # subset construction
            rules.append(sum(1 << ends[s] for s in own if s in ends))
            row = [0]  # between texts all starts anew
            moves = [m for s in own for m in nfa.moves[s]]
            for b in sample[1:]:
                to = frozenset().union(first if anywhere else (), *(closures[t] for chars, t in moves if b in chars))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        self.subsets = len(rows)
        block = {r: i for i, r in enumerate(sorted(set(rules)))}
        part = [block[r] for r in rules]
        while True:  # minimisation: states with equal rules and equal next blocks stay together
            keys: dict[tuple, int] = {}
            finer = [keys.setdefault((part[s], *(part[t] for t in rows[s])), len(keys)) for s in range(len(rows))]
            if len(keys) == len(set(part)):
                break
            part = finer
        blocks: dict[int, int] = {}
        for s, p in enumerate(part):
            blocks.setdefault(p, s)
        order = sorted(blocks, key=lambda p: (rules[blocks[p]] != 0, blocks[p] != 0))
        at = {p: i for i, p in enumerate(order)}
        self.bits = max(1, (len(kinds) - 1).bit_length())
        self.classes = np.asarray(classes, "uint8")
        self.step = np.zeros(len(order) << self.bits, "int32")
        for p in order:
            for c, t in enumerate(rows[blocks[p]]):
                self.step[at[p] << self.bits | c] = at[part[t]] << self.bits
        self.found = np.asarray([rules[blocks[p]] for p in order])
        self.first = at[part[0]] << self.bits
        self.final = min((i for i, r in enumerate(self.found) if r), default=len(order)) << self.bits
        dead = number.get(frozenset())
        self.dead = -1 if dead is None else at[part[dead]] << self.bits
        self.steps, self.bytes_to = self.step.tolist(), bytes(classes)

    def longest(self, data: bytes, at: int, idle: set[int]) -> tuple[int, int]:
        """Of the matches that start there in data, given as byte classes, where the shortest and the longest end; -1 if there is none.

        idle: of every fourth byte, the states after it from which earlier runs over data came to no further end; a run that gets
        into one of them stops, so that no byte is read more than a few times, however many starts there are.
        """
        step, final, dead, s, states = self.steps, self.final, self.dead, self.first, len(self.steps)
        shortest = end = -1
        seen: list[int] = []
        for i in range(at, len(data)):
            s = step[s | data[i]]
            if s >= final:
                end = i + 1
                if shortest < 0:
                    shortest = end
                seen.clear()
            elif s == dead:
                break
            if not i & 3:
                key = i * states + s
                if key in idle:
                    break
                seen.append(key)
        idle.update(seen)
        return shortest, end

    def accepting(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places in data, read from its end, at which the automaton accepts, from the first on, and what it accepts there."""
        codes = self.classes[np.frombuffer(data, "uint8")[::-1]]
        s, step, places, got = self.first, self.steps, [], []
        for low in range(0, len(codes), SEGMENT):
            own = codes[low : low + SEGMENT]
            wide = -(-len(own) // LANES)
            lanes = -(-len(own) // wide)
            columns = np.zeros(lanes * wide, "int32")
            columns[: len(own)] = own
            columns = np.ascontiguousarray(columns.reshape(lanes, wide).T)
            states = np.empty((wide, lanes), "int32")
            now = np.full(lanes, self.first, "int32")
            now[0] = s
            at = np.empty(lanes, "int32")
            for j in range(wide):
                np.add(now, columns[j], out=at)
                now = np.take(self.step, at, out=states[j], mode="clip")
            for lane in range(1, lanes):
                s = int(states[-1, lane - 1])
                if s != self.first:
                    for j in range(wide):
                        s = step[s | int(columns[j, lane])]
                        if s == states[j, lane]:
                            break
                        states[j, lane] = s
            line = states.T.ravel()[: len(own)]
            s = int(line[-1])
            hits = np.flatnonzero(line >= self.final)
            places.append(len(codes) - 1 - low - hits)
            got.append(self.found[line[hits] >> self.bits])
        return np.concatenate([[], *places])[::-1].astype("int64"), np.concatenate([[], *got])[::-1].astype("int64")


class Scanner:
    """All rules: one automaton that reads backwards for starts, and one for each rule for ends."""

    def __init__(self, rules: tuple = RULES):
        nfa, starts, ends = _Nfa(), [], {}
        for k, (_, pattern, _, _, start) in enumerate(rules):
            a, b = nfa.add(start or pattern)
            starts.append(b)
            ends[a] = k
        self.starts = Automaton(nfa.reversed(), starts, ends, anywhere=True)
        self.ends = []
        for _, pattern, *_ in rules:
            own = _Nfa()
            a, b = own.add(pattern)
            self.ends.append(Automaton(own, [a], {b: 0}, anywhere=False))
        self.rules = rules

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) of each text's spans, in order."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        places, found = self.starts.accepting(bytes([_BETWEEN]).join(raw))
        edges = np.cumsum([0, *(len(r) + 1 for r in raw)])
        cuts = np.searchsorted(places, edges)
        return [self._spans(raw[i], places[a:b] - edges[i], found[a:b]) if b > a else [] for i, (a, b) in enumerate(pairwise(cuts.tolist()))]

    def _spans(self, data: bytes, places: np.ndarray, found: np.ndarray) -> list[tuple[int, int, int]]:
        out = []
        for k, (_, _, what, least, _) in enumerate(self.rules):
            at = 0
            starts = places[found >> k & 1 > 0].tolist()
            own, idle = data.translate(self.ends[k].bytes_to) if starts else b"", set()
            for start in starts:
                if start < at:
                    continue
                shortest, end = self.ends[k].longest(own, start, idle)
                if end < 0:
                    continue
                at = end
                if (end - start if what == "whole" else end - shortest + 1) >= least:
                    out.append((start, k, end))
        if out and not data.isascii():
            points = np.cumsum(np.r_[0, (np.frombuffer(data, "uint8") & 0xC0) != 0x80])
            out = [(int(points[a]), k, int(points[b])) for a, k, b in out]
        return sorted(out)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def found_in(text: str | None) -> list[tuple[int, int, int]]:
    return scanner()([text])[0]


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """docs, without text, with n_assign, n_access, n_hex, base_sha256 and spans."""
    scan = scanner()  # made once, sent with the tasks

    def make():
        def work(texts):
            rows = scan(texts)
            got = {f"n_{KINDS[k]}": [sum(s[1] == k for s in row) for row in rows] for k in range(BASE)}
            got["base_sha256"] = [hashlib.sha256(told([s for s in row if s[1] < BASE]).encode()).hexdigest() for row in rows]
            got["spans"] = [told(row) for row in rows]
            return got

        return work

    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:BASE]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return appended(docs, "text", make, fields, without=("text",))


def redact(text: str | None, spans: list[tuple[int, int, int]] | None = None) -> str | None:
    """text with each run of overlapping spans replaced by the kind of its first, in brackets."""
    spans = found_in(text) if spans is None else spans
    if not spans:
        return text
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with secrets in text replaced, and n_chars, if there, counted anew."""
    scan = scanner()

    def make():
        def work(texts):
            new = [redact(t, spans) for t, spans in zip(texts, scan(texts))]
            return {"text": new, "n_chars": [None if t is None else len(t) for t in new]}

        return work

    fields = [T.StructField("text", T.StringType())] + [T.StructField("n_chars", T.LongType())] * ("n_chars" in docs.columns)
    return appended(docs, "text", make, fields).select(docs.columns)
