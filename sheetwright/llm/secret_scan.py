"""Secret scan by one combined deterministic automaton.

Rule regexes become nondeterministic automata over bytes; subset construction makes one deterministic
automaton for all rules, minimisation shrinks it to transition arrays. It reads rules from right to left and is
walked once over the UTF-8 bytes of a text, last byte first: wherever it accepts, matches of the accepted rules
begin. From such a place a small anchored array of the rule reads the match itself and gives its longest end. So
spans are leftmost, longest and non-overlapping for each rule, and no byte outside matches is read twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    from re import _parser as regex_parser
except ImportError:  # its place in older Pythons
    import sre_parse as regex_parser

#: (kind, regex, least length of a match), in the order in which kinds are listed. The first three are the
#: base rules. Shorter matches are dropped after they are found, so they still take their place.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0),
    ("access", r"AKIA[A-Z0-9]+", 16),
    ("hex", r"[0-9a-f]{32,}", 32),
    ("hosting", r"gh[pousr]_[A-Za-z0-9]+", 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
)
BASE = 3
#: Characters that the value of an assignment must have.
ASSIGNED = 8
_VALUE = re.compile(rb"""[^:=]*[:=]\x20*["']?""")


class _Nfa:
    """Byte transitions and empty moves, built from a parsed regex."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[int, int]]] = []  # (bit mask of bytes, target)
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree, at: int, back: bool) -> int:
        """States for ``tree`` from ``at`` on; ``back``: for reading from right to left. Returns the last state."""
        for op, arg in reversed(list(tree)) if back else tree:
            at = self._one(str(op), arg, at, back)
        return at

    def _one(self, op: str, arg, at: int, back: bool) -> int:
        if op in ("LITERAL", "IN", "NOT_LITERAL"):
            end = self.state()
            self.moves[at].append((_mask(op, arg), end))
            return end
        if op == "SUBPATTERN":
            return self.add(arg[-1], at, back)
        if op == "BRANCH":
            end = self.state()
            for tree in arg[1]:
                begin = self.state()
                self.empty[at].append(begin)
                self.empty[self.add(tree, begin, back)].append(end)
            return end
        if op == "MAX_REPEAT":
            least, most, tree = arg
            for _ in range(least):
                at = self.add(tree, at, back)
            if str(most) == "MAXREPEAT":
                loop, end = self.state(), self.state()
                self.empty[at] += [loop, end]
                self.empty[self.add(tree, loop, back)] += [loop, end]
                return end
            end = self.state()
            for _ in range(most - least):
                self.empty[at].append(end)
                at = self.add(tree, at, back)
            self.empty[at].append(end)
            return end
        raise ValueError(f"rules can't use {op}")

    def closure(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return frozenset(states)


def _mask(op: str, arg) -> int:
    if op == "LITERAL":
        return 1 << arg
    if op == "NOT_LITERAL":
        return (1 << 256) - 1 ^ 1 << arg
    mask, negate = 0, False
    for kind, x in arg:
        if str(kind) == "NEGATE":
            negate = True
        elif str(kind) == "RANGE":
            mask |= (1 << x[1] + 1) - (1 << x[0])
        else:
            mask |= _mask(str(kind), x)
    return (1 << 256) - 1 ^ mask if negate else mask


class Automaton:
    """A minimal deterministic automaton in arrays.

    ``classes``: a byte's class, for ``bytes.translate``. ``step[state + class]``: the next state; states are
    multiples of the number of classes. States from ``accepting`` on have rules, whose bits are in ``rules``.
    ``start``: the first state. With ``anywhere``, matches begin at any byte.
    """

    def __init__(self, patterns: tuple[str, ...], back: bool = False, anywhere: bool = True) -> None:
        nfa = _Nfa()
        begin = nfa.state()
        finals = {}
        for i, pattern in enumerate(patterns):
            first = nfa.state()
            nfa.empty[begin].append(first)
            finals[nfa.add(regex_parser.parse(pattern), first, back)] = 1 << i
        masks = sorted({mask for moves in nfa.moves for mask, _ in moves})
        kinds: dict[tuple[bool, ...], int] = {}
        of = [kinds.setdefault(tuple(bool(m >> b & 1) for m in masks), len(kinds)) for b in range(256)]
        sample = [of.index(c) for c in range(len(kinds))]
        home = nfa.closure({begin})
        number, rows, todo = {home: 0}, [], [home]
        for states in todo:
            row = []
            for b in sample:
                into = {t for s in states for mask, t in nfa.moves[s] if mask >> b & 1}
                to = nfa.closure(into | {begin} if anywhere else into)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        step = np.array(rows)
        marks = np.array([sum(finals.get(s, 0) for s in states) for states in todo])
        group = np.unique(marks, return_inverse=True)[1]
        while True:  # split groups of states by where they lead, until none splits
            finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        first = np.unique(group, return_index=True)[1]
        order = np.argsort(marks[first] > 0, kind="stable")
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        width = len(kinds)
        self.classes = bytes(of)
        self.step = (rank[group[step[first[order]]]] * width).ravel().tolist()
        self.start = int(rank[group[0]]) * width
        self.accepting = int((marks[first] == 0).sum()) * width
        self.rules = np.repeat(marks[first[order]], width).tolist()
        self.states = len(order)
        #: States that no byte leads out of.
        self.dead = {s for s in range(0, self.states * width, width) if all(x == s for x in self.step[s : s + width])}

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(place, bits of the rules of which a match begins there), last place first: the one pass over the bytes."""
        step, accepting, s, out = self.step, self.accepting, self.start, []
        for i, c in enumerate(data.translate(self.classes)[::-1]):
            s = step[s + c]
            if s >= accepting:
                out.append((len(data) - 1 - i, self.rules[s]))
        return out

    def longest(self, data: bytes, begin: int) -> int:
        """The end of the longest match that begins at ``begin``."""
        step, classes, s, end = self.step, self.classes, self.start, begin
        for i in range(begin, len(data)):
            s = step[s + classes[data[i]]]
            if s >= self.accepting:
                end = i + 1
            elif s in self.dead:
                break
        return end


@lru_cache(maxsize=4)
def compiled(rules: tuple[tuple[str, str, int], ...] = RULES) -> tuple[Automaton, list[Automaton]]:
    """The combined automaton, and each rule's anchored one: small arrays, built on the driver and sent with the task."""
    return Automaton(tuple(rule[1] for rule in rules), back=True), [Automaton((rule[1],), anywhere=False) for rule in rules]


def _code_points(data: bytes) -> Callable[[int], int]:
    """From byte places to code points, by one count over the bytes."""
    before = np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
    return lambda i: int(before[i])


def find_secrets(text: str, automata: tuple[Automaton, list[Automaton]], rules: tuple[tuple[str, str, int], ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule number, end) in code points, ends exclusive, sorted."""
    combined, each = automata
    data = text.encode()
    starts, out = combined.starts(data), []
    if not starts:
        return out
    past = [0] * len(rules)
    for begin, bits in reversed(starts):
        for i, (kind, _, least) in enumerate(rules):
            if bits >> i & 1 and begin >= past[i]:
                past[i] = end = each[i].longest(data, begin)
                if end - begin >= least and (kind != "assign" or end - _VALUE.match(data, begin).end() >= ASSIGNED):
                    out.append((begin, i, end))
    if len(data) != len(text):
        point = _code_points(data)
        out = [(point(a), i, point(b)) for a, i, b in out]
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch], automata: tuple[Automaton, list[Automaton]]) -> Iterator[pa.RecordBatch]:
    joined = lambda found: ",".join(f"{RULES[i][0]}:{a}:{b}" for a, i, b in found)
    for batch in batches:
        counts, digests, spans = ([], [], []), [], []
        for text in batch.column(1):
            found = find_secrets(text.as_py() or "", automata)
            base = [x for x in found if x[1] < BASE]
            for i in range(BASE):
                counts[i].append(sum(x[1] == i for x in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets in every whole text: a row for each row of ``docs``.

    Columns: doc_id, n_assign, n_access, n_hex (spans of the base rules), base_sha256 (SHA-256 of the base
    spans as ``kind:start:end``, comma-joined), spans (those of all rules). Offsets are code points.

    Null texts count as empty; no span gives an empty list, whose digest is that of the empty string. A null
    doc_id is passed on. Repeated rows give repeated results, an empty table an empty one; other columns are
    ignored, whatever their names. Memory is a text's size; there is no limit on it.
    """
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return kept.mapInArrow(partial(_scan, automata=compiled()), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
