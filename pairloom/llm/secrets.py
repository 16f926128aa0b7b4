"""Secret scans with one deterministic automaton for all rules.

The rules are regular expressions over bytes. Their position automata are merged by subset
construction and minimised into one transition array. Two such automata are built: one that
searches (a match may start at any byte) and one that is anchored. The search automaton
passes once over the bytes of all texts for all rules; its lanes are stretches that begin
after a byte which resets it, so numpy advances thousands of lanes by one byte at a time.
Only stretches in which a rule matched are walked with the anchored automaton, which gives
the leftmost longest spans, for each rule without overlaps.

Scale: one map without a shuffle; the automata are built once on the driver from the rules
and have a fixed size. Memory is bounded by the Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from re import _constants as sre
from re import _parser as sre_parser

from pairloom.llm.common import batch


@dataclass(frozen=True)
class Rule:
    """A regex over ASCII bytes made of literals, classes, groups, `|`, `?`, `*`, `+`, {m,n}.

    A match counts if group `group` (0: the match) has at least `least` characters; matches
    that fail still use up their characters. `any_case` folds ASCII letters.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def exact(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The base rules.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=8, any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    # no match begins inside a run that is too short, so the length can be part of the pattern
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", least=24),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=32),
)
RULES = BASE_RULES + MORE_RULES


class _Positions:
    """Thompson automaton: `steps` are (from, byte set, to), `empty` are free moves."""

    def __init__(self):
        self.size = 0
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.empty.append([])
        self.size += 1
        return self.size - 1

    def add(self, tree, any_case: bool, start: int) -> int:
        for op, value in tree:
            start = self._item(op, value, any_case, start)
        return start

    def _item(self, op, value, any_case: bool, start: int) -> int:
        if op in (sre.LITERAL, sre.IN):
            found = {value} if op is sre.LITERAL else _byte_set(value)
            if any_case:
                found |= {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()}
            if max(found) > 127:
                raise ValueError("rules are written over ASCII")
            end = self.state()
            self.steps[start].append((frozenset(found), end))
            return end
        if op is sre.SUBPATTERN:
            return self.add(value[-1], any_case, start)
        if op is sre.BRANCH:
            end = self.state()
            for branch in value[1]:
                inner = self.state()
                self.empty[start].append(inner)
                self.empty[self.add(branch, any_case, inner)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            low, high, tree = value
            for _ in range(low):
                start = self.add(tree, any_case, start)
            if high is sre.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.empty[start].append(loop)
                self.empty[self.add(tree, any_case, loop)].append(loop)
                self.empty[loop].append(end)
                return end
            end = self.state()
            self.empty[start].append(end)
            for _ in range(high - low):
                start = self.add(tree, any_case, start)
                self.empty[start].append(end)
            return end
        raise ValueError(f"rules do not support {op}")


def _byte_set(items) -> set[int]:
    found: set[int] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(value)
        elif op is sre.RANGE:
            found.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"classes do not support {op}")
    return found


@dataclass
class Automaton:
    """`moves[state * classes + class_of[byte]]` is the next state; state 0 is the start.

    `accepts[state]` has bit r set if rule r has just matched, `reaches[state]` if it can
    still match; `resets[byte]` says that the byte leads to the start from everywhere.
    """

    class_of: np.ndarray
    classes: int
    moves: np.ndarray
    accepts: np.ndarray
    reaches: np.ndarray
    resets: np.ndarray

    @cached_property
    def _moves(self) -> list[int]:
        return self.moves.tolist()

    def table(self) -> tuple[list[int], int]:
        """`moves` for steps taken one by one, and `classes`."""
        return self._moves, self.classes


def compile_rules(rules: Sequence[Rule], search: bool) -> Automaton:
    """Subset construction over all rules at once, then minimisation."""
    nfa = _Positions()
    begin, ends = nfa.state(), {}
    for number, rule in enumerate(rules):
        start = nfa.state()
        nfa.empty[begin].append(start)
        ends[nfa.add(sre_parser.parse(rule.pattern), rule.any_case, start)] = number

    def closure(states) -> frozenset[int]:
        found, stack = set(states), list(states)
        while stack:
            for s in nfa.empty[stack.pop()]:
                if s not in found:
                    found.add(s)
                    stack.append(s)
        return frozenset(s for s in found if nfa.steps[s] or s in ends)

    sets = {found for steps in nfa.steps for found, _ in steps}
    signature = {b: tuple(b in found for found in sets) for b in range(256)}
    numbers = {s: i for i, s in enumerate(dict.fromkeys(signature.values()))}
    class_of = np.array([numbers[signature[b]] for b in range(256)], dtype=np.uint8)
    sample = [int(np.flatnonzero(class_of == c)[0]) for c in range(len(numbers))]

    initial = closure([begin])
    known, order, moves = {initial: 0}, [initial], []
    for states in order:
        row = []
        for byte in sample:
            after = [to for s in states for found, to in nfa.steps[s] if byte in found]
            following = closure(after) | (initial if search else frozenset())
            if following not in known:
                known[following] = len(order)
                order.append(following)
            row.append(known[following])
        moves.append(row)
    accepts = [sum(1 << ends[s] for s in states if s in ends) for states in order]
    table, marks = _minimise(np.array(moves), np.array(accepts))
    reaches = marks.copy()
    while True:
        wider = reaches | np.bitwise_or.reduce(reaches[table], axis=1)
        if (wider == reaches).all():
            break
        reaches = wider
    resets = (table == 0).all(axis=0)[class_of]
    moves = (table * len(sample)).astype(np.int32).ravel()
    return Automaton(class_of, len(sample), moves, marks, reaches, resets)


def _minimise(moves: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore's refinement: states stay together while their moves lead to the same groups."""
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        key = np.column_stack([group, group[moves]])
        _, first, finer = np.unique(key, axis=0, return_index=True, return_inverse=True)
        if finer.max() == group.max():
            break
        group = finer.ravel()
    order = np.argsort(np.argsort(first))  # number groups by first state: the start is 0
    group = order[finer.ravel()]
    first = np.sort(first)
    return group[moves[first]], accepts[first]


@lru_cache(maxsize=8)
def _compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, Automaton]:
    return compile_rules(rules, True), compile_rules(rules, False)


def _lanes(data: np.ndarray, automaton: Automaton, length: int) -> np.ndarray:
    """Bounds of stretches of about `length` bytes, each ending behind a resetting byte."""
    resets = np.flatnonzero(automaton.resets[data])
    if not len(resets):
        return np.array([0, len(data)])
    wanted = np.searchsorted(resets, np.arange(length, len(data), length))
    cuts = np.unique(resets[wanted[wanted < len(resets)]]) + 1
    return np.unique(np.concatenate([[0], cuts, [len(data)]]))


FEW_LANES = 64
"""So many lanes are quicker one by one: numpy's calls cost more than their bytes."""


def _matches(automaton: Automaton, classes: np.ndarray, state: int) -> bool:
    moves, n = automaton.table()
    hot = {int(s) * n for s in np.flatnonzero(automaton.accepts)}
    for c in classes.tolist():
        state = moves[state + c]
        if state in hot:
            return True
    return False


def find_stretches(data: np.ndarray, automaton: Automaton, length: int = 256) -> np.ndarray:
    """Bounds (n x 2) of the stretches of `data` in which a rule matched."""
    bounds = _lanes(data, automaton, length)
    starts, sizes = bounds[:-1], np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    classes = automaton.class_of[data]
    hot = np.repeat(automaton.accepts != 0, automaton.classes)
    state = np.zeros(len(starts), dtype=automaton.moves.dtype)
    seen = np.zeros(len(starts), dtype=bool)
    alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, int(sizes[0]) + 1) if len(sizes) else [])
    for at, n in enumerate(alive):
        if n <= FEW_LANES:
            for lane in range(n):
                seen[lane] |= _matches(automaton, classes[starts[lane] + at:starts[lane] + sizes[lane]], int(state[lane]))
            break
        now = state[:n]
        now += classes[starts[:n] + at]
        now[:] = automaton.moves[now]
        seen[:n] |= hot[now]
    found = np.flatnonzero(seen)
    return np.column_stack([starts[found], starts[found] + sizes[found]])


def spans_in(
    text: bytes, base: int, rules: Sequence[Rule], automaton: Automaton
) -> Iterator[tuple[int, int, int]]:
    """Leftmost longest matches (start, rule, end) in `text`, without overlaps per rule.

    A walk that comes to a place in the state in which an earlier one has been there, for the
    same rules, ends as that one did: so a run in which nothing matches is walked once for
    each state, not once for each place where a match could begin.
    """
    moves, n = automaton.table()
    accepts, reaches = automaton.accepts.tolist(), automaton.reaches.tolist()
    free = [0] * len(rules)
    closed = automaton.class_of[np.frombuffer(text, dtype=np.uint8)]
    opening = np.flatnonzero(automaton.reaches[automaton.moves[closed] // n])
    closed = closed.tolist()
    # per state the last walk that was in it, with the first and last place of that run
    been: dict[int, list] = {}
    for start in opening.tolist():
        open_rules = sum(1 << r for r, at in enumerate(free) if at <= start)
        state, ends = 0, {}
        walk = (open_rules, ends)
        for at in range(start, len(closed)):
            state = moves[state + closed[at]]
            if not reaches[state // n] & open_rules:
                break
            mask, rule = accepts[state // n] & open_rules, 0
            while mask:
                if mask & 1:
                    ends[rule] = at + 1
                mask >>= 1
                rule += 1
            run = been.get(state)
            if run is None:
                been[state] = [walk, at, at]
            elif run[0] is walk and run[2] == at - 1:
                run[2] = at
            elif run[0][0] == open_rules and run[1] <= at <= run[2]:
                ends.update((rule, end) for rule, end in run[0][1].items() if end > at)
                break
            else:
                been[state] = [walk, at, at]
        for rule, end in ends.items():
            free[rule] = end
            yield base + start, rule, base + end


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """All secrets of all rows of `docs` (doc_id, text): doc_id and `secrets`, an array of
    (kind, start, end) by start and then by the order of the rules, in code points.

    A null or empty text has none. Repeated rows are scanned alike, other columns are
    ignored, and an empty table gives an empty result.
    """
    rules = tuple(rules)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("secrets", T.ArrayType(span))])
    arrow = to_arrow_schema(schema)
    checks = [rule.exact() for rule in rules]
    search, anchored = _compiled(rules)
    # a text must end in the start state: the separator resets every rule
    separator = bytes([int(np.flatnonzero(search.resets)[0])])

    def counts(text: bytes, rule: int, start: int, end: int) -> bool:
        if not rules[rule].group:
            return end - start >= rules[rule].least
        match = checks[rule].fullmatch(text[start:end].decode("ascii"))
        return match is not None and len(match[rules[rule].group]) >= rules[rule].least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t.as_py() or "").encode("utf-8", "replace") for t in b.column(1)]
            joined = separator.join(raw) + separator
            offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
            found: list[list] = [[] for _ in raw]
            data = np.frombuffer(joined, dtype=np.uint8)
            for low, high in find_stretches(data, search).tolist():
                # a stretch may span texts: the separator ends every match
                for start, rule, end in spans_in(joined[low:high], low, rules, anchored):
                    if counts(joined, rule, start, end):
                        doc = int(np.searchsorted(offsets, start, side="right")) - 1
                        found[doc].append((start - int(offsets[doc]), rule, end - int(offsets[doc])))
            out = []
            for text, spans in zip(raw, found):
                points = None
                if spans and not text.isascii():
                    points = np.concatenate([[0], np.cumsum(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80)])
                at = (lambda x: x) if points is None else (lambda x, p=points: int(p[x]))
                out.append([{"kind": rules[r].kind, "start": at(s), "end": at(e)} for s, r, e in sorted(spans)])
            yield batch({"doc_id": b.column(0), "secrets": out}, arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
