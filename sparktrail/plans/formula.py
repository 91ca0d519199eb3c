"""Finite-trace temporal formulas: parse, simplify, evaluate, progress and tabulate as an automaton.

A formula is a tuple: ("atom", text), ("true",), ("false",), ("not", p), ("and" | "or" | "imp" | "iff" | "U" |
"W", p, q), ("X" | "F" | "G", p). A trace is a list of sets of atoms. `X` is strong: false on the last
step. The empty trace satisfies nothing. Until and weak until bind tighter than `and`, and don't chain.
"""

from __future__ import annotations

import re

Formula = tuple
TRUE, FALSE = ("true",), ("false",)
TOKEN = re.compile(
    r"""\s*(?:(?P<op><->|->|&&|\|\||[!&|()])|(?P<call>(?:start|done|node)\([^()]*\))|(?P<quoted>"[^"]*")"""
    r"""|(?P<compare>[A-Za-z_]\w*\s*(?:<=|>=|==|!=|<(?!->)|>)\s*[\w.]+)|(?P<name>[A-Za-z_]\w*))"""
)
TEMPORAL, WORDS = {"G", "F", "X", "U", "W"}, {"true": TRUE, "false": FALSE}


class FormulaError(ValueError):
    """The text is not a formula."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected {text[at:at + 10]!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "op":
            value = {"&&": "&", "||": "|"}.get(value, value)
        elif kind == "name" and value in TEMPORAL:
            kind = "op"
        elif kind == "name" and value in ("f", "g"):
            raise FormulaError("temporal operators are upper case")
        elif kind == "quoted":
            value = value[1:-1]
        out.append((kind, value))
        at = m.end()
    return out


def parse(text: str) -> Formula:
    left = tokens(text)[::-1]

    def peek() -> str | None:
        return left[-1][1] if left and left[-1][0] == "op" else None

    def unary() -> Formula:
        if not left:
            raise FormulaError("the formula ends too soon")
        kind, value = left.pop()
        if kind != "op":
            return WORDS.get(value, ("atom", value)) if kind == "name" else ("atom", value)
        if value == "!":
            return ("not", unary())
        if value in ("X", "F", "G"):
            return (value, unary())
        if value == "(":
            inside = arrows()
            if peek() != ")":
                raise FormulaError("a parenthesis stays open")
            left.pop()
            return inside
        raise FormulaError(f"unexpected {value!r}")

    def until() -> Formula:
        p = unary()
        return (left.pop()[1], p, unary()) if peek() in ("U", "W") else p

    def level(sign: str, name: str, below) -> Formula:
        p = below()
        while peek() == sign:
            left.pop()
            p = (name, p, below())
        return p

    def arrows() -> Formula:
        p = level("|", "or", lambda: level("&", "and", until))
        return ("imp" if left.pop()[1] == "->" else "iff", p, arrows()) if peek() in ("->", "<->") else p

    out = arrows()
    if left:
        raise FormulaError(f"unexpected {left[-1][1]!r}")
    return out


def atoms(f: Formula) -> list[str]:
    """Distinct atoms in order."""
    if f[0] == "atom":
        return [f[1]]
    return list(dict.fromkeys(a for part in f[1:] for a in atoms(part)))


def text(f: Formula) -> str:
    if f[0] == "atom":
        return f[1] if re.fullmatch(r"\w+|(?:start|done|node)\([^()]*\)|\w+ (?:<=|>=|==|!=|<|>) [\w.]+", f[1]) else f'"{f[1]}"'
    if f[0] in ("true", "false"):
        return f[0]
    if f[0] in ("not", "X", "F", "G"):
        return f"{'!' if f[0] == 'not' else f[0] + ' '}({text(f[1])})"
    sign = {"and": "&", "or": "|", "imp": "->", "iff": "<->"}.get(f[0], f[0])
    return f"({text(f[1])}) {sign} ({text(f[2])})"


def core(f: Formula) -> Formula:
    """Without -> and <->."""
    parts = [core(p) if isinstance(p, tuple) else p for p in f[1:]]
    if f[0] == "imp":
        return ("or", ("not", parts[0]), parts[1])
    if f[0] == "iff":
        return ("or", ("and", *parts), ("and", ("not", parts[0]), ("not", parts[1])))
    return (f[0], *parts)


def simplify(f: Formula) -> Formula:
    """Constants, double negation, equal sides, and the units of the temporal operators; sides of and/or in a fixed order."""
    if f[0] in ("atom", "true", "false", "free"):
        return f
    op, *p = f[0], *(simplify(x) for x in f[1:])
    if op == "not":
        return FALSE if p[0] == TRUE else TRUE if p[0] == FALSE else p[0][1] if p[0][0] == "not" else ("not", p[0])
    if op in ("and", "or"):
        unit, zero = (TRUE, FALSE) if op == "and" else (FALSE, TRUE)
        sides: set[Formula] = set()
        for x in p:
            sides |= set(flat(x, op))
        sides.discard(unit)
        if zero in sides or any(("not", x) in sides for x in sides):
            return zero
        ordered = sorted(sides, key=repr)
        out = ordered.pop() if ordered else unit
        while ordered:
            out = (op, ordered.pop(), out)
        return out
    if op in ("F", "G"):
        return p[0] if p[0] in (TRUE, FALSE) or p[0][0] == op else (op, p[0])
    if op == "U":
        return p[1] if p[1] in (TRUE, FALSE) or p[0] == FALSE or p[0] == p[1] else ("F", p[1]) if p[0] == TRUE else (op, *p)
    if op == "W":
        return TRUE if TRUE in p else p[1] if p[0] == FALSE or p[0] == p[1] else ("G", p[0]) if p[1] == FALSE else (op, *p)
    return (op, *p)


def flat(f: Formula, op: str) -> list[Formula]:
    return [x for part in f[1:] for x in flat(part, op)] if f[0] == op else [f]


def holds(f: Formula, trace: list[set[str]], at: int = 0) -> bool:
    """The definition, step by step; for small traces and tests."""
    if not trace:
        return False
    op, rest = f[0], range(at, len(trace))
    if op == "atom":
        return f[1] in trace[at]
    if op in ("true", "false"):
        return op == "true"
    if op == "not":
        return not holds(f[1], trace, at)
    if op == "and":
        return holds(f[1], trace, at) and holds(f[2], trace, at)
    if op == "or":
        return holds(f[1], trace, at) or holds(f[2], trace, at)
    if op == "imp":
        return not holds(f[1], trace, at) or holds(f[2], trace, at)
    if op == "iff":
        return holds(f[1], trace, at) == holds(f[2], trace, at)
    if op == "X":
        return at + 1 < len(trace) and holds(f[1], trace, at + 1)
    if op == "F":
        return any(holds(f[1], trace, k) for k in rest)
    if op == "G":
        return all(holds(f[1], trace, k) for k in rest)
    for k in rest:
        if holds(f[2], trace, k):
            return True
        if not holds(f[1], trace, k):
            return False
    return op == "W"


#: What is left of a strong next: it holds only if a step follows.
def progress(f: Formula, now: frozenset[str] | set[str]) -> Formula:
    """What must hold from the next step on, if these atoms hold now. A pending ("next", p) says that a step must follow."""
    op = f[0]
    if op == "atom":
        return TRUE if f[1] in now else FALSE
    if op in ("true", "false"):
        return f
    if op == "not":
        return ("not", progress(f[1], now))
    if op in ("and", "or"):
        return (op, progress(f[1], now), progress(f[2], now))
    if op == "X":
        return ("next", f[1])
    if op == "next":
        return progress(f[1], now)
    if op == "F":
        return ("or", progress(f[1], now), f)
    if op == "G":
        return ("and", progress(f[1], now), f)
    return ("or", progress(f[2], now), ("and", progress(f[1], now), f))


def accepts(f: Formula) -> bool:
    """Whether what is left holds when no step follows."""
    op = f[0]
    if op == "not":
        return not accepts(f[1])
    if op == "and":
        return accepts(f[1]) and accepts(f[2])
    if op == "or":
        return accepts(f[1]) or accepts(f[2])
    return op in ("true", "G", "W")


def obligations(f: Formula) -> tuple[set[str], set[str], set[str]]:
    """Atoms that must hold now, must not, and may either way, for the formula to be still possible."""
    must, never = set(), set()
    names = atoms(f)
    f = core(f)
    for a in names:
        if impossible(f, {a: False}):
            must.add(a)
        elif impossible(f, {a: True}):
            never.add(a)
    return must, never, set(names) - must - never


def impossible(f: Formula, known: dict[str, bool]) -> bool:
    def part(g: Formula) -> Formula:
        op = g[0]
        if op == "atom":
            return (TRUE if known[g[1]] else FALSE) if g[1] in known else ("free", g[1])
        if op in ("true", "false"):
            return g
        if op in ("X", "next"):
            return ("free", repr(g))
        if op == "not":
            return ("not", part(g[1]))
        if op in ("and", "or"):
            return (op, part(g[1]), part(g[2]))
        later = ("free", repr(g))
        if op == "F":
            return ("or", part(g[1]), later)
        if op == "G":
            return ("and", part(g[1]), later)
        return ("or", part(g[2]), ("and", part(g[1]), later))

    return simplify(part(core(f))) == FALSE


def automaton(f: Formula, labels: list[str | None], most: int = 5000) -> tuple[list[tuple[int, str | None, int]], list[bool]]:
    """Transitions (state, label, state) and which states accept. A step holds one label's atom or, for None, none. State 0 is first."""
    start = simplify(core(f))
    states, out, todo = {start: 0}, [], [start]
    for state in todo:
        for label in labels:
            new = simplify(progress(state, frozenset() if label is None else frozenset([label])))
            if new not in states:
                if len(states) >= most:
                    raise FormulaError("the automaton is too large")
                states[new] = len(states)
                todo.append(new)
            out.append((states[state], label, states[new]))
    return out, [accepts(s) for s in states]


def template(f: Formula) -> tuple | None:
    """("exists", b), ("response", a, bs), ("precedence", as, b, strong), ("absence_after", a, b) for formulas with a closed form."""
    op = f[0]
    if op == "F" and f[1][0] == "atom":
        return ("exists", f[1][1])
    if op == "G" and f[1][0] == "imp" and f[1][1][0] == "atom":
        a, then = f[1][1][1], f[1][2]
        goals = flat(then, "or")
        if all(g[0] == "F" and g[1][0] == "atom" for g in goals):
            return ("response", a, [g[1][1] for g in goals])
        if then[0] == "not" and then[1][0] == "F" and then[1][1][0] == "atom":
            return ("absence_after", a, then[1][1][1])
    if op in ("U", "W") and f[1][0] == "not" and f[1][1][0] == "atom" and all(x[0] == "atom" for x in flat(f[2], "or")):
        return ("precedence", [x[1] for x in flat(f[2], "or")], f[1][1][1], op == "U")
    return None


def synthesize(f: Formula, depth: int, most: int = 200) -> list[list[frozenset[str]]]:
    """Traces of `depth` steps that satisfy the formula, at most one atom beyond the forced ones a step; in a fixed order."""
    found: list[list[frozenset[str]]] = []
    names = sorted(atoms(f))
    dead: set[tuple[Formula, int]] = set()

    def walk(state: Formula, trace: list[frozenset[str]]) -> bool:
        if len(trace) == depth:
            if accepts(state):
                found.append(list(trace))
                return True
            return False
        if state == FALSE or (state, len(trace)) in dead:
            return False
        any_ = False
        for choice in (frozenset(), *(frozenset([a]) for a in names)):
            if len(found) >= most:
                return True
            any_ |= walk(simplify(progress(state, choice)), [*trace, choice])
        if not any_:
            dead.add((state, len(trace)))
        return any_

    walk(simplify(core(f)), [])
    return found[:most]
