"""Plain algorithms on one small graph, for comparison; edges are (src, dst) or (src, label, dst), labels sorted tuples of atoms, empty for silent."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Hashable, Iterable

from sparktrail.functions.graphs import Node, components, follow, reach

__all__ = ["Node", "components", "divergent", "follow", "paths", "reach", "refine", "silent"]


def paths(starts: Iterable[Node], ends: set[Node], edges: list[tuple[Node, Node]], simple: bool, longest: int, most: int) -> list[list[Node]]:
    """Paths from a start to an end, shorter ones first, then in order of nodes; at most `most`, each of at most `longest` nodes."""
    to, found, todo = follow(edges), [], deque([s] for s in sorted(starts))
    while todo and len(found) < most:
        path = todo.popleft()
        if path[-1] in ends:
            found.append(path)
        if len(path) < longest:
            todo.extend([*path, n] for n in to.get(path[-1], ()) if not (simple and n in path))
    return found


def silent(transitions) -> list[tuple[Node, Node]]:
    return [(a, b) for a, label, b in transitions if not label]


def divergent(states: Iterable[Node], transitions) -> set[Node]:
    """States from which silent steps alone can go on for ever."""
    tau = silent(transitions)
    group = components(states, tau)
    size: dict[Node, int] = defaultdict(int)
    for n in group.values():
        size[n] += 1
    loops = {a for a, b in tau if a == b}
    return reach({n for n, g in group.items() if size[g] > 1 or n in loops}, tau, back=True)


def refine(states: list[Node], transitions, colour: Callable[[Node], Hashable] = lambda _: 0) -> dict[Node, int]:
    """Divergence-blind and divergence-keeping stuttering blocks: states split by what they can do after inert silent steps."""
    bad = divergent(states, transitions)

    def numbered(keys: dict[Node, Hashable]) -> dict[Node, int]:
        order = {k: i for i, k in enumerate(sorted(set(keys.values()), key=repr))}
        return {n: order[k] for n, k in keys.items()}

    block = numbered({n: (colour(n), n in bad) for n in states})
    out: dict[Node, list] = defaultdict(list)
    for a, label, b in transitions:
        out[a].append((label, b))
    while True:
        inert = [(a, b) for a, b in silent(transitions) if block[a] == block[b]]
        to = follow(inert)
        sign: dict[Node, Hashable] = {}
        for n in states:
            seen, todo = {n}, [n]
            while todo:
                for m in to.get(todo.pop(), ()):
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            sign[n] = (block[n], tuple(sorted({(label, block[b]) for s in seen for label, b in out[s] if label or block[b] != block[n]})))
        new = numbered(sign)
        if len(set(new.values())) == len(set(block.values())):
            return new
        block = new
