"""Algorithms on one small graph, for use a graph at a time; edges are (src, dst) or (src, label, dst)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Hashable, Iterable

Node = Hashable


def follow(edges: Iterable[tuple[Node, Node]], back: bool = False) -> dict[Node, list[Node]]:
    out: dict[Node, list[Node]] = defaultdict(list)
    for a, b in edges:
        out[b if back else a].append(a if back else b)
    return {k: sorted(set(v)) for k, v in out.items()}


def reach(roots: Iterable[Node], edges: Iterable[tuple[Node, Node]], back: bool = False) -> set[Node]:
    to, seen = follow(edges, back), set(roots)
    todo = list(seen)
    while todo:
        for n in to.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def components(nodes: Iterable[Node], edges: list[tuple[Node, Node]]) -> dict[Node, Node]:
    """Strongly connected components, named by their least node: two passes of depth-first search."""
    to, frm, order, seen = follow(edges), follow(edges, True), [], set()
    for start in sorted(nodes):
        stack = [(start, False)]
        while stack:
            n, done = stack.pop()
            if done:
                order.append(n)
            elif n not in seen:
                seen.add(n)
                stack.append((n, True))
                stack += [(m, False) for m in to.get(n, ()) if m not in seen]
    out: dict[Node, Node] = {}
    for start in reversed(order):
        if start not in out:
            group, todo = {start}, [start]
            while todo:
                for m in frm.get(todo.pop(), ()):
                    if m not in out and m not in group:
                        group.add(m)
                        todo.append(m)
            least = min(group)
            out |= dict.fromkeys(group, least)
    return out


def dominators(root: Node, edges: list[tuple[Node, Node]]) -> dict[Node, set[Node]]:
    """The dominators of each node that the root reaches, itself included."""
    inside = reach([root], edges)
    frm = {n: [m for m in ms if m in inside] for n, ms in follow(edges, True).items()}
    dom = {n: set(inside) for n in inside}
    dom[root] = {root}
    moved = True
    while moved:
        moved = False
        for n in sorted(inside - {root}):
            new = set.intersection(*(dom[m] for m in frm[n])) | {n}
            if new != dom[n]:
                dom[n], moved = new, True
    return dom


def immediate(dom: dict[Node, set[Node]]) -> dict[Node, Node]:
    """The strict dominator that all the other strict ones dominate."""
    return {n: max(d - {n}, key=lambda m: len(dom[m])) for n, d in dom.items() if len(d) > 1}


def frontier(root: Node, edges: list[tuple[Node, Node]], dom: dict[Node, set[Node]] | None = None) -> dict[Node, set[Node]]:
    dom = dom or dominators(root, edges)
    out: dict[Node, set[Node]] = {n: set() for n in dom}
    for a, b in edges:
        if a in dom:
            for n in dom[a]:
                if n == b or n not in dom[b]:
                    out[n].add(b)
    return out


def contract(nodes: dict[Node, bool], edges: list[tuple[Node, str | None, Node]]) -> tuple[set[Node], list]:
    """Takes out bookkeeping nodes (True) and joins their ways; a node whose two sides both carry different labels stays."""
    kept, now = set(nodes), set(edges)
    moved = True
    while moved:
        moved = False
        for n in sorted(k for k in kept if nodes[k]):
            into, away = [e for e in now if e[2] == n and e[0] != n], [e for e in now if e[0] == n and e[2] != n]
            if any(e[0] == n and e[2] == n for e in now) or not into or not away or any(i[1] and o[1] and i[1] != o[1] for i in into for o in away):
                continue
            now = {e for e in now if n not in (e[0], e[2])} | {(i[0], i[1] or o[1], o[2]) for i in into for o in away}
            kept.discard(n)
            moved = True
    return kept, sorted(now, key=repr)
