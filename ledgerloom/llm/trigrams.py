"""Boolean trigram queries of regular expressions.

A query is ``None`` (nothing is mandatory), a trigram, or ``("and" | "or", parts)``.  It holds for the
lower-cased form of every text that the expression matches; texts for which it does not hold need no scan.
"""

from __future__ import annotations

import re
from itertools import product

#: More alternatives than this are not followed letter by letter.
STRINGS = 48

Query = None | str | tuple


def both(kind: str, parts: list[Query]) -> Query:
    """The parts joined; in an "or" one empty part makes all of it empty."""
    if kind == "or" and (None in parts or not parts):
        return None
    flat: list[Query] = []
    for p in parts:
        for q in p[1] if isinstance(p, tuple) and p[0] == kind else [p]:
            if q is not None and q not in flat:
                flat.append(q)
    if kind == "or":  # an alternative that demands more than another adds nothing
        demands = [trigrams_of(q) if not isinstance(q, tuple) or q[0] == "and" else None for q in flat]
        flat = [q for q, d in zip(flat, demands) if not any(e is not None and d is not None and e < d for e in demands)]
    return None if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def of_strings(strings: set[str]) -> Query:
    """One of the strings occurs."""
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(node: tuple) -> set[str] | None:
    """All lower-case strings a node can match, if they are few."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        found: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                found.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op == "SUBPATTERN":
        return _sequence_strings(arg[-1])
    if op == "BRANCH":
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 3:
        one = _sequence_strings(arg[2])
        if one is None:
            return None
        found = set()
        for n in range(arg[0], arg[1] + 1):
            found |= {"".join(x) for x in product(one, repeat=n)}
        return found if len(found) <= STRINGS else None
    return None


def _sequence_strings(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        own = _strings(node)
        if own is None or len(found) * len(own) > STRINGS:
            return None
        found = {a + b for a in found for b in own}
    return found


def _of_node(node: tuple) -> Query:
    """What a node that has too many strings demands."""
    op, arg = str(node[0]), node[1]
    if op == "SUBPATTERN":
        return _of_sequence(arg[-1])
    if op == "BRANCH":
        return both("or", [_of_sequence(x) for x in arg[1]])
    if op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
        return _of_sequence(arg[2])
    return None


def _of_sequence(nodes) -> Query:
    """Neighbours with few strings are read as one run, which ends where they become too many."""
    parts, run = [], {""}
    for node in nodes:
        own = _strings(node)
        if own is not None and len(run) * len(own) <= STRINGS:
            run = {a + b for a in run for b in own}
            continue
        parts.append(of_strings(run))
        run = own or {""}
        if own is None:
            parts.append(_of_node(node))
    return both("and", [*parts, of_strings(run)])


def trigram_query(pattern: str) -> Query:
    return _of_sequence(re._parser.parse(pattern))


def trigrams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def holds(query: Query, have: set[str]) -> bool:
    if query is None or isinstance(query, str):
        return query is None or query in have
    return (all if query[0] == "and" else any)(holds(q, have) for q in query[1])
