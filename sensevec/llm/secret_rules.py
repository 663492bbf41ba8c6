"""Secret rules, and the Boolean trigram query that every text matching a rule must satisfy."""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as node
from re import _parser as parser

LARGEST_SET = 64  # of strings or alternatives that are followed exactly
LARGEST_CLASS = 8

#: A query is an OR of ANDs of trigrams.  One empty AND holds for every text.
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """``group`` has to have ``least`` characters, or the match is dropped after it was found."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    base: bool = False


# The base rules in the order in which their kinds are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=8,
        group=2,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    Rule("hex", r"[0-9a-f]+", least=32, base=True),
)
# Forms of well-known tokens and key files.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    # to the END line, or where it is missing to the end of what looks like the key's lines
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
        r"(?:[A-Za-z0-9+/=:,\s-]*?-----END [A-Z ]{0,30}PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/=]{16,})*(?:\s+[A-Za-z0-9+/]+={1,2})?)",
    ),
)
RULES = BASE_RULES + MORE_RULES


def absorbed(query) -> Query:
    """Without the ANDs that ask for more than another one."""
    sets = set(query)
    return frozenset(s for s in sets if not any(other < s for other in sets))


def both(left: Query, right: Query) -> Query:
    if len(left) * len(right) > LARGEST_SET:  # a weaker query only brings more candidates
        return min(left, right, key=len)
    return absorbed(a | b for a in left for b in right)


def of_strings(strings: set[str]) -> Query:
    """Texts that contain one of the strings."""
    return absorbed(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _sequence(items) -> tuple[set[str] | None, Query]:
    """The strings that the items match, if they are few, else none; and the query of what they match."""
    now, query, exact = {""}, ALWAYS, True
    for item in items:
        strings, needs = _item(item)
        if strings is not None and len(now) * len(strings) <= LARGEST_SET:
            now = {a + b for a in now for b in strings}
            continue
        exact = False
        query = both(query, of_strings(now))
        now = {""} if strings is None else strings
        query = both(query, needs)
    return (now, of_strings(now)) if exact else (None, both(query, of_strings(now)))


def _item(item) -> tuple[set[str] | None, Query]:
    kind, value = item
    if kind is node.LITERAL:
        return {chr(value).lower()}, ALWAYS
    if kind is node.IN and len(value) <= LARGEST_CLASS and all(k is node.LITERAL for k, _ in value):
        return {chr(v).lower() for _, v in value}, ALWAYS
    if kind is node.SUBPATTERN:
        return _sequence(value[-1])
    if kind is node.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(strings is not None for strings, _ in parts):
            joined = set().union(*(strings for strings, _ in parts))
            if len(joined) <= LARGEST_SET:
                return joined, of_strings(joined)
        return None, absorbed(a for _, query in parts for a in query)
    if kind in (node.MAX_REPEAT, node.MIN_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, ALWAYS
        return None, query if low else ALWAYS
    return None, ALWAYS


def trigram_query(pattern: str) -> Query:
    """Trigrams of the lower-cased text without which the pattern cannot match."""
    return _sequence(parser.parse(pattern))[1]
