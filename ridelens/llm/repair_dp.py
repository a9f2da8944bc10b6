"""Cheapest edits that give a row of roles its grammar, by min-plus matrices over grammar-compressed rows.

The grammar of role initials is ``(s?(ua)+)?``. Its automaton has the states START,
after s, after u and after a, of which START and after a are final; an inserted or
reroled row can only take one role in each state. So a row of edits (D, I, K, R) decides
the states, and a matrix from state to state holds the cheapest edits of a stretch of
rows: its cost, and the edits themselves as a rope.

Of equal costs the edits least by ASCII count. Edits of one stretch and equal cost never
begin one another, as all letters more would be inserts, which cost. So the least of a
whole is made of the least of its parts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

START, FINAL, STATES = 0, (0, 3), 4
FORCED = (2, 2, 3, 2)  # state after a user or an assistant, whichever may come
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1  # costs; keeping costs nothing
FIRST_RULE = 0xE000  # rules are letters from here on, as many as there are between here and the end of Unicode

Rope = str | tuple  # a string, or (left, right)
Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]


def letters(rope: Rope):
    """The strings of a rope from left to right."""
    waiting = [rope]
    while waiting:
        top = waiting.pop()
        if isinstance(top, str):
            yield top
        else:
            waiting += (top[1], top[0])


def text(rope: Rope) -> str:
    return "".join(letters(rope))


def joined(left: Rope, right: Rope) -> Rope:
    """Short ropes are strings."""
    if isinstance(left, str) and isinstance(right, str) and len(left) + len(right) <= 64:
        return left + right
    return right if left == "" else left if right == "" else (left, right)


def less(a: Rope, b: Rope) -> bool:
    """Whether a comes before b by ASCII, compared string by string as far as needed; shared parts are skipped."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if not isinstance(x, str):
            left += (x[1], x[0])
            right.append(y)
        elif not isinstance(y, str):
            left.append(x)
            right += (y[1], y[0])
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            left += [x[n:]] * (len(x) > n)
            right += [y[n:]] * (len(y) > n)
    return bool(right) and not left


def better(a: Entry | None, b: Entry | None) -> Entry | None:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if less(b[1], a[1]) else a


def times(row: list[Entry | None], matrix: Matrix) -> list[Entry | None]:
    """A row of costs after one more stretch."""
    made: list[Entry | None] = [None] * STATES
    for first, then in zip(row, matrix, strict=True):
        if first is None:
            continue
        for j, entry in enumerate(then):
            if entry is None or (made[j] is not None and made[j][0] < first[0] + entry[0]):
                continue
            made[j] = better(made[j], (first[0] + entry[0], joined(first[1], entry[1])))
    return made


def product(a: Matrix, b: Matrix) -> Matrix:
    return [times(row, b) for row in a]


def inserts() -> Matrix:
    """Any number of inserted rows; more than the number of states never lead anywhere new."""
    made: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        state = i
        for n in range(STATES):
            made[i][state] = better(made[i][state], (n * INSERT, "I" * n))
            state = FORCED[state]
    return made


def row_matrix(symbol: str) -> Matrix:
    """One row, then inserts. Symbols: s, u, a and o (other) by initial, upper case if truncated; x must go."""
    made: Matrix = [[None] * STATES for _ in range(STATES)]
    extra = TRUNCATED if symbol.isupper() else 0
    for i in range(STATES):
        made[i][i] = (DELETE, "D")
        if symbol == "x":
            continue
        made[i][FORCED[i]] = better(made[i][FORCED[i]], (REROLE + extra, "R"))
        to = KEPT[symbol.lower()].get(i)
        if to is not None:
            made[i][to] = better(made[i][to], (extra, "K"))
    return product(made, inserts())


BEGIN: list[Entry | None] = inserts()[START]
ROWS = {symbol: row_matrix(symbol) for symbol in "suaoSUAOx"}


def compress(rows: list[str]) -> tuple[list[str], dict[str, str]]:
    """Re-Pair: the most frequent pair of neighbours becomes a new symbol, until no pair stands twice.

    The rules are shared by all rows of symbols; a rule's right side has two symbols made before it.
    """
    cut = "\n"
    whole, rules = cut.join(rows), {}
    barred: set[str] = set()
    while True:
        counts = Counter(map("".join, zip(whole, whole[1:], strict=False)))
        pair, n = "", 0
        for found, times_found in counts.items():
            if times_found > n and cut not in found and found not in barred:
                pair, n = found, times_found
        if n < 2:
            break
        if whole.count(pair) < 2:  # overlaps itself
            barred.add(pair)
            continue
        rule = chr(FIRST_RULE + len(rules))
        rules[rule] = pair
        whole = whole.replace(pair, rule)
    return whole.split(cut), rules


def matrices(rows: list[str]) -> list[Matrix]:
    """The matrix of every row of symbols: one product a rule, bottom-up, and one for each symbol left in a row."""
    short, rules = compress(rows)
    known = dict(ROWS)
    for rule, (left, right) in rules.items():
        known[rule] = product(known[left], known[right])
    made = []
    for row in short:
        first, *rest = row or "\0"
        matrix = known[first] if row else [[(0, "") if i == j else None for j in range(STATES)] for i in range(STATES)]
        for symbol in rest:
            matrix = product(matrix, known[symbol])
        made.append(matrix)
    return made


def best(stretches: Iterable[Matrix]) -> tuple[int, str]:
    """Cost and edits of a conversation, from the matrices of its stretches in order."""
    row = BEGIN
    for matrix in stretches:
        row = times(row, matrix)
    return ended(row)


def ended(row: list[Entry | None]) -> tuple[int, str]:
    found = None
    for state in FINAL:
        found = better(found, row[state])
    return found[0], text(found[1])
