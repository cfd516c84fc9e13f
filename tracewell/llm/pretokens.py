"""Pre-tokenisation without a regular expression.

The splitting pattern is

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Each code point becomes one of a few symbols: its class, with what little lies ahead folded in (is the
next one white space, do the letters of a contraction follow). A symbol is a function on the states of
a small automaton. Functions compose associatively, so the state before every code point comes out of
a blocked prefix scan over function numbers: a few table look-ups on whole arrays. A table then tells
from state and symbol whether a pre-token starts there.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

_LETTER, _NUMBER, _OTHER, _BLANK = 0, 1, 2, 3
# Symbols: letter, number, other, apostrophe of a contraction with one or two letters, white space with
# more white space or the end behind it, last white space before text: a plain space, another.
_L, _N, _O, _A1, _A2, _IN, _SP, _WS = range(8)
_SYMBOLS = 8
# States: nothing open, open run of letters, numbers, others, white space, an open space that joins the
# next run, one or two letters of a contraction still to come.
_START, _QL, _QN, _QO, _QW, _QP, _C1, _C2 = range(8)
_STATES = 8
_BLOCK = 128


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, from the properties that the pattern names."""
    out = np.full(0x110000, _OTHER, np.uint8)
    plane = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, at = "".join(map(chr, plane)), np.array(plane)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _BLANK)):
        for m in regex.finditer(pattern, text):
            out[at[m.start() : m.end()]] = kind
    for c in (0x1C, 0x1D, 0x1E, 0x1F):  # separators that are white space for Python only
        out[c] = _OTHER
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a pre-token starts at the symbol."""
    if symbol == _L:
        if state == _C1:
            return _START, False
        if state == _C2:
            return _C1, False
        return _QL, state not in (_QL, _QP)
    if symbol == _N:
        return _QN, state not in (_QN, _QP)
    if symbol in (_O, _A1, _A2):
        if state in (_QO, _QP):
            return _QO, False
        return {_O: _QO, _A1: _C1, _A2: _C2}[symbol], True
    if symbol == _IN:
        return _QW, state != _QW
    return (_QP if symbol == _SP else _START), True


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Function number of each symbol (twice: within a text, at its start), composition, application, starts; the count's bits."""
    functions = [tuple(_step(q, s)[0] for q in range(_STATES)) for s in range(_SYMBOLS)]
    functions += [(f[_START],) * _STATES for f in functions]
    known = {tuple(range(_STATES)): 0}
    queue = list(dict.fromkeys(functions))
    for f in queue:
        known.setdefault(f, len(known))
    while queue:  # closure under composition with a symbol
        f = queue.pop()
        for g in functions:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    bits = max(1, (len(known) - 1).bit_length())
    assert bits <= 8
    apply = np.zeros((1 << bits, _STATES), np.uint8)
    compose = np.zeros(1 << 2 * bits, np.uint8)
    for f, i in known.items():
        apply[i] = f
        for g, j in known.items():
            compose[i << bits | j] = known[tuple(g[x] for x in f)]
    starts = np.array([[_step(q, s)[1] for q in range(_STATES)] for s in range(_SYMBOLS)])
    return np.array([known[f] for f in functions], np.uint8), compose, apply.ravel(), starts.ravel(), bits


def _scan(ids: np.ndarray, compose: np.ndarray, apply: np.ndarray, bits: int) -> np.ndarray:
    """State after each function, from the start state."""
    n = len(ids)
    if n <= _BLOCK:
        out, acc = np.empty(n, np.uint8), 0
        for i, f in enumerate(ids.tolist()):
            acc = int(compose[acc << bits | f])
            out[i] = apply[acc * _STATES]
        return out
    blocks = -(-n // _BLOCK)
    grid = np.zeros(blocks * _BLOCK, np.uint8)  # 0: the identity
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T)
    for j in range(1, _BLOCK):
        index = grid[j - 1].astype(np.uint16)
        index <<= bits
        index |= grid[j]
        np.take(compose, index, out=grid[j])
    carry = np.zeros(blocks, np.uint8)
    carry[1:] = _scan(grid[-1][:-1], compose, apply, bits)
    index = grid.astype(np.uint16)
    index *= _STATES
    index += carry
    return np.ascontiguousarray(np.take(apply, index).T).reshape(-1)[:n]


def pretoken_starts(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Indices of the code points at which pre-tokens start.

    cp: code points of texts laid end to end; doc_starts: index of the first of each text that has any.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    number, compose, apply, starts, bits = _tables()
    kind = classes()[cp]
    first = np.zeros(n, bool)
    first[doc_starts] = True
    last = np.empty(n, bool)
    last[:-1] = first[1:]
    last[-1] = True
    symbol = kind.copy()
    blank = kind == _BLANK
    ahead = np.empty(n, bool)  # text follows
    ahead[:-1] = ~blank[1:]
    ahead[-1] = False
    ahead &= ~last
    symbol[blank] = _IN
    symbol[blank & ahead] = _WS
    symbol[blank & ahead & (cp == 0x20)] = _SP
    quote = np.flatnonzero((cp == 0x27) & ~last)
    if len(quote):
        one = cp[quote + 1]
        more = ~last[quote + 1]
        two = np.where(more, cp[np.minimum(quote + 2, n - 1)], 0)
        ord_ = lambda c: ord(c)
        single = (one == ord_("s")) | (one == ord_("t")) | (one == ord_("m")) | (one == ord_("d"))
        double = ((one == ord_("r")) | (one == ord_("v"))) & (two == ord_("e")) | (one == ord_("l")) & (two == ord_("l"))
        symbol[quote[single]] = _A1
        symbol[quote[double]] = _A2
    ids = number[symbol]
    ids[first] = number[_SYMBOLS + symbol[first]]
    before = np.zeros(n, np.uint8)
    before[1:] = _scan(ids, compose, apply, bits)[:-1]
    before[first] = _START
    index = symbol.astype(np.uint8)
    index *= _STATES
    index += before
    return np.flatnonzero(starts[index])


def pretoken_starts_of(text: str) -> list[int]:
    """The same for one short text: the automaton, a step a code point."""
    kinds, n, out, state = classes(), len(text), [], _START
    kind = [int(kinds[ord(c)]) for c in text]
    for i, k in enumerate(kind):
        if k == _BLANK:
            symbol = _IN if i + 1 == n or kind[i + 1] == _BLANK else _SP if text[i] == " " else _WS
        elif text[i] == "'":
            ahead = text[i + 1 : i + 3]
            symbol = _A1 if ahead[:1] in ("s", "t", "m", "d") and ahead else _A2 if ahead in ("re", "ve", "ll") else _O
        else:
            symbol = (_L, _N, _O)[k]
        state, new = _STEPS[symbol][state]
        if new:
            out.append(i)
    return out


_STEPS = [[_step(q, s) for q in range(_STATES)] for s in range(_SYMBOLS)]
