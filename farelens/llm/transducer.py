"""Token counts from a finite-state transducer that is compiled from a byte-level BPE vocabulary.

The machine reads a text code point by code point. Its transitions carry the number of tokens they add to the count, so the count of a
text is a sum along one path. A state is made of two parts:

* where the pre-splitting stands: within letters, digits, other signs, after an apostrophe, or in white space whose last character may
  still belong to the next word;
* where the merges stand: for every position from which a vocabulary entry can still reach past the end, the bytes since that position,
  the last token of the text before it, and the number of tokens since. The last token of each prefix decides the tokens of every
  longer prefix: a token can end a prefix exactly if it merges undisturbed beside the last token before it.

States and transitions are compiled when they are first needed, kept in a Python worker, and dropped together at a fixed number.
"""

from __future__ import annotations

import functools
import json

from tokenizers.pre_tokenizers import ByteLevel

_START, _LETTERS, _DIGITS, _OTHER, _SPACE, _APOS, _APOS_TWO = range(7)
_SHORT, _LONG = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}
_SPLIT = ByteLevel(add_prefix_space=False)
MAX_STATES, MAX_WORDS, MAX_WORD = 200_000, 600_000, 40
#: The state after a character that is no white space and one space.
_AFTER_WORD = (_SPACE, None, " ")


def _byte_letters() -> dict[str, int]:
    """Printable stand-ins of bytes in vocabulary files: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Merges:
    """States of the merges within one pre-split piece."""

    def __init__(self, tokens: list[bytes], pairs: dict[tuple[bytes, bytes], int]):
        self.tokens = frozenset(tokens)
        #: Beginnings of tokens; each is one object that all states share.
        self.prefixes = {t[:k]: t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.pairs = pairs
        #: token: the two parts it is made of, and the rank of that merge
        self.made = {a + b: (a, b, rank) for (a, b), rank in pairs.items()}
        self.reached = functools.lru_cache(1 << 16)(lambda token: self.merged(token) == [token])
        self.beside = functools.lru_cache(1 << 16)(self._beside)
        self.step = functools.lru_cache(1 << 14)(self._step)

    def merged(self, data: bytes) -> list[bytes]:
        """Tokens by merging the best-ranked pair again and again, the leftmost of equals first."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, k = min((self.pairs.get(pair, 1 << 60), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _beside(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens side by side stay as they are; an empty left one stands for the start.

        The merges inside both are undone from the last to the first. While two parts met at the border, they stayed apart if their
        own merge ranks after the merge that took one of them away; of equal ranks the one further left comes first.
        """
        if not left:
            return self.reached(right)
        until_left = until_right = 1 << 60
        while True:
            rank = self.pairs.get((left, right))
            if rank is not None and rank < until_left and rank <= until_right:
                return False
            of_left, of_right = self.made.get(left), self.made.get(right)
            if of_left and (not of_right or of_left[2] > of_right[2]):
                left, until_left = of_left[1], of_left[2]
            elif of_right:
                right, until_right = of_right[0], of_right[2]
            else:
                return True

    #: Before the first byte: nothing since the start, no last token, no tokens since. States are flat: three fields for each position.
    first = (b"", b"", 0)

    def _step(self, state: tuple, byte: bytes) -> tuple[tuple, int]:
        """Next state and the tokens that the byte adds."""
        token, total, alive = None, 0, []
        for k in range(0, len(state), 3):
            longer = self.prefixes.get(state[k] + byte)
            if longer is None:
                continue
            if token is None and longer in self.tokens and self.beside(state[k + 1], longer):
                token, total = longer, state[k + 2] + 1
            alive += (longer, state[k + 1], state[k + 2])
        # Counts are kept relative to the end, so that equal situations are one state.
        for k in range(2, len(alive), 3):
            alive[k] -= total
        return (*alive, b"", token, 0), total


class Transducer:
    """count(text): the tokens of a text. Transitions are tables from code point to (next state, tokens added)."""

    def __init__(self, tokens: list[bytes], pairs: dict[tuple[bytes, bytes], int], special: str = ""):
        self.merges = _Merges(tokens, pairs)
        self.special = special
        #: Tokens of a word on the way from _AFTER_WORD back to it. They outlive the tables, which they do not point into.
        self.words: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.shared: dict[tuple, tuple] = {}
        for state in getattr(self, "table", {}).values():
            state.clear()  # states point at each other; emptied, they are freed at once
        self.table: dict[tuple, dict] = {}
        self.start = self._state((_START, None, ""))

    def _state(self, key: tuple) -> dict:
        found = self.table.get(key)
        if found is None:
            if key[1]:  # many states differ in where they stand only
                key = (key[0], self.shared.setdefault(key[1], key[1]), key[2])
            found = self.table[key] = {None: key}
        return found

    def _feed(self, merges: tuple | None, text: str) -> tuple[tuple, int]:
        state, total = merges or self.merges.first, 0
        for byte in text.encode("utf-8", "surrogatepass"):
            state, n = self.merges.step(state, bytes((byte,)))
            total += n
        return state, total

    @staticmethod
    @functools.lru_cache(1 << 16)
    def kind(ch: str) -> int:
        """Class of a character, as the library has it: releases of Unicode differ in the newest characters."""
        joins = lambda first: len(_SPLIT.pre_tokenize_str(first + ch)) == 1
        return next((kind for first, kind in (("a", _LETTERS), ("1", _DIGITS), ("!", _OTHER)) if joins(first)), _SPACE)

    def _next(self, key: tuple, ch: str) -> tuple[tuple, int]:
        """The rules of the pre-splitting; ``held`` is text that is read but not yet counted."""
        where, merges, held = key
        kind = self.kind(ch)
        if where == _SPACE:
            if kind == _SPACE:  # the character held belongs to the run for certain
                merges, n = self._feed(merges, held)
                return (_SPACE, merges, ch), n
            if held == " ":  # it opens the next piece
                merges, n = self._feed(None, " " + ch)
                return (kind, merges, ""), n
            _, n = self._feed(None, held)
            after, m = self._next((_START, None, ""), ch)
            return after, n + m
        if where == _APOS:  # an apostrophe that opens a piece
            if kind == _OTHER:
                merges, n = self._feed(None, "'" + ch)
                return (_OTHER, merges, ""), n
            if ch in _SHORT:
                return (_START, None, ""), self._feed(None, "'" + ch)[1]
            if ch in _LONG:
                return (_APOS_TWO, None, ch), 0
            _, n = self._feed(None, "'")
            after, m = self._next((_START, None, ""), ch)
            return after, n + m
        if where == _APOS_TWO:
            if _LONG[held] == ch:
                return (_START, None, ""), self._feed(None, "'" + held + ch)[1]
            _, n = self._feed(None, "'")
            merges, m = self._feed(None, held)
            after, k = self._next((_LETTERS, merges, ""), ch)
            return after, n + m + k
        if where == kind:
            merges, n = self._feed(merges, ch)
            return (kind, merges, ""), n
        if kind == _SPACE:
            return (_SPACE, None, ch), 0
        if ch == "'":
            return (_APOS, None, "'"), 0
        merges, n = self._feed(None, ch)
        return (kind, merges, ""), n

    def _compile(self, state: dict, ch: str) -> tuple[dict, int]:
        key = state[None]
        if len(self.table) > MAX_STATES:
            self._reset()
            state = self._state(key)
        key, n = self._next(key, ch)
        arc = state[ch] = (self._state(key), n)
        return arc

    def _close(self, key: tuple) -> int:
        """Tokens still to count at the end of a text."""
        where, merges, held = key
        if where == _APOS_TWO:
            return self._feed(None, "'")[1] + self._feed(None, held)[1]
        return self._feed(merges, held)[1] if held else 0

    def _walk(self, state: dict, text: str) -> tuple[dict, int]:
        total = 0
        for ch in text:
            arc = state.get(ch)
            if arc is None:
                arc = self._compile(state, ch)
            state = arc[0]
            total += arc[1]
        return state, total

    def _run(self, text: str) -> int:
        """Sum along the path. Whole words between two spaces lead from one fixed state back to it; such paths are kept as one arc."""
        head, *words = text.split(" ")
        state, total = self._walk(self.start, head)
        arcs, last = self.words, len(words) - 1
        for k, word in enumerate(words):
            if k == 0:
                state, n = self._walk(state, " ")
                total += n
            if k == last:
                state, n = self._walk(state, word)
            elif state[None] != _AFTER_WORD:
                state, n = self._walk(state, word + " ")
            else:
                n = arcs.get(word)
                if n is None:
                    before = state
                    state, n = self._walk(state, word + " ")
                    if state is before and len(word) <= MAX_WORD:
                        if len(arcs) >= MAX_WORDS:
                            arcs.clear()
                        arcs[word] = n
            total += n
        return total + self._close(state[None])

    def count(self, text: str) -> int:
        """Tokens of a text; the special string counts as one wherever it stands."""
        if not self.special or self.special not in text:
            return self._run(text)
        parts = text.split(self.special)
        return sum(map(self._run, parts)) + len(parts) - 1


@functools.lru_cache(maxsize=2)
def from_json(path: str) -> Transducer:
    """Transducer of a byte-level BPE tokenizer file; compiled once in a Python worker."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    to_byte = _byte_letters()
    special = [t["content"] for t in spec["added_tokens"]]
    if len(special) > 1 or spec["normalizer"] or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("this kind of tokenizer file is not covered")
    raw = lambda token: bytes(to_byte[c] for c in token)
    split = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    tokens = [raw(t) for t in spec["model"]["vocab"] if t not in special]
    return Transducer(tokens, {(raw(a), raw(b)): k for k, (a, b) in enumerate(split)}, special[0] if special else "")
