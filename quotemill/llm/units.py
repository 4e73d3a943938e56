"""Token ids of whole texts from blank-separated units, each distinct unit encoded once per worker.

A unit is a blank and what follows it up to the next blank. Where no unit is empty or starts with white
space, unit borders are borders of pre-tokens too: the pre-token pattern never joins a visible character
to a following blank, and of a run of white space before a visible character it leaves the last blank to
that character. So the ids of a text are those of its units in order. Any other text is encoded whole.

With ``marks`` a line break, and a comma or full stop after a letter or digit, begin a unit of their own without a
blank, written with a leading ``MARK``. That makes far fewer distinct units. Line breaks are marked only in texts where no
white space follows one, commas and full stops only in texts where
each that white space follows stands after a letter or digit.

New units of a batch are encoded as one string for each character they begin with; ids whose piece starts with
that character mark where each begins. The cache holds at most ``LIMIT`` units and starts anew when full.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable
from itertools import chain

import numpy as np

LIMIT = 700_000
MARK = "\0"
PAIR = re.compile(r"[,.](?<![^\W_].)\s")
SPACED = re.compile(r"\n(?=\s)")
EMPTY = np.zeros(0, np.uint32).tobytes()


class UnitEncoder:
    """``encode``: a text to ids. ``opens``: by first character and id, whether the piece starts with it.

    ``dummy``: the tokenizer puts a blank before each text by itself. ``odd``: texts that need the whole path.
    ``check``: called with each new unit and its ids, tells whether they are right.
    """

    def __init__(
        self,
        encode: Callable[[str], list[int]],
        opens: dict[str, np.ndarray],
        dummy: bool = False,
        marks: bool = False,
        odd: Callable[[str], bool] = lambda text: False,
        check: Callable[[list[str], list[bytes]], list[str]] | None = None,
        limit: int = LIMIT,
    ):
        self.encode, self.opens, self.dummy, self.marks = encode, opens, dummy, marks
        self.odd, self.check, self.limit = odd, check, limit
        self.known: dict[str, bytes | None] = {}
        self.wrong: set[str] = set()

    def cut(self, text: str) -> list[str]:
        if self.marks:
            pairs = PAIR.search(text)
            if "\n" in text and not SPACED.search(text):
                text = text.replace("\n", f" {MARK}\n")
            if not pairs:
                text = text.replace(", ", f" {MARK}, ").replace(". ", f" {MARK}. ")
        return text.split(" ")

    def rest(self, cut: list[str]) -> list[str] | None:
        """The units to look up: all but the first, or with ``marks`` the first too, behind a line break that goes later."""
        if not self.marks:
            return cut[1:]
        return None if cut[0][:1].isspace() else [f"{MARK}\n{cut[0]}", *cut[1:]]

    def learn(self, parts: list[str]) -> None:
        groups: dict[str, list[tuple[str, str]]] = {" ": [], "\n": [], "": []}
        for part in parts:
            if not part or (not self.dummy and part[0].isspace()):
                self.known[part] = None
            elif self.marks and part[0] == MARK:
                lead = "\n" if part[1] == "\n" and len(part) > 2 and not part[-1].isspace() else ""
                groups[lead].append((part, part[1:]))
            else:
                groups[" "].append((part, " " + part))
        for lead, units in groups.items():
            if not units:
                continue
            found = None
            if lead:
                joined = "".join(text for _, text in units)
                ids = np.array(self.encode(joined[1:] if self.dummy else joined), np.uint32)
                at = np.flatnonzero(self.opens[lead][ids])
                if len(at) == len(units):
                    raw, bounds = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                    found = [raw[i:j] for i, j in zip(bounds, bounds[1:])]
            if found is None:  # the character inside a unit too: one by one
                found = [self.whole(text[1:] if self.dummy else text) for _, text in units]
            names = [part for part, _ in units]
            self.known.update(zip(names, found, strict=True))
            if self.check:
                self.wrong.update(self.check(names, found))

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), np.uint32).tobytes() if text else EMPTY

    def batch(self, texts: list[str | None]) -> tuple[list[bytes], list[list[str] | None]]:
        """Little-endian unsigned 32-bit ids of each text, and its units where it was cut."""
        if len(self.known) > self.limit:
            self.known.clear()
            self.wrong.clear()
        cuts = [None if not text or self.odd(text) else self.cut(text) for text in texts]
        tails = [None if cut is None else cut if self.dummy else self.rest(cut) for cut in cuts]
        new = set(chain.from_iterable(t for t in tails if t)).difference(self.known)
        if new:
            self.learn(list(new))
            gc.freeze()  # what is kept holds no cycles: do not search it again and again
        out, known = [], self.known.__getitem__
        for n, (text, tail) in enumerate(zip(texts, tails, strict=True)):
            if tail is None:
                out.append(self.whole(text) if text else EMPTY)
                continue
            try:
                ids = b"".join(map(known, tail))
            except TypeError:  # a unit that is no unit
                cuts[n] = None
                out.append(self.whole(text))
                continue
            out.append(ids if self.dummy else ids[4:] if self.marks else self.whole(cuts[n][0]) + ids)
        return out, cuts


def byte_bpe(spec: str, marks: bool = False, limit: int = LIMIT) -> UnitEncoder:
    """From the JSON of a byte-level BPE tokenizer; special strings in a text are ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.encode_special_tokens = True
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    opens = {}
    for lead, sign in ((" ", "Ġ"), ("\n", "Ċ")):
        opens[lead] = np.zeros(max(vocabulary.values()) + 1, bool)
        opens[lead][[i for piece, i in vocabulary.items() if piece.startswith(sign)]] = True
    encode = lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
    return UnitEncoder(encode, opens, marks=marks, odd=lambda text: marks and MARK in text, limit=limit)
