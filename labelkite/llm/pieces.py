"""Token ids of whole texts, encoding each distinct piece of text once.

A text is cut at places where the tokenizer's own rules always cut, so that a piece alone has the ids
that it has inside the text. Pieces repeat; each distinct one is encoded once and remembered in the
Python worker, up to a stated number. A hash finds a remembered piece; its bytes are compared before its
ids are used. The ids are those of the ``tokenizers`` library on the whole
text: simple pieces go through the library's model, all others through its full encoder, and texts
with special strings go there whole.
"""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np
from tokenizers import Tokenizer

from labelkite.llm import bytehash

REMEMBERED = 1_500_000  # distinct pieces that a worker keeps: some 100 MB

# The splitting rule and the normal form of the public word vocabulary.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMAL = ["NFC", "Replace", "Lowercase"]

LETTER, DIGIT, OTHER, QUOTE, BLANK, SPACE, UNKNOWN = 1, 2, 4, 8, 16, 32, 64
SOLID = LETTER | DIGIT | OTHER | QUOTE

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_one_piece = re.compile(rf" ?(?:[{LATIN}]+|[0-9]+|[^\x00-\x20'{LATIN}0-9\x7f-\U0010ffff]+)").fullmatch


def worker_memory() -> dict:
    """A dict that lives as long as this Python worker, shared by its tasks."""
    name = "_labelkite_worker_memory"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, UNKNOWN, np.uint8)
    kinds[33:127] = OTHER
    kinds[ord("0") : ord("9") + 1] = DIGIT
    kinds[ord("A") : ord("Z") + 1] = kinds[ord("a") : ord("z") + 1] = LETTER
    kinds[ord("'")], kinds[ord(" ")] = QUOTE, BLANK
    kinds[[9, 10, 13]] = SPACE
    return kinds


_KINDS = _byte_kinds()
# First bytes of two-byte characters that are letters throughout: U+00C0..U+017F, U+0400..U+047F.
_LETTER_LEADS = np.isin(np.arange(256), [0xC3, 0xC4, 0xC5, 0xD0, 0xD1])


def kinds_of(raw: np.ndarray) -> np.ndarray:
    """The kind of each byte; both bytes of a known two-byte letter are letters."""
    kinds = _KINDS[raw]
    lead = _LETTER_LEADS[raw]
    if lead.any():
        at = np.flatnonzero(lead)
        # Not the signs of multiplication and division, nor U+0130, whose lower case is two characters.
        odd = (raw[at] == 0xC3) & np.isin(raw[at + 1], [0x97, 0xB7]) | (raw[at] == 0xC4) & (raw[at + 1] == 0xB0)
        at = at[~odd]
        kinds[at] = LETTER
        kinds[at + 1] = LETTER
    return kinds


def cuts(raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Places, in bytes, where every rule below ends a token; row borders included.

    * A run of letters, digits or other signs ends before any other known kind, but an apostrophe
      stays with the letters after it (contractions) and with signs on either side.
    * A blank goes with what follows. Only one white-space sign that stands alone and is no blank is
      cut from what follows; longer runs of white space stay with it.
    * Next to an unknown sign nothing is cut.
    """
    kinds = kinds_of(raw)
    edge = np.zeros(len(raw) + 1, bool)
    edge[borders] = True
    if len(raw) < 2:
        return np.flatnonzero(edge)
    a, b = kinds[:-1], kinds[1:]
    solid = (a & SOLID) != 0
    differ = solid & (b != UNKNOWN) & (a != b)
    signs = OTHER | QUOTE
    differ &= ~(((a & signs) != 0) & ((b & signs) != 0))
    differ &= ~((a == QUOTE) & (b == LETTER))
    before = np.concatenate([[SOLID], a[:-1]])
    before[edge[:-2]] = SOLID  # a text starts there
    alone = (a == SPACE) & ((b & SOLID) != 0) & ((before & SOLID) != 0)
    edge[1:-1] |= differ | alone
    return np.flatnonzero(edge)


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: b for b in shown}, **{b: 256 + i for i, b in enumerate(hidden)}}


class PieceCoder:
    """Ids or counts of texts under one ``tokenizers`` file, without special tokens added."""

    def __init__(self, path: str, keep_ids: bool = True):
        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.rule = _rule_of(spec)
        self.letters = _byte_letters()
        self.keep_ids = keep_ids
        self._forget()

    @classmethod
    def of_worker(cls, path: str, keep_ids: bool = True) -> "PieceCoder":
        memory = worker_memory()
        key = f"pieces {keep_ids} {path}"
        if key not in memory:
            memory[key] = cls(path, keep_ids)
        return memory[key]

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes in order
        self.place = np.zeros(0, np.int64)  # number of each in the lists below
        self.sizes = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.lengths = np.zeros(1024, np.int64)  # bytes of each piece
        self.at = np.zeros(1024, np.int64)  # where its bytes start in the next, eight at a time
        self.bytes = np.zeros(4096, np.uint64)
        self.n = self.n_ids = self.n_bytes = 0

    def counts(self, raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Number of ids of each text: its pieces' frequencies joined to the counts of the pieces."""
        pieces, row = self._look_up(raw, borders)
        # Each distinct piece of a text with its frequency, joined to its count.
        pairs, frequency = np.unique(row * max(self.n, 1) + pieces, return_counts=True)
        of_row, piece = np.divmod(pairs, max(self.n, 1))
        return np.bincount(of_row, frequency * self.sizes[piece], len(borders) - 1).astype(np.int64)

    def encode(self, raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        pieces, row = self._look_up(raw, borders)
        sizes = self.sizes[pieces]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[pieces] - (ends - sizes), sizes) + np.arange(total)
        return self.ids[at], np.bincount(row, sizes, len(borders) - 1).astype(np.int64)

    def _look_up(self, raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece, and the row that it is in."""
        if len(self.known) > REMEMBERED:
            self._forget()
        at = self._cuts(raw, borders)
        starts, ends = at[:-1], at[1:]
        row = np.searchsorted(borders, starts, "right") - 1
        if not len(starts):
            return np.zeros(0, np.int64), row
        lengths = ends - starts
        taken, groups = bytehash.groups(raw, starts, ends)
        distinct, first, codes = np.unique(
            bytehash.hashes_of(taken, groups, lengths), return_index=True, return_inverse=True
        )
        spot = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inner = spot < len(self.known)
        new[inner] = self.known[spot[inner]] != distinct[inner]
        numbers = np.zeros(len(distinct), np.int64)
        numbers[~new] = self.place[spot[~new]]
        if new.any():
            numbers[new] = self._learn(raw, starts[first[new]], ends[first[new]])
            self.known = np.insert(self.known, spot[new], distinct[new])
            self.place = np.insert(self.place, spot[new], numbers[new])
        found = numbers[codes]
        other = self._other(found, taken, groups, lengths)
        if len(other):  # the hash of another piece: these get numbers of their own
            found[other] = self._learn(raw, starts[other], ends[other])
        return found, row

    def _other(self, found: np.ndarray, taken: np.ndarray, groups: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which pieces have other bytes than the remembered ones of these numbers."""
        other = self.lengths[found] != lengths
        if other.any():
            taken, groups, found = taken[np.repeat(~other, groups)], groups[~other], found[~other]
        first = np.cumsum(groups) - groups
        equal = self.bytes[np.repeat(self.at[found] - first, groups) + np.arange(len(taken))] == taken
        if not equal.all():
            other[np.flatnonzero(~other)[~np.logical_and.reduceat(equal, first)]] = True
        return np.flatnonzero(other)

    def _cuts(self, raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
        if self.rule == "whole":
            return np.unique(borders)
        at = cuts(raw, borders)
        if any(s in memoryview(raw).tobytes() for s in self.special):
            for a, b in zip(borders[:-1], borders[1:]):
                text = raw[a:b].tobytes()
                if any(s in text for s in self.special):
                    at = at[(at <= a) | (at >= b)]
        return at

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode and remember pieces; their numbers."""
        new = [raw[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist())]
        found = self._simple(new)
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i in range(0, len(rest), 256):
            some = rest[i : i + 256]
            for k, e in zip(some, self.full.encode_batch([new[k] for k in some], add_special_tokens=False)):
                found[k] = e.ids if self.keep_ids else len(e)
        sizes = np.fromiter(map(len, found) if self.keep_ids else found, np.int64, len(found))
        a, b, total = self.n, self.n + len(found), int(sizes.sum())
        taken, groups = bytehash.groups(raw, starts, ends)
        self.lengths, self.at = _room(self.lengths, b), _room(self.at, b)
        self.bytes = _room(self.bytes, self.n_bytes + len(taken))
        self.lengths[a:b] = ends - starts
        self.at[a:b] = self.n_bytes + np.cumsum(groups) - groups
        self.bytes[self.n_bytes : self.n_bytes + len(taken)] = taken
        self.n_bytes += len(taken)
        self.sizes = _room(self.sizes, b)
        self.sizes[a:b] = sizes
        self.n = b
        if self.keep_ids:
            self.starts, self.ids = _room(self.starts, b), _room(self.ids, self.n_ids + total)
            self.starts[a:b] = self.n_ids + np.cumsum(sizes) - sizes
            self.ids[self.n_ids : self.n_ids + total] = [x for ids in found for x in ids]
            self.n_ids += total
        return np.arange(a, b)

    def _simple(self, new: list[str]) -> list:
        """Ids, or their number, of the pieces that are one run of letters, digits or signs; None for the others."""
        found: list = [None] * len(new)
        if self.rule == "whole":
            return found
        at = [i for i, p in enumerate(new) if _one_piece(p)]
        if self.rule == "word":
            at = [i for i in at if not (new[i][-1].isdigit() and len(new[i].lstrip(" ")) > 1)]
        joined = "\x00".join([new[i] for i in at])
        if self.rule == "word":
            joined = joined.replace(" ", "").lower()
        letters = joined.encode().decode("latin-1").translate(self.letters).split(chr(self.letters[0]))
        tokenize = self.full.model.tokenize
        for i, p in zip(at, letters):
            found[i] = [t.id for t in tokenize(p)] if self.keep_ids else len(tokenize(p))
        return found


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    grown = np.zeros(max(n, 2 * len(array)), array.dtype)
    grown[: len(array)] = array
    return grown


def _rule_of(spec: dict) -> str:
    """How this file cuts texts: "blank" and "word" are known rules, all else is encoded whole."""
    pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    whole = spec.get("truncation") or spec.get("padding") or spec["model"].get("type") != "BPE"
    if whole or spec["model"].get("dropout") or any(t.get("normalized") for t in spec.get("added_tokens", [])):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "blank" if normal is None else "whole"
    steps = pre.get("pretokenizers") or [{}]
    if (
        len(steps) == 2
        and steps[0].get("pattern") == {"Regex": WORD_RULE}
        and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and steps[1].get("type") == "ByteLevel"
        and not (steps[1].get("use_regex") or steps[1].get("add_prefix_space"))
        and [n.get("type") for n in (normal or {}).get("normalizers", [])] == WORD_NORMAL
    ):
        return "word"
    return "whole"
