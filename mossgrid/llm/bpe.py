"""Whole-text encoding with the tokenizers library, sped up by remembering units.

A unit is a stretch of text at whose ends the tokenizer always cuts, so the ids of a text
are the ids of its units in a row. Python workers remember the ids of units (a bounded
dictionary) and ask the library for unknown units in batches.

* byte-level vocabulary: a token never crosses the place before a space that stands between
  two non-spaces, nor before a single line feed; the space belongs to the unit after it.
* word vocabulary: white space is dropped by the tokenizer, so space and line feed separate
  units.

A text that holds an added token of the vocabulary is given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
from collections.abc import Iterable

import numpy as np

from .shared import of_worker

#: Units that a worker remembers for good, and those that it remembers for a while beyond them
#: (of a word vocabulary half as many).
REMEMBERED, PASSING = 700_000, 500_000

_GAP = re.compile(r" (?=\S)")
_SIGNS = string.punctuation
#: The letters that byte-level vocabularies write bytes with: printable ones stand for
#: themselves, the others for the code points from 256 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
_SPACE, _FEED = chr(_LETTERS[32]), chr(_LETTERS[10])


def _in_bytes(word: str) -> str:
    """A word's bytes in the vocabulary's letters."""
    return word.encode().decode("latin-1").translate(_LETTERS)


class UnitEncoder(dict):
    """Maps a unit to its ids as little-endian unsigned 32-bit bytes.

    A text that may hold an added token of the vocabulary is given to the library whole, as
    the library cuts such tokens out before anything else; with ``ordinary`` their strings
    are ordinary text.
    """

    def __init__(self, path: str, kind: str, ordinary: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.passing: list[str] = []
        self.kind = kind
        self.share = 2 if kind == "word" else 1  # words are cheap to look up again; they are a part of what a pipeline's worker holds
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        added = [] if ordinary else list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = sorted({x.content for x in added})
        self.added_in_any_case = sorted({x.content.lower() for x in added if x.normalized})
        # the same vocabulary and merges for many plain words at once: words of letters that
        # need no normalizing, written in the vocabulary's letters for bytes and cut at spaces;
        # an id tells whether it ends (word vocabulary) or begins (byte vocabulary) a word
        spec = json.loads(self.tokenizer.to_str())
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        if hasattr(self.plain.model, "_resize_cache"):
            self.plain.model._resize_cache(0)  # units are remembered here already
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids if kind == "byte" else []
        edge = [x for token, x in spec["model"]["vocab"].items() if (token.endswith("</w>") if kind == "word" else token.startswith("\u0120"))]
        self.edge = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)
        self.edge[edge] = True
        self.tails: dict[str, bytes] = {}

    def holds_added(self, text: str) -> bool:
        """Whether the library may find an added token in a text."""
        if any(x in text for x in self.added):
            return True
        return bool(self.added_in_any_case) and any(x in text.lower() for x in self.added_in_any_case)

    def units(self, text: str) -> list[str]:
        """Cut a text; a unit's first character tells what stands before it: a space (which
        only the first unit has) stands for nothing, a line feed for itself, any other
        character for the space that the cut took away."""
        if self.kind == "word":
            return text.replace("\n", " ").split(" ")
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] == " ":
            first, *rest = _GAP.split(text)
        else:
            first, *rest = text.replace("\n", " \n").split(" ")
        return [" " + first, *rest]

    def raw(self, unit: str) -> str:
        """The text that a unit stands for."""
        if self.kind == "word" or unit[:1] == "\n":
            return unit
        return unit[1:] if unit[:1] == " " else " " + unit

    @staticmethod
    def _lowers(unit: str) -> bool:
        """Whether the library's lower case (character by character, after NFC) is Python's."""
        return "\u03a3" not in unit and unicodedata.is_normalized("NFC", unit) and unicodedata.is_normalized("NFC", unit.lower())

    def _is_plain(self, unit: str) -> bool:
        return unit.isalpha() and (self.kind == "byte" or unit.isascii() or (unit.islower() and unicodedata.is_normalized("NFC", unit)))

    def _look_up(self, units: list[str]) -> None:
        """Ask the library for the ids of units, plain words many at a time."""
        plain, first, odd = [], [], []
        for u in units:
            (plain if self._is_plain(u) else first if len(self.feed) == 1 and u[:1] == "\n" and u[1:].isalpha() else odd).append(u)
        for at in range(0, len(first), 200):  # words after a line feed, each behind the token of one
            part = first[at : at + 200]
            text = " ".join([_FEED + " " + (u[1:] if u.isascii() else _in_bytes(u[1:])) for u in part])
            ids = np.asarray(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.append(np.flatnonzero(ids == self.feed[0]), len(ids))
            if len(cuts) != len(part) + 1:
                odd += part
                continue
            raw = ids.tobytes()
            for u, a, b in zip(part, (4 * cuts[:-1]).tolist(), (4 * cuts[1:]).tolist()):
                self[u] = raw[a:b]
        begin_with = "" if self.kind == "word" else _SPACE
        for at in range(0, len(plain), 200):
            part = plain[at : at + 200]
            text = begin_with + (" " + begin_with).join([u if u.isascii() else _in_bytes(u) for u in part])
            ids = np.asarray(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.edge[ids])
            cuts = 4 * (cuts + 1 if self.kind == "word" else np.append(cuts[1:], len(ids)))
            if len(cuts) != len(part):
                odd += part
                continue
            raw, begin = ids.tobytes(), 0
            for u, end in zip(part, cuts.tolist()):
                self[u] = raw[begin:end]
                begin = end
        for at in range(0, len(odd), 1024):
            part = odd[at : at + 1024]
            for u, x in zip(part, self.tokenizer.encode_batch_fast([self.raw(u) for u in part], add_special_tokens=False)):
                self[u] = np.asarray(x.ids, dtype="<u4").tobytes()

    def _tail(self, tail: str) -> bytes:
        """Ids of ASCII signs after a letter: always tokens of their own."""
        if tail not in self.tails:
            if len(self.tails) > 100_000:
                self.tails.clear()
            self.tails[tail] = np.asarray(self.tokenizer.encode(tail, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.tails[tail]

    def _letter(self, x: str) -> bool:
        """Whether a character ends in a letter, also as the tokenizer normalizes it."""
        if self.kind == "word" and not x.isascii():
            x = unicodedata.normalize("NFC", x).lower()[-1:]
        return x.isalpha()

    def learn(self, units: Iterable[str]) -> None:
        """Remember the units; ASCII signs after the last letter are tokens of their own."""
        if len(self.passing) > PASSING // self.share:
            for u in self.passing:
                self.pop(u, None)
            self.passing = []
        unknown = [u for u in dict.fromkeys(units) if u not in self]
        easy, other = (list(filter(str.isalpha, unknown)), [u for u in unknown if not u.isalpha()]) if self.kind == "byte" else ([], unknown)
        made: list[tuple[str, str, str]] = []
        for u in other:
            core, tail = u.rstrip(_SIGNS), ""
            if len(core) < len(u) and core and self._letter(core[-1]):
                tail = u[len(core) :]
            else:
                core = u
            if self.kind == "word" and (core.isascii() or self._lowers(core)):
                core = core.lower()
            made.append((u, core, tail))
        cores = {x for _, x, _ in made if x not in self}
        self._look_up(list({*easy, *cores}) if easy else list(cores))
        for u, core, tail in made:
            if u is not core:
                self[u] = self[core] + self._tail(tail) if tail else self[core]
        if len(self) > REMEMBERED // self.share:
            self.passing += unknown
            self.passing += cores.difference(unknown)

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Ids of each text with ``end`` after them, as little-endian unsigned 32-bit bytes."""
        tail = np.asarray([end], dtype="<u4").tobytes()
        out: list[bytes] = []
        for at in range(0, len(texts), 128):
            some = texts[at : at + 128]
            whole = {k for k, x in enumerate(some) if self.holds_added(x)}
            part = [[] if k in whole else self.units(x) for k, x in enumerate(some)]
            if sum(map(len, part)) > PASSING:
                own = [self._long(units) for units in part]
            else:
                own, found = [], [list(map(self.get, units)) for units in part]
                missing = [_gaps(ids) for ids in found]
                self.learn([units[i] for units, gaps in zip(part, missing) for i in gaps])
                for units, ids, gaps in zip(part, found, missing):
                    for i in gaps:
                        ids[i] = self[units[i]]
                    own.append(b"".join(ids))
            for k in whole:
                own[k] = np.asarray(self.tokenizer.encode(some[k], add_special_tokens=False).ids, dtype="<u4").tobytes()
            out += [x + tail for x in own]
        return out

    def _long(self, units: list[str]) -> bytes:
        """Ids of one text, a stretch at a time."""
        done = []
        for k in range(0, len(units), PASSING):
            some = units[k : k + PASSING]
            self.learn(some)
            done += map(self.__getitem__, some)
        return b"".join(done)


def _gaps(found: list) -> list[int]:
    """Places of None."""
    out, at = [], -1
    if None in found:
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            out.append(at)
    return out


def encoder(path: str, kind: str) -> UnitEncoder:
    """The worker's encoder for a vocabulary file; ``kind`` is "byte" or "word"."""
    return of_worker(("units", path, kind), lambda: UnitEncoder(path, kind))
