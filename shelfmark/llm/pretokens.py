"""Splitting text into pre-tokens, and byte-pair merges; plain helpers that run inside tasks.

The pattern is that of the public byte-level vocabularies:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. The character classes
are built from the Unicode data at hand, as ``re`` with explicit ranges is several times faster than a
general engine.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache

# Letters and numbers of Unicode 16 that Python's tables (15.1) don't know yet.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
    (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
#: Fixed value: the characters with the White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"

#: Stand-ins for a character beyond the basic plane: a letter, a number, another mark.
_LETTER, _NUMBER, _MARK = "一", "2", "†"
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _kind(c: int) -> str:
    for kind, ranges in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)):
        if any(a <= c <= b for a, b in ranges):
            return kind
    return unicodedata.category(chr(c))[0]


@lru_cache(maxsize=1)
def _classes() -> tuple[str, str]:
    """Ranges of letters and of numbers on the basic plane, as inner parts of a character class."""
    out = {"L": [], "N": []}
    run, start = "", 0
    for c in range(0x10001):
        kind = _kind(c) if c < 0x10000 else ""
        if kind != run:
            if run in out:
                out[run].append(f"\\u{start:04x}-\\u{c - 1:04x}")
            run, start = kind, c
    return "".join(out["L"]), "".join(out["N"])


@lru_cache(maxsize=4)
def pattern(units: bool = False) -> re.Pattern:
    """The pre-token pattern for text of the basic plane.

    With ``units``, white space and the pre-token after it form one match where cutting the text
    between them would change how the white space splits.
    """
    letters, numbers = _classes()
    other = f"[^{WHITE}{letters}{numbers}]"
    tail = f"(?: (?:[{letters}]+|[{numbers}]+|{other}+)|[{WHITE}])?" if units else ""
    return re.compile(
        f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?{other}+"
        f"|[{WHITE}]+(?![^{WHITE}]){tail}|[{WHITE}]+"
    )


def _stand_in(found: re.Match) -> str:
    return {"L": _LETTER, "N": _NUMBER}.get(_kind(ord(found[0])), _MARK)


def split(text: str, units: bool = False) -> list[str]:
    """The pre-tokens of a text; joined, they are the text."""
    if text.isascii() or not _BEYOND.search(text):
        return pattern(units).findall(text)
    plain = _BEYOND.sub(_stand_in, text)
    return [text[m.start() : m.end()] for m in pattern(units).finditer(plain)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


def _byte_letters() -> dict[str, int]:
    """The letter that a merge file writes for each byte: printable bytes stand for themselves, the
    others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def read_merges(data: bytes) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """The merges of a tokenizer file in order, and its added tokens."""
    told = json.loads(data)
    byte = _byte_letters()
    plain = lambda s: bytes(byte[c] for c in s)
    merges = []
    for m in told["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((plain(a), plain(b)))
    return merges, [x["content"] for x in told.get("added_tokens", [])]


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the adjacent pair whose joint bytes rank lowest is joined first,
    the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    queue = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            queue.append((r, i, i + 2))
    heapq.heapify(queue)
    while queue:
        _, i, end = heapq.heappop(queue)
        if not alive[i]:
            continue
        j = after[i]
        if j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            stop = after[end]
            r = ranks.get(piece[i:stop])
            if r is not None:
                heapq.heappush(queue, (r, i, stop))
        if before[i] >= 0:
            r = ranks.get(piece[before[i] : end])
            if r is not None:
                heapq.heappush(queue, (r, before[i], end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class PrefixCounter:
    """Token counts of every prefix of a text, by dynamic programming over byte-pair merges.

    The encoding of a prefix is that of a shorter prefix and one token more: the only token that ends
    there and may stand behind the shorter prefix's last token. So the last token of each prefix gives
    all counts in one pass. Two tokens may be neighbours if no merge across their border comes earlier
    than the merges that build them; only the right edge of the one and the left edge of the other matter.
    """

    #: Words kept with their counts; later words are worked out each time.
    KEPT = 600_000
    KEPT_LENGTH = 64

    def __init__(self, data: bytes):
        merges, self.added = read_merges(data)
        self.rank = {m: r for r, m in reversed(list(enumerate(merges)))}
        self.parts: dict[bytes, tuple[bytes, bytes, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.parts.setdefault(a + b, (a, b, r))
        self._ends = self._endings()
        self._edges: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._kept: dict[str, bytes] = {}
        self._cut = re.compile("|".join(map(re.escape, self.added))) if self.added else None

    def _endings(self) -> dict:
        """The vocabulary as a tree over the bytes of its tokens from the last to the first."""
        root: dict = {}
        for token in [*(bytes([b]) for b in range(256)), *self.parts]:
            node = root
            for b in reversed(token):
                node = node.setdefault(b, {})
            node[-1] = token
        return root

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts down one side of a token with the rank of the merge that uses each up."""
        found = self._edges.get((token, side))
        if found is None:
            found, part, used = [], token, len(self.rank) + 1
            while True:
                found.append((part, used))
                if part not in self.parts:
                    break
                used = self.parts[part][2]
                part = self.parts[part][side]
            self._edges[token, side] = found
        return found

    def fits(self, a: bytes, b: bytes) -> bool:
        found = self._fits.get((a, b))
        if found is None:
            found = True
            for x, used in self._edge(a, 1):
                for y, gone in self._edge(b, 0):
                    r = self.rank.get((x, y))
                    # of equal merges the leftmost comes first
                    if r is not None and r < used and r <= gone:
                        found = False
            if len(self._fits) < 2_000_000:
                self._fits[a, b] = found
        return found

    def _piece(self, piece: str) -> list[int]:
        """Counts after each character of one pre-token, if all of its prefixes are pre-tokens too."""
        b = piece.encode("utf-8")
        last, count = [b""] * (len(b) + 1), [0] * (len(b) + 1)
        fits, known, root = self.fits, self._fits, self._ends
        for i in range(1, len(b) + 1):
            node, at = root, i
            while True:
                at -= 1
                node = node.get(b[at])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None:
                    if at == 0:
                        last[i], count[i] = token, 1
                        break
                    fit = known.get((last[at], token))
                    if fit or fit is None and fits(last[at], token):
                        last[i], count[i] = token, count[at] + 1
                        break
                if at == 0:
                    break
        if len(b) == len(piece):
            return count[1:]
        at, out = 0, []
        for c in piece:
            at += len(c.encode("utf-8"))
            out.append(count[at])
        return out

    def _unit(self, unit: str) -> list[int]:
        """Counts after each character of a unit (see ``pattern``), then its count once more text
        follows: white space that ends a text is one pre-token, before other text it is two."""
        pieces = split(unit)
        if len(pieces) == 2:
            white, rest = pieces
            run = self._piece(white + rest[0])
            base = run[len(white) - 1]
            found = run + [base + x for x in self._piece(rest)[1:]]
            return [*found, found[-1]]
        found = self._piece(unit)
        if len(unit) > 1 and unit.isspace():
            return [*found, found[-2] + self._piece(unit[-1])[0]]
        if len(unit) > 1 and unit[0] == "'" and unit[1] in "stmdrvl":
            # a contraction; cut short, it is the mark and a letter
            mark = self._piece("'")[0]
            return [mark, *(mark + x for x in self._piece(unit[1:])[:-1]), found[-1], found[-1]]
        return [*found, found[-1]]

    def unit_counts(self, unit: str) -> bytes:
        found = self._kept.get(unit)
        if found is None:
            found = array("I", self._unit(unit)).tobytes()
            if len(self._kept) < self.KEPT and len(unit) <= self.KEPT_LENGTH:
                self._kept[unit] = found
        return found

    def _plain(self, text: str):
        import numpy as np

        kept, fresh = self._kept, self.unit_counts
        joined = [kept.get(u) or fresh(u) for u in split(text, units=True)]
        if not joined:
            return np.zeros(0, np.int64)
        local = np.frombuffer(b"".join(joined), np.uintc).astype(np.int64)
        lengths = np.fromiter(map(len, joined), np.int64, len(joined)) // 4
        ends = np.cumsum(lengths) - 1
        totals = local[ends]
        counts = local + np.repeat(np.cumsum(totals) - totals, lengths)
        return np.delete(counts, ends)

    def counts(self, text: str):
        """Token counts after each character of the text, as an integer array. An added token inside
        the text counts once, when it is complete; until then its characters are text like any other."""
        import numpy as np

        if self._cut is None or not any(x in text for x in self.added):
            return self._plain(text)
        out, base, start = [], 0, 0
        for found in self._cut.finditer(text):
            before = text[start : found.start()]
            inside = self._plain(before + found[0])  # right for every proper prefix
            out.append(base + inside[:-1])
            base += (int(self._plain(before)[-1]) if before else 0) + 1
            out.append(np.array([base], np.int64))
            start = found.end()
        out.append(base + self._plain(text[start:]))
        return np.concatenate(out)
