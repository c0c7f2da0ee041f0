"""Byte-level BPE as a bounded-lookahead streaming transducer, and the decoder as a byte-to-text state machine.

Every text, however short, runs through one ``Transducer`` in chunks of ``CHUNK`` characters. It works left to right with
constant memory beside the text:

* Pieces of text between the pre-tokenizer's cuts are independent, so a piece is finished once the cut behind it is known.
* Within a piece, what arrives later can change only tokens near the end. How near follows from the merge list: a
  change moves left through merges of rising rank, each of which shares a token with the one before it. The longest
  such chain, in bytes, plus the longest token is the *sufficient lookahead* (``lookahead``). A token that ends at
  least that far before the end of what has been read is stable and is emitted; only the rest is kept.

Behind it, ids of finished pieces are remembered in a memo of bounded bytes.

Null texts count as empty; an empty text has no ids. Special tokens are found in the text first, as the tokenizers
library does. Nothing here learns a vocabulary; files are read from a path.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import regex

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of characters up to U+00FF, where the classes can be written out.
LATIN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    r"| ?[^A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe\t-\r \x85\xa0]+"
    r"|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
#: Bytes that the memo of one worker takes, at most.
MEMO = 96 << 20
#: Above every merge's rank.
NEVER = 1 << 62
#: Characters that the transducer reads at a time.
CHUNK = 1 << 14


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    out, spare = {}, 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that suffice to know that the token is final.

    Merges are taken from the last to the first. ``reach[t]`` is the farthest left, in bytes, that a change to a token
    ``t`` can be felt through merges of higher rank than those taken so far that have ``t`` on their right: the merge
    ``(a, t)`` then takes place or not, which changes ``a``, or makes a new token ``a + t`` to the right of something.
    """
    reach: dict[bytes, int] = {}
    most = longest = 0
    for a, b in reversed(merges):
        longest = max(longest, len(a) + len(b))
        far = len(a) + max(reach.get(a, 0), reach.get(a + b, 0))
        if far > reach.get(b, 0):
            reach[b] = far
            most = max(most, far)
    return most + longest


@functools.cache
def _unassigned(char: str) -> bool:
    """Whether the character's class may depend on a regex engine's Unicode version: it has no category."""
    return unicodedata.category(char) == "Cn"


class _Memo(dict):
    """Ids, as little-endian bytes, of pieces seen before; emptied when ``MEMO`` bytes are full."""

    def __init__(self, coder: Coder):
        self.coder, self.bytes = coder, 0

    def __missing__(self, piece: str) -> bytes:
        out = array("I", self.coder._merge(piece.encode())).tobytes()
        if len(piece) <= 64:
            self.bytes += sys.getsizeof(piece) + sys.getsizeof(out) + 104  # and a place in the table
            if self.bytes > MEMO:
                self.clear()
                self.bytes = 0
            self[piece] = out
        return out


class Transducer:
    """Text in by chunks, ids out as soon as they are final. ``cut`` gives the pieces of a text that is taken as complete.

    The state is ``kept``, the text whose ids are not final yet: the last pieces, as far as later characters can change
    them, or of a piece that goes on, about twice the lookahead. Cutting ``kept`` and what follows gives the same pieces
    as the whole text: kept text begins at a cut or inside a run of one class that is longer than any fixed piece.
    """

    def __init__(self, coder: Coder, cut: Callable[[str], list[str]]):
        self.coder, self.cut, self.kept = coder, cut, ""

    def feed(self, chunk: str) -> bytes:
        pieces, tail = self.cut(self.kept + chunk), []
        # the last piece may go on; one of up to two characters before it may be the start of a contraction
        while pieces and sum(map(len, tail)) < 3:
            tail.append(pieces.pop())
        out = [*map(self.coder.memo.__getitem__, pieces)]
        self.kept = "".join(reversed(tail))
        if len(tail) == 1:
            stable, self.kept = self.coder.stable(self.kept)
            out.append(stable)
        return b"".join(out)

    def finish(self) -> bytes:
        kept, self.kept = self.kept, ""
        return b"".join([*map(self.coder.memo.__getitem__, self.cut(kept))])


class Coder:
    """Encoder and decoder of one byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE file without normalizer is needed")
        raw = lambda s: bytes(chars[c] for c in s)
        self.path = path
        self.ids = {raw(k): v for k, v in model["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        self.ranks = {}
        for k, (a, b) in enumerate(merges):
            self.ranks.setdefault((self.ids[a], self.ids[b]), k << 32 | self.ids[a + b])
        self.single = [self.ids.get(bytes([b])) for b in range(256)]
        self.lookahead = lookahead(merges)
        self.size = max([*self.ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for t, i in self.ids.items():
            self.tokens[i] = t
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.pattern, self.latin = regex.compile(PATTERN), re.compile(LATIN)
        self.memo = _Memo(self)
        self._library = None

    # -- encoding -----------------------------------------------------------------------------------------------

    def _merge(self, data: bytes) -> list[int]:
        """Token ids of a byte string that is taken as complete: merges by rank, leftmost first."""
        ids: list[int | None] = [self.single[b] for b in data]
        n, rank = len(ids), self.ranks.get
        if n <= 48:
            next_ranks = [rank(pair, NEVER) for pair in zip(ids, ids[1:], strict=False)]
            while next_ranks and (least := min(next_ranks)) != NEVER:
                i = next_ranks.index(least)
                ids[i] = least & 0xFFFFFFFF
                del ids[i + 1], next_ranks[i]
                if i:
                    next_ranks[i - 1] = rank((ids[i - 1], ids[i]), NEVER)
                if i < len(next_ranks):
                    next_ranks[i] = rank((ids[i], ids[i + 1]), NEVER)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r & 0xFFFFFFFF, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := rank((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [i for i in ids if i is not None]

    def stable(self, piece: str) -> tuple[bytes, str]:
        """Ids of an open piece that nothing behind it can change, and the text that is left; none of a short one."""
        data = piece.encode()
        if len(data) <= 2 * self.lookahead:
            return b"", piece
        ids, end, n, at = self._merge(data), 0, 0, 0
        for k, i in enumerate(ids):
            at += len(self.tokens[i])
            if at > len(data) - self.lookahead:
                break
            if data[at] & 0xC0 != 0x80:  # a character ends here
                n, end = k + 1, at
        return array("I", ids[:n]).tobytes(), data[end:].decode()

    def _cutter(self, text: str) -> Callable[[str], list[str]]:
        """How texts of these characters are cut: by the plainest pattern that gives the library's pieces."""
        if text.isascii():
            return self.latin.findall
        try:
            text.encode("latin-1")
            return self.latin.findall
        except UnicodeEncodeError:
            if not any(map(_unassigned, set(text))):
                return self.pattern.findall
        from tokenizers import Tokenizer

        self._library = self._library or Tokenizer.from_file(self.path)
        chars, split = byte_alphabet(), self._library.pre_tokenizer.pre_tokenize_str
        return lambda t: [bytes(chars[c] for c in piece).decode() for piece, _ in split(t)]

    def _plain(self, text: str) -> Iterator[bytes]:
        machine = Transducer(self, self._cutter(text))
        for k in range(0, len(text), CHUNK):
            yield machine.feed(text[k : k + CHUNK])
        yield machine.finish()

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text as little-endian unsigned 32-bit integers, in parts as they become final."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            yield from self._plain(text)
            return
        for k, part in enumerate(self.special_pattern.split(text)):
            if k % 2:
                yield np.array([self.special[part]], "<u4").tobytes()
            elif part:
                yield from self._plain(part)

    def encode_all(self, text: str) -> bytes:
        return b"".join(self.encode(text))

    # -- decoding -----------------------------------------------------------------------------------------------

    def decode(self, parts: Iterator[bytes]) -> Iterator[str]:
        """Text of ids that arrive in parts.

        The state between parts is the start of an unfinished UTF-8 sequence, at most three bytes. Bytes that are no
        UTF-8 become U+FFFD, one for each longest invalid run, as in the tokenizers library.
        """
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        token = self.tokens.__getitem__
        for part in parts:
            yield machine.decode(b"".join(map(token, np.frombuffer(part, "<u4").tolist())))
        yield machine.decode(b"", final=True)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One coder for each file and worker process."""
    return Coder(path)
