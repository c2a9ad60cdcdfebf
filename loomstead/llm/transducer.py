"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming inverse."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import regex

#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters, digits and blanks of the commonest scripts, with punctuation and symbols that are neither.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0400-\u0481\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
BLANKS = "\\t\\n\\x0b\\x0c\\r "
#: PATTERN over these characters alone, for the faster of the two matchers; any other character calls for PATTERN itself.
COMMON = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^{BLANKS}{LETTERS}0-9]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+").findall
UNCOMMON = re.compile(f"[^{BLANKS}\\x20-\\x7e{LETTERS}\u2010-\u2027\u2190-\u21ff\u2700-\u2775\u2794-\u27bf]").search
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES_KEPT = 300_000
STATES_KEPT = 300_000


def read_ranks(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class BpeTransducer:
    """Maps the bytes of a piece of text to token ids, one byte at a time.

    After any prefix of a piece the last token of its encoding is fixed, so the encodings of all prefixes
    form a tree. A state is the last token emitted and the bytes read since; which tokens may still change
    is told by the live positions, those from which the bytes read are a prefix of some token. What lies
    before the nearest common ancestor of all live positions is final and is emitted, so the lookahead is
    bounded by the longest token. States and arcs are made when first needed and kept; pieces met before
    are remembered. Both memories are emptied when full and filled anew, which changes no result.
    """

    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.prefixes = {t[:n] for t in self.ranks for n in range(1, len(t) + 1)}
        self._fits: dict[tuple[int, int], bool] = {}
        self._clear_states()
        self._split_any = regex.compile(PATTERN).findall
        transducer = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                if len(self) >= PIECES_KEPT:
                    self.clear()
                ids = tuple(transducer.run(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def _clear_states(self) -> None:
        self._numbers: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self._configs: list[tuple[int, bytes]] = [(-1, b"")]
        self._lasts: list[list[int | None]] = [[-1]]
        self._arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self._ends: list[tuple[int, ...] | None] = [()]

    def _merge(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens stand side by side in the encoding of their bytes."""
        key = (a, b)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._merge(self.tokens[a] + self.tokens[b]) == [self.tokens[a], self.tokens[b]]
        return known

    def _last_tokens(self, known: list[int | None], data: bytes) -> list[int | None]:
        """For each prefix of data, the last token of its encoding; known holds the first ones.

        The first entry is the token before data (-1: none). None stands where the last token begins
        before data: such a prefix is no live position and nothing builds on it.
        """
        last = list(known)
        for end in range(len(known), len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = self.ranks.get(data[start:end])
                if token is None or last[start] is None:
                    continue
                if last[start] == -1 or self._compatible(last[start], token):
                    last.append(token)
                    break
            else:
                last.append(None)
        return last

    def _inside(self, last: Sequence[int | None], end: int, start: int) -> int | None:
        """The last token of the prefix up to end if it begins at start or later."""
        token = last[end]
        return token if token is not None and end - len(self.tokens[token]) >= start else None

    def _trail(self, last: Sequence[int], end: int) -> list[int]:
        """Positions on the way from end back to 0."""
        trail = [end]
        while end > 0:
            end -= len(self.tokens[last[end]])
            trail.append(end)
        return trail

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, pending = self._configs[state]
        data = pending + bytes([byte])
        last = self._last_tokens(self._lasts[state], data)
        n = len(data)
        common: list[int] | None = None
        for q in range(max(0, n - self.longest), n + 1):
            if q == n or data[q:] in self.prefixes:
                trail = self._trail(last, q)
                common = trail if common is None else [p for p in common if p in trail]
        final = max(common)
        emitted = []
        for p in sorted(self._trail(last, final))[1:]:
            emitted.append(last[p])
        config = (emitted[-1] if emitted else before, data[final:])
        number = self._numbers.get(config)
        if number is None:
            number = self._add(config, [config[0], *(self._inside(last, p, final) for p in range(final + 1, n + 1))])
        arc = (number, tuple(emitted))
        self._arcs[state][byte] = arc
        return arc

    def _add(self, config: tuple, last: list) -> int:
        number = self._numbers[config] = len(self._configs)
        self._configs.append(config)
        self._lasts.append(last)
        self._arcs.append({})
        self._ends.append(None)
        return number

    def _forget(self, state: int) -> int:
        """Drop all states but the one a piece is in, and return its new number."""
        config, last = self._configs[state], self._lasts[state]
        self._clear_states()
        number = self._numbers.get(config)
        return self._add(config, last) if number is None else number

    def _end(self, state: int) -> tuple[int, ...]:
        ids = self._ends[state]
        if ids is None:
            pending, last = self._configs[state][1], self._lasts[state]
            ids = self._ends[state] = tuple(last[p] for p in sorted(self._trail(last, len(pending)))[1:])
        return ids

    def run(self, data: bytes) -> Iterator[int]:
        if len(self._configs) > STATES_KEPT:
            self._clear_states()
        whole = self.ranks.get(data)
        if whole is not None:
            yield whole
            return
        state, arcs = 0, self._arcs
        for byte in data:
            arc = arcs[state].get(byte)
            if arc is None:
                arc = self._step(state, byte)
                if len(self._configs) > STATES_KEPT:
                    # a long piece of random letters makes states faster than pieces end
                    arc = (self._forget(arc[0]), arc[1])
                    arcs = self._arcs
            state, emitted = arc
            yield from emitted
        yield from self._end(state)

    def split(self, text: str) -> list[str]:
        """The pieces of a text by PATTERN."""
        return COMMON(text) if UNCOMMON(text) is None else self._split_any(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; the empty list for an empty or null text."""
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.pieces.__getitem__, self.split(text)))) if text else 0


class StreamDecoder:
    """Text of token ids as they arrive: bytes go through a UTF-8 state machine that holds back unfinished characters.

    Bytes that are no UTF-8 become U+FFFD, each maximal invalid run as a decoder with replacement gives it.
    """

    #: Fixed values of UTF-8: lead byte range, following bytes, range of the first following byte.
    LEADS = (
        (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
        (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
    )

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.lead = {b: (n, lo, hi) for a, z, n, lo, hi in self.LEADS for b in range(a, z + 1)}
        self.plain: dict[int, str] = {}
        for i, t in tokens.items():
            try:
                self.plain[i] = t.decode("utf-8")
            except UnicodeDecodeError:
                pass
        self.reset()

    def reset(self) -> None:
        self.held, self.more, self.low, self.high = b"", 0, 0x80, 0xBF

    def _byte(self, b: int) -> str:
        out = ""
        if self.more:
            if self.low <= b <= self.high:
                self.held += bytes([b])
                self.more, self.low, self.high = self.more - 1, 0x80, 0xBF
                if self.more:
                    return out
                out, self.held = self.held.decode("utf-8"), b""
                return out
            out = "�"
            self.reset()
        if b < 0x80:
            return out + chr(b)
        if b in self.lead:
            self.more, self.low, self.high = self.lead[b]
            self.held = bytes([b])
            return out
        return out + "�"

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        for i in ids:
            text = None if self.more else self.plain.get(i)
            if text is None:
                text = "".join(map(self._byte, self.tokens[i]))
            if text:
                yield text

    def finish(self) -> str:
        rest = "�" if self.more else ""
        self.reset()
        return rest

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.feed(ids)) + self.finish()
