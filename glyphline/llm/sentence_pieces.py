"""SentencePiece encoding with the byte span of every piece, and decoding.

1. Normalisation: from left to right the longest key of the model's compiled character map that the text goes on with is
   replaced; every stretch of the result remembers where it came from (``Alignment``).
2. Merging: symbols of one character are joined pair by pair, best score first, leftmost first (the model's own rule).
   Where no piece of the vocabulary goes on from a word into a space mark, words are merged each for itself and met again
   in a table.
3. Projection: the ends of pieces in the normalised text are looked up in the alignment, which gives spans of the original.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import ship_package
from .common import chunks, mix, utf8

# fixed values: the space mark, and the types of pieces in a model file
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNK_SURFACE = " ⁇ "

TABLE_WORDS, TABLE_CODES = 1 << 18, 1 << 21  # of segments that stay known from chunk to chunk
AT_ONCE_WORDS, AT_ONCE_CHARS = 1 << 15, 64
_NEVER = (1 << 30) - 1
CHUNK_CHARS = 1 << 20


# --- model files ----------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = 4 if kind == 5 else 8
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class CharacterMap:
    """A compiled character map: a double-array trie of keys, and the text each is replaced by."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.inert: set[str] = set()  # characters that no key begins with
        self.active: set[str] = set()
        self._pattern: tuple[frozenset, re.Pattern] | None = None

    def _walk(self, data: bytes, at: int) -> tuple[int, int | None, int]:
        """(length, value) of the longest key from ``at`` on, and how many bytes some key goes on with."""
        units, best, value = self.units, 0, None
        node, unit = 0, self.units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        i = at
        while i < len(data):
            byte = data[i]
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            i += 1
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best, value = i - at, units[node] & 0x7FFFFFFF
        return best, value, i - at

    def replacement(self, value: int) -> bytes:
        return self.texts[value : self.texts.index(b"\0", value)]

    def pattern(self, text: str) -> re.Pattern | None:
        """A pattern of the text's characters that a key begins with; None if there are none."""
        if not self.units:
            return None
        for c in set(text) - self.inert - self.active:
            raw = c.encode()
            (self.active if self._walk(raw, 0)[2] == len(raw) else self.inert).add(c)
        some = frozenset(self.active.intersection(text))
        if not some:
            return None
        if self._pattern is None or self._pattern[0] != some:
            self._pattern = some, re.compile("[" + "".join(map(re.escape, sorted(some))) + "]")
        return self._pattern[1]


@dataclass
class Alignment:
    """Where the bytes of a normalised text come from.

    Stretch ``i`` starts at byte ``out[i]`` of the normalised text, and at ``src[i]`` of the original; inside it the
    original goes on by ``step[i]`` (0 or 1) a byte. ``end`` is what follows the last byte.
    """

    out: np.ndarray
    src: np.ndarray
    step: np.ndarray
    size: int
    end: int

    def project(self, at: np.ndarray) -> np.ndarray:
        """Places of the original for places of the normalised text."""
        i = np.searchsorted(self.out, at, side="right") - 1
        return np.where(at >= self.size, self.end, self.src[i] + (at - self.out[i]) * self.step[i]) if len(self.out) else np.full(len(at), self.end)


_NOTHING = Alignment(*(np.zeros(0, np.int64),) * 3, 0, 0)


class Model:
    """A SentencePiece model of the BPE kind."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.add_prefix, self.trim, self.escape, self.suffix, self.fallback = True, True, True, False, False
        kind, unk_surface, chars = 1, UNK_SURFACE, b""
        for f, v in _fields(data):
            if f == 1:
                own = dict(_fields(v))
                self.pieces.append(own.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif f == 2:
                own = dict(_fields(v))
                kind, self.suffix, self.fallback = own.get(3, 1), bool(own.get(24, 0)), bool(own.get(35, 0))
                unk_surface = own[44].decode("utf-8") if 44 in own else UNK_SURFACE
            elif f == 3:
                own = dict(_fields(v))
                chars = own.get(2, b"")
                self.add_prefix, self.trim, self.escape = (bool(own.get(n, 1)) for n in (3, 4, 5))
        if kind != 2:
            raise ValueError("the model is not of the BPE kind")
        self.map = CharacterMap(chars)
        self.unk_surface = unk_surface
        self.unk = self.types.index(UNKNOWN)
        self.number = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER_DEFINED, UNUSED)}
        named = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (CONTROL, UNKNOWN)}
        self.bos, self.eos = named.get("<s>", -1), named.get("</s>", -1)
        self.byte = {b: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE for b in [int(p[3:5], 16)]}
        self.byte_of = {i: b for b, i in self.byte.items()}
        fixed = sorted((p for p, t in zip(self.pieces, self.types) if t == USER_DEFINED), key=lambda p: (-len(p), p))
        self.fixed = re.compile("|".join(map(re.escape, fixed))) if fixed else None
        joined = re.compile(f"[^{MARK}]{MARK}")
        apart = not any(joined.search(p) for p, t in zip(self.pieces, self.types) if t in (NORMAL, UNUSED))
        # no merge goes from the end of a word into the next mark: a word and the marks before it are a segment
        self.segment = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if apart else None
        self.pairs = {p[i : i + 2] for p in self.number for i in range(len(p) - 1)}
        self.table: dict[object, int] = {}  # segment to its row in `place` (start in `flat`, number of codes)
        self.flat, self.place, self.used = np.zeros(0, np.int64), np.zeros((2, 0), np.int64), 0
        self._pairs = None
        self._decoding()

    # --- normalisation

    def normalise(self, text: str) -> tuple[str, Alignment]:
        """(normalised text, where its bytes come from)."""
        if not text:
            return "", _NOTHING
        if not self.trim and self.fixed is None and self.map.pattern(text) is None and self.escape and not self.suffix:
            return self._marked(text)
        return self._stretches(text)

    def _marked(self, text: str) -> tuple[str, Alignment]:
        """Blanks become marks one by one, everything else stays."""
        raw = np.frombuffer(text.encode(), np.uint8)
        blanks = np.flatnonzero(raw == 0x20)
        front = 3 if self.add_prefix else 0
        after = front + blanks + 2 * np.arange(len(blanks))  # where the mark of each blank starts
        out = np.empty(2 * len(blanks) + 2, np.int64)
        src, step = np.empty_like(out), np.empty_like(out)
        out[0], src[0], step[0] = 0, 0, 0
        out[1], src[1], step[1] = front, 0, 1
        out[2::2], src[2::2], step[2::2] = after, blanks, 0
        out[3::2], src[3::2], step[3::2] = after + 3, blanks + 1, 1
        return (MARK if self.add_prefix else "") + text.replace(" ", MARK), Alignment(out, src, step, front + len(raw) + 2 * len(blanks), len(raw))

    def _tokens(self, text: str) -> Iterator[tuple[str, str | None]]:
        """(source, replacement) of successive stretches; the replacement is None where nothing is replaced."""
        pattern = self.map.pattern(text)
        spans = [(m.start(), m.end()) for m in self.fixed.finditer(text)] if self.fixed else []
        at = 0
        for a, b in [*spans, (len(text), len(text))]:
            # a key of the map may reach into what is fixed: fixed strings count only where a step begins
            if a < at:
                m = self.fixed.search(text, at) if self.fixed else None
                a, b = (m.start(), m.end()) if m else (len(text), len(text))
            while at < a:
                m = pattern.search(text, at, a) if pattern else None
                stop = m.start() if m else a
                if stop > at:
                    yield text[at:stop], None
                    at = stop
                if m:
                    raw = text[at : at + 64].encode()
                    size, value, _ = self.map._walk(raw, 0)
                    if size:
                        source = raw[:size].decode()
                        yield source, self.map.replacement(value).decode()
                        at += len(source)
                    else:
                        yield text[at], None
                        at += 1
            if b > a and at == a:
                yield text[a:b], text[a:b]
                at = b

    def _stretches(self, text: str) -> tuple[str, Alignment]:
        mark = MARK if self.escape else " "
        width = len(mark.encode())
        parts: list[str] = []
        out, src, step = [], [], []
        size = used = 0

        def put(piece: str, at: int, by: int):
            nonlocal size
            parts.append(piece)
            out.append(size)
            src.append(at)
            step.append(by)
            size += len(piece.encode())

        started, after_space = not self.trim, False
        if started and self.add_prefix and not self.suffix:
            put(mark, 0, 0)
        for source, target in self._tokens(text):
            same, n = target is None, len(source.encode())
            target = source if same else target
            if not started:
                # a stretch of blanks at the front goes; a key's replacement goes only if it is one blank
                ahead = len(target) - len(target.lstrip(" ")) if same else (len(target) if target == " " else 0)
                if ahead == len(target) and (same or target == " "):
                    used += n
                    continue
                started = True
                used += ahead
                if self.add_prefix and not self.suffix:
                    put(mark, used, 0)
                after_space = True
                target = target[ahead:]
                n -= ahead
            if same:
                for m in re.finditer(" +|[^ ]+", target):
                    piece = m.group()
                    k = len(piece.encode())
                    if piece[0] != " ":
                        put(piece, used, 1)
                        after_space = False
                    else:
                        for j in range(k):
                            if not (after_space and self.trim):
                                put(mark, used + j, 0)
                            after_space = True
                    used += k
            else:
                kept = target.lstrip(" ") if after_space and self.trim else target
                for piece in re.findall(" |[^ ]+", kept):
                    put(mark if piece == " " else piece, used, 0)
                if kept:
                    after_space = kept.endswith(" ")
                used += n
        normal = "".join(parts)
        if not started:
            return "", Alignment(*(np.zeros(0, np.int64),) * 3, 0, used)
        a = Alignment(np.array(out, np.int64), np.array(src, np.int64), np.array(step, np.int64), size, used)
        if self.trim and normal.endswith(mark):
            short = normal.rstrip(mark)
            kept = size - width * (len(normal) - len(short))
            a.end = int(a.project(np.array([kept]))[0])
            a.size = kept
            normal = short
        if self.suffix and self.add_prefix:
            keep = a.out < a.size
            a = Alignment(np.append(a.out[keep], a.size), np.append(a.src[keep], a.end), np.append(a.step[keep], 0), a.size + width, a.end)
            normal += mark
        return normal, a

    # --- merging

    def _merge(self, symbols: list[str], frozen: set[int] | None = None) -> list[int]:
        """Codes of the pieces that symbols merge into: id shifted by 32, plus the bytes of normalised text."""
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap, made = [], {}

        def offer(a, b):
            if a < 0 or b >= n or (frozen and (a in frozen or b in frozen)):
                return
            piece = symbols[a] + symbols[b]
            i = self.number.get(piece)
            if i is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, len(piece)))
                if self.types[i] == UNUSED:
                    made[piece] = symbols[a], symbols[b]

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            # either side may have been merged since
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a] += symbols[b]
            symbols[b] = ""
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        codes: list[int] = []
        for s in symbols:
            if s:
                self._put(s, made, codes)
        return codes

    def _put(self, piece: str, made: dict, codes: list[int]):
        i = self.number.get(piece)
        if i is not None and self.types[i] == UNUSED and piece in made:
            for half in made[piece]:
                self._put(half, made, codes)
            return
        raw = piece.encode()
        if i is not None:
            codes.append(i << 32 | len(raw))
        elif self.fallback:
            codes += [self.byte[b] << 32 | 1 for b in raw]
        else:
            codes.append(self.unk << 32 | len(raw))

    def _pair_table(self):
        """Pairs of symbols that merge: (character numbers, sorted keys, merged symbols, ranks).

        Symbols are pieces by id and, above, characters of pieces that are none themselves. A better score is a lower rank.
        """
        if self._pairs is None:
            symbol = dict(self.number)
            for p in self.number:
                for c in p:
                    symbol.setdefault(c, len(self.pieces) + len(symbol))
            order = {s: r for r, s in enumerate(sorted({-self.scores[i] for i in self.number.values()}))}
            rows = [
                (symbol[p[:k]] << 32 | symbol[p[k:]], i, order[-self.scores[i]])
                for p, i in self.number.items()
                for k in range(1, len(p))
                if p[:k] in symbol and p[k:] in symbol
            ]
            rows = np.array(sorted(rows) or [(-1, 0, 0)], np.int64)
            size = 1 << max(4, int(4 * len(rows) - 1).bit_length())
            at, place, left, steps = self._slot(rows[:, 0], size), np.full(size, -1, np.int64), np.arange(len(rows)), 0
            while len(left):  # open addressing: rows that find their slot taken try the next
                free = left[place[at[left]] < 0]
                place[at[free]] = free
                left = left[place[at[left]] != left]
                at[left] = (at[left] + 1) & (size - 1)
                steps += 1
            keys = np.where(place >= 0, rows[place, 0], -1)
            self._pairs = {c: i for c, i in symbol.items() if len(c) == 1}, keys, rows[place, 1], rows[place, 2], steps
        return self._pairs

    @staticmethod
    def _slot(key: np.ndarray, size: int) -> np.ndarray:
        return (mix(key.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(merged symbol, rank) of pairs of symbols; the rank of pairs that do not merge is ``_NEVER``."""
        _, keys, merged, ranks, steps = self._pair_table()
        key = left << 32 | right
        at = self._slot(key, len(keys))
        out, rank = np.zeros(len(key), np.int64), np.full(len(key), _NEVER)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(steps):
            here = at[todo]
            found = keys[here] == key[todo]
            out[todo[found]], rank[todo[found]] = merged[here[found]], ranks[here[found]]
            todo = todo[~found & (keys[here] >= 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(keys) - 1)
        return out, rank

    def _merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, how many each word has) of many short words: in every round each joins its best pair, the leftmost of equals."""
        number = self._pair_table()[0]
        point = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        each, where = np.unique(point, return_inverse=True)
        sym = np.array([number.get(chr(c), -1) for c in each], np.int64)[where]
        size = np.array([len(chr(c).encode()) for c in each], np.int64)[where]
        char = np.arange(len(point))  # the first character of a symbol
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple] = []
        joint = np.append(word[1:] == word[:-1], False)
        merged, rank = self._look_up(sym, np.append(sym[1:], -1))
        rank[~joint] = _NEVER
        while len(sym):
            head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), head)
            live = least >> 32 != _NEVER
            if not live.all():
                rest = ~np.repeat(live, np.diff(head, append=len(sym)))
                done.append((char[rest], sym[rest], size[rest], word[rest]))
                keep = ~rest
                before = np.cumsum(keep) - 1
                best = before[least[live] & 0xFFFFFFFF]
                sym, size, char, word, merged, rank = (a[keep] for a in (sym, size, char, word, merged, rank))
            else:
                best = least & 0xFFFFFFFF
            if not len(best):
                break
            sym[best] = merged[best]
            size[best] += size[best + 1]
            keep = np.ones(len(sym), bool)
            keep[best + 1] = False
            best = best - np.arange(len(best))  # one symbol goes in every word before
            sym, size, char, word, merged, rank = (a[keep] for a in (sym, size, char, word, merged, rank))
            changed = np.concatenate((best, best[best > 0] - 1))
            follower = np.minimum(changed + 1, len(sym) - 1)
            new, of = self._look_up(sym[changed], sym[follower])
            of[(changed + 1 >= len(sym)) | (word[changed] != word[follower])] = _NEVER
            merged[changed], rank[changed] = new, of
        char, sym, size, word = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(char)
        char, sym, size, word = char[order], sym[order], size[order], word[order]
        code = sym << 32 | size
        odd = (sym < 0) | (sym >= len(self.pieces))  # characters that are no piece
        code[odd & (not self.fallback)] = self.unk << 32 | size[odd & (not self.fallback)]
        if self.fallback and odd.any():
            byte = np.array([self.byte[b] << 32 | 1 for b in range(256)], np.int64)
            many = np.where(odd, size, 1)
            at = np.cumsum(many) - many
            spread = np.repeat(code, many)
            raw = np.frombuffer("".join(chr(c) for c in point[char[odd]]).encode(), np.uint8)
            inside = np.repeat(at[odd], size[odd]) + np.arange(len(raw)) - np.repeat(np.cumsum(size[odd]) - size[odd], size[odd])
            spread[inside] = byte[raw]
            code, word = spread, np.repeat(word, many)
        return code, np.bincount(word, minlength=len(words))

    def _learn(self, segments: set):
        """Put the codes of segments into the table: short ones all at once, others one by one."""
        if len(self.table) > TABLE_WORDS or self.used > TABLE_CODES:
            self.table.clear()
            self.used = 0
            self.flat = self.flat[:TABLE_CODES]
        new = [s for s in segments if s not in self.table]
        at_once = [s for s in new if isinstance(s, str) and len(s) <= AT_ONCE_CHARS] if UNUSED not in self.types else []
        for a in range(0, len(at_once), AT_ONCE_WORDS):
            part = at_once[a : a + AT_ONCE_WORDS]
            self._keep(part, *self._merge_all(part))
        for s in new:
            if s not in self.table:
                code = self._segment_codes(s) if isinstance(s, str) else [self.number[s[0]] << 32 | len(s[0].encode())]
                self._keep([s], np.array(code, np.int64), np.array([len(code)]))

    def _keep(self, segments: list, codes: np.ndarray, sizes: np.ndarray):
        need, rows = self.used + len(codes), len(self.table) + len(segments)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(need, 1 << 16), np.int64)])
        if rows > self.place.shape[1]:
            self.place = np.concatenate([self.place, np.zeros((2, max(rows, 1 << 12)), np.int64)], axis=1)
        self.flat[self.used : need] = codes
        own = slice(len(self.table), rows)
        self.place[0, own], self.place[1, own] = self.used + np.cumsum(sizes) - sizes, sizes
        self.table.update(zip(segments, range(len(self.table), rows)))
        self.used = need

    def _segment_codes(self, segment: str) -> list[int]:
        # a long segment falls apart where no piece has the two characters side by side
        codes: list[int] = []
        pairs, at = self.pairs, 0
        for i in range(1, len(segment) + 1):
            if i == len(segment) or segment[i - 1 : i + 1] not in pairs:
                part = segment[at:i]
                whole = self.number.get(part) if i - at == 1 else None
                if whole is not None and self.types[whole] != UNUSED:
                    codes.append(whole << 32 | len(part.encode()))
                else:
                    codes += self._merge(list(part))
                at = i
        return codes

    def _parts(self, normal: str) -> list:
        """Segments in order; a fixed piece is a tuple of its own."""
        cut = self.segment.findall if self.segment else lambda t: [t] if t else []
        if not self.fixed:
            return cut(normal)
        out, at = [], 0
        for m in self.fixed.finditer(normal):
            out += cut(normal[at : m.start()])
            out.append((m.group(),))
            at = m.end()
        return out + cut(normal[at:])

    def encode_all(self, texts: list[str], bos: bool = True, eos: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begins, ends) of every text: spans are bytes of the text in UTF-8, end exclusive.

        A character that falls apart into bytes belongs to the last of them; begin and end ids have empty spans.
        """
        found = [self.normalise(t) for t in texts]
        parts = [self._parts(n) for n, _ in found]
        self._learn(set().union(*parts))
        row = np.fromiter(map(self.table.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        begin_at, many = self.place[0, row], self.place[1, row]
        last = np.cumsum(many)
        code = self.flat[np.repeat(begin_at - (last - many), many) + np.arange(last[-1] if len(last) else 0)]
        # where each text's pieces end
        cut = np.concatenate(([0], last))[np.cumsum([len(p) for p in parts])].tolist()
        ids, size = code >> 32, code & 0xFFFFFFFF
        stop = np.cumsum(size)
        start = stop - size
        if self.fallback and len(ids):
            start, stop = self._whole_characters(ids, start, stop)
        front, back = [self.bos] if bos else [], [self.eos] if eos else []
        out, a = [], 0
        for text, (_, alignment), z in zip(texts, found, cut):
            own, b, e = ids[a:z], start[a:z], stop[a:z]
            if len(own):
                base = b[0]
                if not self.fallback:
                    # unknown pieces in a row are one
                    unk = own == self.unk
                    head = np.flatnonzero(~np.concatenate(([False], unk[1:] & unk[:-1])))
                    own, b, e = own[head], b[head], e[np.append(head[1:], len(own)) - 1]
                b, e = alignment.project(b - base), alignment.project(e - base)
            zeros, full = np.zeros(len(front), np.int64), np.full(len(back), len(text.encode()), np.int64)
            out.append((np.concatenate([front, own, back]).astype(np.int64), np.concatenate([zeros, b, full]), np.concatenate([zeros, e, full])))
            a = z
        return out

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_all([text], bos, eos)[0]

    def _whole_characters(self, ids, start, stop):
        """Spans in which the bytes of a character but the last are empty and the last has all of it."""
        if not hasattr(self, "_byte_values"):
            values = np.full(len(self.pieces), -1, np.int64)
            for i, b in self.byte_of.items():
                values[i] = b
            self._byte_values = values
        b = self._byte_values[ids]
        if (b < 0).all():
            return start, stop
        inner = (b >= 0) & (b & 0xC0 == 0x80)  # not the first byte of its character
        first = np.maximum.accumulate(np.where(inner, 0, np.arange(len(ids))))
        begin = start[first]
        ends_here = np.append(~inner[1:], True)
        return np.where(b >= 0, begin, start), np.where(b >= 0, np.where(ends_here, stop, begin), stop)

    # --- decoding

    def _decoding(self):
        text = []
        for i, (p, t) in enumerate(zip(self.pieces, self.types)):
            if t == CONTROL:
                text.append(b"")
            elif t == UNKNOWN:
                text.append(self.unk_surface.encode())
            elif t == BYTE:
                text.append(bytes([self.byte_of[i]]))
            else:
                text.append(p.replace(MARK, " ").encode())
        self.surface = text
        self.silent = {i for i, t in enumerate(text) if not t}
        self.starts_marked = [t not in (CONTROL, UNKNOWN, BYTE) and p.startswith(MARK) for p, t in zip(self.pieces, self.types)]

    def decode(self, ids: list[int]) -> str:
        """The text of pieces. Bytes that make no UTF-8 are replaced one by one; control pieces are not seen.

        The mark that encoding puts in front is taken off again, as long as no text stands before it.
        """
        cut = self.add_prefix or self.trim
        at, stop = 0, len(ids)
        while stop and ids[stop - 1] in self.silent:
            stop -= 1
        ids = ids[:stop]
        out: list[bytes] = []
        while cut and at < len(ids):  # the front: until there is text or a mark was taken off
            i = ids[at]
            if self.types[i] == BYTE:
                break
            own = self.surface[i]
            if self.starts_marked[i]:
                out.append(own[1:])
                at += 1
                if self.trim and not out[-1]:
                    continue  # further marks go too
                break
            at += 1
            out.append(own)
            if own:
                break
        return self._utf8([*out], ids[at:])

    def _utf8(self, front: list[bytes], ids: list[int]) -> str:
        surface = self.surface
        if self.silent.isdisjoint(ids):
            try:
                return b"".join([*front, *map(surface.__getitem__, ids)]).decode("utf-8")
            except UnicodeDecodeError:
                pass
        # runs of byte pieces are read by themselves, as some are not UTF-8 or end at a piece without text
        out, run = front, bytearray()
        for i in [*ids, None]:
            if i is not None and self.types[i] == BYTE:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_replaced(bytes(run)))
                run = bytearray()
            if i is not None:
                out.append(surface[i])
        return b"".join(out).decode("utf-8")


def _replaced(run: bytes) -> bytes:
    """A run of bytes with every byte that belongs to no character replaced."""
    out, i = [], 0
    while i < len(run):
        for size in (1, 2, 3, 4):
            try:
                run[i : i + size].decode("utf-8")
            except UnicodeDecodeError:
                continue
            if i + size <= len(run):
                out.append(run[i : i + size])
                i += size
                break
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


# --- tables ---------------------------------------------------------------------------

_models: dict[str, Model] = {}


def _model(file) -> Model:
    """The broadcast model, read once in a worker."""
    data = file.value
    key = hashlib.sha256(data).hexdigest()
    if key not in _models:
        _models[key] = Model(data)
    return _models[key]


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32), kind))


def _encoded(file):
    """Adds ids, begins, ends after the columns of batches whose last column is the text, which goes."""

    def run(batches):
        model = _model(file)
        for b in batches:
            _, offsets = utf8(b.column(-1))
            for a, z in chunks(offsets, CHUNK_CHARS):
                found = model.encode_all([t or "" for t in b.column(-1).slice(a, z - a).to_pylist()])
                own = [c.slice(a, z - a) for c in b.columns[:-1]]
                lists = [_lists([f[i] for f in found], pa.int32()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *lists], [*b.schema.names[:-1], "ids", "begins", "ends"])

    return run


def _decoded(file):
    """Adds the decoded text after the columns of batches that have ``ids``."""

    def run(batches):
        model = _model(file)
        for b in batches:
            ids = b.column(b.schema.names.index("ids"))
            texts = [model.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return run


def _digests(batches):
    """(id, n_tokens, ids_sha256, decoded_sha256, n_covered) of encoded and decoded batches."""
    for b in batches:
        at = b.schema.names.index
        rows = []
        for ids, begins, ends, text in zip(b.column(at("ids")), b.column(at("begins")), b.column(at("ends")), b.column(at("decoded")).to_pylist()):
            own = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            covered = int((ends.values.to_numpy(zero_copy_only=False).astype(np.int64) - begins.values.to_numpy(zero_copy_only=False)).sum())
            rows.append((len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), covered))
        n, a, d, c = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(c, pa.int64())],
            ["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered"],
        )


def _broadcast(docs: DataFrame, model: str):
    spark = docs.sparkSession
    ship_package(spark)
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def encode(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, begins, ends) of every row: its pieces with begin and end ids, and their byte spans in the text.

    ``model`` is the path of a SentencePiece model file of the BPE kind. Nothing is shuffled; a task holds one row, or
    rows of ``CHUNK_CHARS`` bytes, at a time, and a table of words of bounded size. A null text is empty (the begin and
    end ids alone). Null or repeated ids and repeated rows: rows of their own. An empty table gives an empty result.
    Further columns are ignored.
    """
    rows = _rows(docs, id, text)
    kind = rows.schema["id"].dataType.simpleString()
    file = _broadcast(docs, model)
    out = rows.mapInArrow(_encoded(file), f"id {kind}, ids array<int>, begins array<int>, ends array<int>")
    return out.withColumnRenamed("id", id)


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column decoded: the text of its ids; null where the ids are null. A column of that name is replaced."""
    rest = [c for c in encoded.columns if c not in (ids, "decoded")]
    rows = encoded.select(*rest, F.col(ids).cast("array<int>").alias("ids"))
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(_decoded(_broadcast(encoded, model)), schema).withColumnRenamed("ids", ids)


def round_trip(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, n_covered): digests of ``encode`` and of ``decode`` after it, in one pass.

    Digests: ids as little-endian unsigned 32-bit numbers; the decoded text in UTF-8. ``n_covered``: bytes of the text
    that pieces stand for. The pieces themselves do not leave the tasks. Rows as in ``encode``.
    """
    rows = _rows(docs, id, text)
    kind = rows.schema["id"].dataType.simpleString()
    file = _broadcast(docs, model)
    to_pieces, to_text = _encoded(file), _decoded(file)

    def run(batches):
        yield from _digests(to_text(to_pieces(batches)))

    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_covered bigint").withColumnRenamed("id", id)
