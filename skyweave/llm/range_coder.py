"""An adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block starts from an empty model and lies in lanes, stretches of its ids that are coded side by side and learn from
each other. At each step the ids of the last two positions and of the last one each predict an id, and a table of the
block's counts predicts at order 0. Which of them comes true is coded with frequencies mixed from three adaptive
estimates: of the predictions' trusts, of what came true before, and of both together. An id that neither context
predicted follows by its order-0 frequency, and one too rare for that evenly.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block, about: a segment is cut evenly into as many blocks as come nearest.
BLOCK = 1 << 21
#: Lanes of a block at most, and the fewest ids of a lane.
LANES, LEAST = 8192, 64
MAGIC = b"SWB2"
#: Blocks of larger ids are coded by their ranks among the block's distinct ids.
WIDE = 1 << 18
_ORDER2, _ORDER1, _ORDER0 = range(3)
#: Contexts of a class: the trust in both predictions (0 to 3), whether they agree, and the class before.
_TRUSTS = 32
_CONTEXTS = 3 * _TRUSTS
_BITS2, _BITS1 = 18, 16
#: Parts that an interval is cut into for a class and for an order-0 id, and parts left to rare ids.
_CLASS_BITS, _ID_BITS = 12, 17
_RARE = 1 << 12
_U32, _U64 = np.uint32, np.uint64
_WORD, _LOW, _MASK = _U64(32), _U64(1 << 32), _U64((1 << 32) - 1)
_BLOCK_HEAD = struct.Struct("<IIIIII")


class _Model:
    """What a block has taught so far. Coder and decoder take the same steps."""

    def __init__(self, lanes: int, steps: int, alphabet: int) -> None:
        self.alphabet = alphabet
        self.two, self.one = np.zeros(1 << _BITS2, _U32), np.zeros(1 << _BITS1, _U32)  # id << 2 | trust
        self.a, self.b = np.zeros(lanes, _U32), np.zeros(lanes, _U32)
        self.last = np.full(lanes, _ORDER0 * _TRUSTS)
        self.ids, self.taken = np.zeros((steps, lanes), _U32), np.full((steps, lanes), -1, np.int16)
        self.seen, self.missed = np.zeros((_CONTEXTS, 3)), np.zeros(alphabet)
        self.weighed = self.counted = 0
        self.slot, self.spot = np.zeros(1 << _ID_BITS, _U32), np.zeros(alphabet + 1, _U64)

    def _weigh(self) -> None:
        """Mix the classes' frequencies of every context."""
        seen = self.seen.reshape(3, _TRUSTS, 3)
        both = seen + 0.02
        trusts = seen.sum(axis=0, keepdims=True) + np.array([0.1, 0.1, 0.4])
        last = seen.sum(axis=1, keepdims=True) + 0.2
        n = both.sum(axis=2, keepdims=True)
        sure = n / (n + 20)  # the more a context has seen, the more it counts
        p = sure * both / n + (1 - sure) * (0.8 * trusts / trusts.sum(axis=2, keepdims=True) + 0.2 * last / last.sum(axis=2, keepdims=True))
        f = np.floor(p * ((1 << _CLASS_BITS) - 3)).astype(np.int64) + 1
        f[..., _ORDER0] += (1 << _CLASS_BITS) - f.sum(axis=2)
        start = np.cumsum(f, axis=2) - f
        self.class_spot = ((start << 32) | f).reshape(-1).astype(_U64)
        self.second, self.third = (start[..., c].reshape(-1).astype(_U64) for c in (_ORDER1, _ORDER0))

    def _rank(self) -> None:
        """Order-0 frequencies from the counts; ids that get none share what is left."""
        f = np.floor(self.missed * (((1 << _ID_BITS) - _RARE) / max(1.0, self.missed.sum()))).astype(np.int64)
        seen = np.flatnonzero(f)
        size = f[seen]
        end = np.cumsum(size)
        top = int(size.sum())
        self.slot[:top] = np.repeat(seen, size)
        self.top, self.rare = _U64(top), _U64((top << 32) | ((1 << _ID_BITS) - top))
        self.spot[:] = self.rare
        self.spot[seen] = ((end - size) << 32) | size
        self.spot[-1] = 1 << _ID_BITS  # of an id that a context predicted: all parts

    def learn(self, t: int) -> None:
        """Before step t: take in the steps so far, in ever longer strides."""
        if t < 16 or t % 8 == 0:
            at = self.taken[self.weighed : t].reshape(-1)
            self.seen += np.bincount(at[at >= 0], minlength=3 * _CONTEXTS).reshape(-1, 3)
            self.weighed = t
            self._weigh()
        if t & (t - 1) == 0 or t % 128 == 0:
            at = self.taken[self.counted : t]
            self.missed += np.bincount(self.ids[self.counted : t][(at >= 0) & (at % 3 == _ORDER0)], minlength=self.alphabet)
            self.counted = t
            self._rank()

    def predict(self, k: int) -> None:
        """Of the first k lanes: the predicted ids, and their contexts' numbers."""
        h = self.b[:k] * _U32(0x9E3779B1)
        self.slot1 = (h >> _U32(32 - _BITS1)).astype(np.intp)
        self.slot2 = (((self.a[:k] * _U32(0x85EBCA6B)) ^ h) * _U32(0xC2B2AE35) >> _U32(32 - _BITS2)).astype(np.intp)
        self.entry2, self.entry1 = self.two.take(self.slot2), self.one.take(self.slot1)
        self.id2, self.id1 = self.entry2 >> _U32(2), self.entry1 >> _U32(2)
        self.trust2, self.trust1 = self.entry2 & _U32(3), self.entry1 & _U32(3)
        self.context = self.last[:k] + ((self.trust2 << _U32(3)) + (self.trust1 << _U32(1)) + (self.id1 == self.id2))

    def update(self, t: int, k: int, ids: np.ndarray, what: np.ndarray, taken: np.ndarray) -> None:
        """What comes true is trusted more, what doesn't less; what isn't trusted is replaced."""
        new = ids << _U32(2)
        for table, slot, entry, known, trust in ((self.two, self.slot2, self.entry2, self.id2, self.trust2), (self.one, self.slot1, self.entry1, self.id1, self.trust1)):
            table[slot] = np.where(known == ids, entry + (trust != 3), np.where(trust > 0, entry - _U32(1), new))
        self.a[:k], self.b[:k] = self.b[:k], ids
        np.multiply(what, _TRUSTS, out=self.last[:k])
        self.ids[t, :k], self.taken[t, :k] = ids, taken


def _shape(n: int) -> tuple[int, int, int]:
    """Steps and lanes of a block, and the last lane's ids."""
    steps = -(-n // max(1, min(LANES, n // LEAST)))
    lanes = -(-n // steps)
    return steps, lanes, n - (lanes - 1) * steps


class _Writer:
    """The lanes' intervals, and the words that they have settled."""

    def __init__(self, lanes: int, steps: int) -> None:
        self.low, self.range = np.zeros(lanes, _U64), np.full(lanes, 2**64 - 1, _U64)
        self.room = 2 * steps + 4
        self.out, self.at = np.zeros(lanes * self.room, _U32), np.arange(lanes) * self.room + 1

    def _carry(self, lanes: np.ndarray) -> None:
        spot = self.at[lanes] - 1
        while len(spot):
            self.out[spot] += _U32(1)
            spot = spot[self.out[spot] == 0] - 1

    def narrow(self, lanes: np.ndarray | slice, move: np.ndarray, size: np.ndarray) -> None:
        low = self.low[lanes] + move
        over, short = np.flatnonzero(low < move), np.flatnonzero(size < _LOW)
        if len(over):
            self._carry(over if isinstance(lanes, slice) else lanes[over])
        if len(short):
            own = short if isinstance(lanes, slice) else lanes[short]
            spot, x = self.at[own], low[short]
            self.out[spot] = x >> _WORD
            self.at[own] = spot + 1
            low[short], size[short] = x << _WORD, size[short] << _WORD
        self.low[lanes], self.range[lanes] = low, size

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of each lane, and all words: to the last comes one that lies in the interval with zeros behind it."""
        end = self.low + _MASK
        self._carry(np.flatnonzero(end < self.low))
        self.out[self.at] = end >> _WORD
        n = self.at - np.arange(len(self.at)) * self.room
        row = np.arange(self.room)
        return n, self.out.reshape(-1, self.room)[(row > 0) & (row <= n[:, None])]


class _Reader:
    def __init__(self, n: np.ndarray, words: np.ndarray) -> None:
        lanes, room = len(n), int(n.max()) + 3
        data = np.zeros((lanes, room), _U32)
        data[np.arange(room) < n[:, None]] = words
        self.data, self.at = data.reshape(-1), np.arange(lanes) * room
        self.end = self.at + room - 1
        self.code, self.range = (self.data[self.at].astype(_U64) << _WORD) | self.data[self.at + 1], np.full(lanes, 2**64 - 1, _U64)
        self.at += 2

    def narrow(self, lanes: np.ndarray | slice, code: np.ndarray, size: np.ndarray) -> None:
        short = np.flatnonzero(size < _LOW)
        if len(short):
            own = short if isinstance(lanes, slice) else lanes[short]
            spot = self.at[own]
            code[short], size[short] = (code[short] << _WORD) | self.data[spot], size[short] << _WORD
            self.at[own] = np.minimum(spot + 1, self.end[own])
        self.code[lanes], self.range[lanes] = code, size


def encode_block(ids: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each lane, and all words, of ids below ``alphabet``."""
    steps, lanes, last = _shape(len(ids))
    grid = np.zeros(lanes * steps, _U32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    m, w, evenly = _Model(lanes, steps, alphabet), _Writer(lanes, steps), _U64(alphabet)
    for t in range(steps):
        k = lanes if t < last else lanes - 1
        x = grid[t, :k]
        m.learn(t)
        m.predict(k)
        what = np.where(m.id2 == x, _ORDER2, np.where(m.id1 == x, _ORDER1, _ORDER0))
        taken = m.context * 3 + what
        spot = m.class_spot.take(taken)
        part = w.range[:k] >> _U64(_CLASS_BITS)
        move = part * (spot >> _WORD)
        part = (part * (spot & _MASK)) >> _U64(_ID_BITS)
        spot = m.spot.take(np.where(what == _ORDER0, x, alphabet))
        w.narrow(slice(0, k), move + part * (spot >> _WORD), part * (spot & _MASK))
        rare = np.flatnonzero((spot == m.rare) & (what == _ORDER0))
        if len(rare):
            part = w.range[rare] // evenly
            w.narrow(rare, part * x[rare], part)
        m.update(t, k, x, what, taken)
    return w.finish()


def decode_block(n: int, alphabet: int, lane_words: np.ndarray, words: np.ndarray) -> np.ndarray:
    steps, lanes, last = _shape(n)
    m, r, evenly, one = _Model(lanes, steps, alphabet), _Reader(lane_words, words), _U64(alphabet), _U64(1)
    for t in range(steps):
        k = lanes if t < last else lanes - 1
        m.learn(t)
        m.predict(k)
        code, part = r.code[:k], r.range[:k] >> _U64(_CLASS_BITS)
        v = code // part
        what = (v >= m.second.take(m.context)).astype(np.intp) + (v >= m.third.take(m.context))
        taken = m.context * 3 + what
        spot = m.class_spot.take(taken)
        code = code - part * (spot >> _WORD)
        part = (part * (spot & _MASK)) >> _U64(_ID_BITS)
        v = code // part
        miss = what == _ORDER0
        ids = m.slot.take(v.astype(np.intp), mode="clip")
        spot = m.spot.take(np.where(miss, ids, alphabet))
        rare = np.flatnonzero(miss & (v >= m.top))
        spot[rare] = m.rare
        r.narrow(slice(0, k), code - part * (spot >> _WORD), part * (spot & _MASK))
        ids = np.where(miss, ids, np.where(what == _ORDER2, m.id2, m.id1))
        if len(rare):
            part = r.range[rare] // evenly
            code = r.code[rare]
            ids[rare] = got = np.minimum(code // part, evenly - one)
            r.narrow(rare, code - part * got, part)
        m.update(t, k, ids, what, taken)
    return np.ascontiguousarray(m.ids.T).reshape(-1)[:n]


def _blocks(n: int) -> np.ndarray:
    """Where the blocks of n ids begin, and the end."""
    count = max(1, round(n / BLOCK)) if n else 0
    return np.arange(count + 1) * n // max(1, count)


def _encoded(ids: np.ndarray) -> bytes:
    """A block: sizes, checksums of its bytes and of its ids, the distinct ids if they are wide, lanes and words."""
    alphabet, names = int(ids.max()) + 1, b""
    check = zlib.crc32(ids.astype("<u4").tobytes())
    if alphabet > WIDE:
        known, ids = np.unique(ids, return_inverse=True)
        alphabet, names = len(known), zlib.compress(known.astype("<u4").tobytes())
    lane_words, words = encode_block(ids, alphabet)
    body = names + lane_words.astype("<u2").tobytes() + words.astype("<u4").tobytes()
    return _BLOCK_HEAD.pack(len(ids), alphabet, len(names), len(lane_words), zlib.crc32(body), check) + struct.pack("<I", len(body)) + body


def pack(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: a magic, sizes, the documents' ids and lengths, and the blocks."""
    docs = struct.pack(f"<{len(counts)}?", *(d is None for d in doc_ids)) + struct.pack(f"<{len(counts)}q", *(d or 0 for d in doc_ids)) + counts.astype("<u4").tobytes()
    head = zlib.compress(docs)
    edges = _blocks(len(ids))
    return MAGIC + struct.pack("<IQII", len(counts), len(ids), len(head), zlib.crc32(head)) + head + b"".join(_encoded(ids[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True))


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids of a segment; ValueError if a checksum is wrong."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n, total, size, check = struct.unpack_from("<IQII", data, 4)
    at = 4 + struct.calcsize("<IQII")
    head = data[at : at + size]
    if zlib.crc32(head) != check:
        raise ValueError("the document table's checksum is wrong")
    head, at = zlib.decompress(head), at + size
    none, known = struct.unpack_from(f"<{n}?", head), struct.unpack_from(f"<{n}q", head, n)
    counts = np.frombuffer(head, "<u4", n, 9 * n).astype(np.int64)
    found = [np.zeros(0, _U32)]
    for i in range(len(_blocks(total)) - 1):
        own, alphabet, name_bytes, lanes, coded, plain = _BLOCK_HEAD.unpack_from(data, at)
        (size,) = struct.unpack_from("<I", data, at + _BLOCK_HEAD.size)
        at += _BLOCK_HEAD.size + 4
        body, at = data[at : at + size], at + size
        if zlib.crc32(body) != coded:
            raise ValueError(f"the checksum of block {i} is wrong")
        lane_words = np.frombuffer(body, "<u2", lanes, name_bytes).astype(np.int64)
        ids = decode_block(own, alphabet, lane_words, np.frombuffer(body, "<u4", offset=name_bytes + 2 * lanes))
        if name_bytes:
            ids = np.frombuffer(zlib.decompress(body[:name_bytes]), "<u4")[ids]
        if zlib.crc32(ids.astype("<u4").tobytes()) != plain:
            raise ValueError(f"the checksum of block {i} is wrong")
        found.append(ids)
    return [None if x else d for x, d in zip(none, known, strict=True)], counts, np.concatenate(found)
