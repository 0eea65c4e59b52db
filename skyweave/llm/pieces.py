"""Ids of byte-level BPE for many texts at once: each distinct piece of text is encoded once and remembered.

Texts are cut where such a tokenizer can't join: its pattern always ends a match there. The cuts, the pieces' bytes as
words of eight and the look-ups by their hash are array operations over a buffer of texts; only new pieces go to the
tokenizer. What a look-up found is compared word by word, so a hash that two pieces share changes no ids.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Places for pieces that are remembered; when five in eight are taken, the memory is emptied. Longer ones than so many bytes are encoded each time.
REMEMBERED = 1 << 21
LONGEST = 64
#: New pieces that are encoded as the lines of one text, and pieces that are looked up at a time.
LINES = 1024
_AT_ONCE = 1 << 15

# Kinds of bytes. Bytes of other than ASCII characters may be letters, marks or space: no cut is made beside them,
# unless they are of a block that has letters only.
_MARK, _SPACE, _BLANK, _LETTER, _DIGIT, _QUOTE, _OTHER, _LEAD = range(8)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[:128] = _MARK
_KIND[9:14], _KIND[32], _KIND[39] = _BLANK, _SPACE, _QUOTE
_KIND[48:58], _KIND[65:91], _KIND[97:123] = _DIGIT, _LETTER, _LETTER
#: First bytes of U+00C0 to U+027F and U+0400 to U+047F: letters, but for the two signs of times and division.
_KIND[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = _LEAD
_SIGNS = (0x97, 0xB7)
#: Between which kinds a piece ends: a run of letters or digits ends before anything else, and one of marks before a
#: letter or digit; an apostrophe may belong to the letters behind it.
_ENDS = np.zeros((8, 8), bool)
_ENDS[_LETTER, [_MARK, _DIGIT, _QUOTE]] = _ENDS[_DIGIT, [_MARK, _LETTER, _QUOTE]] = _ENDS[_MARK, [_LETTER, _DIGIT]] = _ENDS[_QUOTE, _DIGIT] = True
_ENDS[[_MARK, _LETTER, _DIGIT, _QUOTE, _OTHER], _SPACE] = _ENDS[[_MARK, _LETTER, _DIGIT, _QUOTE, _OTHER], _BLANK] = True
_ENDS[_BLANK, [_MARK, _LETTER, _DIGIT, _QUOTE, _OTHER]] = True
_ENDS = _ENDS.astype(np.uint8).tobytes().ljust(256, b"\0")
#: White space beyond ASCII, as three bytes (two, and zero).
_WIDE = np.array(sorted(int.from_bytes(chr(c).encode().ljust(3, b"\0"), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)), np.int64)

#: The bytes of a word of eight that belong to a piece, by how many are left of it.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def can_be_cut(description: dict) -> bool:
    """Whether a tokenizer's description is that of plain byte-level BPE with the usual pattern."""
    model, before = description.get("model") or {}, description.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
    return plain and description.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)


def _kinds(b: np.ndarray) -> np.ndarray:
    kind = np.frombuffer(bytearray(b.tobytes().translate(_KIND.tobytes())), np.uint8)
    lead = np.flatnonzero(kind == _LEAD)
    kind[lead] = _OTHER
    lead = lead[lead + 1 < len(b)]
    lead = lead[~((b[lead] == 0xC3) & np.isin(b[lead + 1], _SIGNS))]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def cuts(b: np.ndarray, edges: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of texts that lie side by side in a buffer; ``whole`` texts are one piece each.

    A run of white space ends before its last character, if text follows, and a last space belongs to that text.
    """
    kind = _kinds(b)
    cut = np.empty(len(b), bool)
    cut[1:] = np.frombuffer(((kind[:-1] << 3) | kind[1:]).tobytes().translate(_ENDS), np.bool_)
    blank = (kind == _SPACE) | (kind == _BLANK)
    last = blank[1:-1] & blank[:-2] & ~blank[2:]
    cut[1:-1] |= last
    ends = edges[1:-1]
    ends = ends[(ends > 1) & (ends < len(b))]
    cut[ends - 1] &= ~(blank[ends - 1] & blank[ends - 2])  # the run ends with its text
    for i in whole.tolist():
        cut[edges[i] : edges[i + 1]] = False
    cut[edges[:-1][edges[:-1] < len(b)]] = True
    return np.flatnonzero(cut)


def _odd(b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The texts with white space beyond ASCII."""
    at = np.flatnonzero((b == 0xC2) | ((b >= 0xE1) & (b <= 0xE3)))
    if not len(at):
        return at
    third = np.where(b[at] == 0xC2, 0, b[np.minimum(at + 2, len(b) - 1)])
    code = (b[at].astype(np.int64) << 16) | (b[np.minimum(at + 1, len(b) - 1)].astype(np.int64) << 8) | third
    return np.unique(np.searchsorted(edges, at[np.isin(code, _WIDE)], "right") - 1)


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of a pool, one behind the other."""
    end = np.cumsum(size)
    return pool.take(np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0))


def _words(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as a number; zeros lie behind the end."""
    n = -(-len(b) // 8) * 8
    padded = np.zeros(n + 8, np.uint8)
    padded[: len(b)] = b
    out = np.empty(n, np.uint64)
    for k in range(8):
        out[k::8] = padded[k : k + n].view("<u8")
    return out


class _Pool:
    """Arrays that grow at their ends."""

    def __init__(self, *kinds) -> None:
        self.n, self.arrays = 0, [np.zeros(1 << 12, k) for k in kinds]

    def add(self, *new: np.ndarray) -> None:
        end = self.n + len(new[0])
        if end > len(self.arrays[0]):
            self.arrays = [np.concatenate((a[: self.n], np.zeros(max(end, 2 * self.n) - self.n, a.dtype))) for a in self.arrays]
        for a, x in zip(self.arrays, new, strict=True):
            a[self.n : end] = x
        self.n = end


class Pieces:
    """A worker's tokenizer, and the pieces whose ids it remembers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            description = json.load(f)
        self.cut = can_be_cut(description)
        names = [x["content"].encode() for x in description.get("added_tokens") or ()]
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self._empty()

    def _empty(self) -> None:
        self.key, self.place = np.zeros(REMEMBERED, np.uint64), np.zeros(REMEMBERED, np.int32)
        self.shift = np.uint64(64 - (REMEMBERED - 1).bit_length())
        self.ids, self.words, self.parts = _Pool(np.uint32), _Pool(np.uint64), _Pool(np.int64, np.int32, np.int64, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Where pieces are, by their hashes; -1 if nowhere."""
        slot = (h >> self.shift).astype(np.intp)
        key = self.key[slot]
        out = np.where(key == h, self.place[slot], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.key)
            key = self.key[slot[left]]
            out[left] = np.where(key == h[left], self.place[slot[left]], -1)
            left = left[(key != h[left]) & (key != 0)]
        return out

    def _remember(self, h: np.ndarray, first: int) -> None:
        slot = (h >> self.shift).astype(np.intp)
        left = np.arange(len(h))
        while len(left):
            free = left[self.key[slot[left]] == 0]
            self.key[slot[free]] = h[free]  # of several the last one stays
            own = self.key[slot[left]] == h[left]
            self.place[slot[left[own]]] = first + left[own]
            left = left[~own]
            slot[left] = (slot[left] + 1) % len(self.key)

    def _add(self, b: np.ndarray, start: np.ndarray, size: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces, as the lines of texts but for those that must be ``alone``: where their ids are, and how many."""
        pieces = [b[i : i + k].tobytes().decode("utf-8", "replace") for i, k in zip(start.tolist(), size.tolist(), strict=True)]
        n, order, found = np.zeros(len(pieces), np.int64), [], []
        feed = self._encode(["\n"])[0]
        lines = np.flatnonzero(~alone & (size <= LONGEST) & (len(feed) == 1))
        rest = [np.flatnonzero(alone | (size > LONGEST) | (len(feed) != 1))]
        for at in range(0, len(lines), LINES):
            own = lines[at : at + LINES]
            ids = self._encode(["\n".join([pieces[i] for i in own.tolist()])])[0]
            ends = np.flatnonzero(ids == feed[0])
            if len(ends) == len(own) - 1:
                n[own] = np.diff(np.concatenate(([-1], ends, [len(ids)]))) - 1
                order.append(own)
                found.append(ids[ids != feed[0]])
            else:
                rest.append(own)
        rest = np.concatenate(rest)
        got = self._encode([pieces[i] for i in rest.tolist()])
        n[rest] = [len(x) for x in got]
        order, found = np.concatenate([*order, rest]), [*found, *got]
        id_at = np.zeros(len(pieces), np.int64)
        id_at[order] = self.ids.n + np.cumsum(n[order]) - n[order]
        self.ids.add(np.concatenate(found))
        return id_at, n

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts b[edges[i]:edges[i + 1]], and how many each has."""
        n = len(edges) - 1
        if not len(b):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        whole = np.arange(n) if not self.cut else _odd(b, edges)
        if self.cut and self.special is not None and self.special.search(b.data):
            found = np.array([m.start() for m in self.special.finditer(b.data)])
            whole = np.union1d(whole, np.searchsorted(edges, found, "right") - 1)
        start = cuts(b, edges, whole)
        size = np.diff(np.append(start, len(b)))
        last = _KIND[b[start + size - 1]]
        alone = (last == _SPACE) | (last == _BLANK) | np.isin(start, edges[whole])
        step = min(_AT_ONCE, REMEMBERED // 4)
        got = [self._ids_of(b, start[i : i + step], size[i : i + step], alone[i : i + step]) for i in range(0, len(start), step)]
        total = np.concatenate(([0], np.cumsum(np.concatenate([counts for _, counts in got]))))
        return np.concatenate([ids for ids, _ in got]), np.diff(total[np.searchsorted(start, edges)])

    def _ids_of(self, b: np.ndarray, start: np.ndarray, size: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces, and how many each has."""
        if self.parts.n > REMEMBERED * 5 // 8:
            self._empty()
        wrong = size > LONGEST
        own = np.flatnonzero(~wrong)
        words, h = [], size.astype(np.uint64)
        if len(own):
            lo = start[own[0]]
            around, left = None, own
            for j in range(0, LONGEST, 8):  # fewer and fewer pieces have a further word
                left = left[size[left] > j]
                if not len(left):
                    break
                if around is None:
                    around = _words(b[lo : start[own[-1]] + size[own[-1]]]) if len(own) == len(start) else None
                at = start[left] + j
                w = (around.take(at - lo) if around is not None else self._far(b, at)) & _LEFT.take(np.minimum(size[left] - j, 8))
                words.append((left, w))
                h[left] = (h[left] ^ w) * _MIX1
                h[left] ^= h[left] >> np.uint64(29)
        h = (h * _MIX2) | np.uint64(1)
        at = np.zeros(len(start), np.int64)
        at[own] = self._find(h[own])
        new = own[at[own] < 0]
        if len(new):
            key, first = np.unique(h[new], return_index=True)
            first = new[first]
            self._remember(key, self.parts.n)
            n_words = -(-size[first] // 8)
            word_at = self.words.n + np.cumsum(n_words) - n_words
            self.words.add(np.zeros(int(n_words.sum()), np.uint64))
            place = np.full(len(start), -1, np.int64)
            place[first] = word_at
            for j, (left, w) in enumerate(words):
                keep = place[left] >= 0
                self.words.arrays[0][place[left[keep]] + j] = w[keep]
            id_at, n = self._add(b, start[first], size[first], alone[first])
            self.parts.add(id_at, n, word_at, size[first])
            at[new] = self._find(h[new])
        # what was found must have the same bytes
        id_at, n, word_at, n_bytes = (a.take(at) for a in self.parts.arrays)
        wrong |= n_bytes != size
        for j, (left, w) in enumerate(words):
            wrong[left] |= self.words.arrays[0].take(word_at[left] + j, mode="clip") != w
        again, kept = np.flatnonzero(wrong), self.ids.n
        if len(again):
            id_at[again], n[again] = self._add(b, start[again], size[again], alone[again])
        n = n.astype(np.int64)
        ids = _gather(self.ids.arrays[0], id_at, n)
        self.ids.n = kept
        return ids, n

    @staticmethod
    def _far(b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The eight bytes from some bytes on, where long pieces lie between."""
        out = np.zeros(len(at), np.uint64)
        for k in range(8):
            out |= np.where(at + k < len(b), b.take(at + k, mode="clip"), 0).astype(np.uint64) << np.uint64(8 * k)
        return out
