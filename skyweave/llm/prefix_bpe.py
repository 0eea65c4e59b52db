"""BPE by dynamic programming over prefixes, and decoding.

Every prefix of a piece has one BPE encoding, and so one last token. It is found among the tokens that end there: an
automaton over the vocabulary gives the longest, and each token knows the next shorter one that is its suffix. A
candidate is the last token if what is before it is encoded with a last token that stays apart from it (``Merges.apart``).
The last tokens are back-pointers: followed from the end they give the ids. All pieces of a batch advance together, one
symbol at a time, as array operations; a few very long ones go one by one.

Texts are cut at ASCII white space into words, and a worker remembers the ids of words (see ``pieces``). Normal forms
and the splitting of words that are not plain ASCII are the library's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, slices
from .pieces import LINES, Pieces, _gather, _Pool
from .token_output import _bytes

#: Pieces that advance together at most (of 16 symbols; fewer longer ones), and at least: fewer go one by one.
TOGETHER = 1 << 13
FEW = 16
#: Places for the words that a worker remembers, and pieces beside them; what is full to three quarters is emptied.
REMEMBERED_WORDS, REMEMBERED_PIECES = 1 << 20, 1 << 17
#: Ids whose strings are joined at a time.
JOINED = 1 << 15
_NEVER = np.int32(2**31 - 1)

# The normal form and the split that the plain path below follows.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: That split of lower-case ASCII words, which lie on a line each.
_PLAIN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+|\n")


def byte_names() -> list[str]:
    """The character that stands for each byte: itself if it can be printed, else one of those from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


_BYTE = {c: i for i, c in enumerate(byte_names())}


class _Lookup:
    """Numbers of non-negative keys, -1 for others: open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.keys, self.values = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            own = self.keys[slot[left]] == keys[left]
            self.values[slot[left[own]]] = values[left[own]]
            left = left[~own]
            slot[left] = (slot[left] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.intp)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys.take(slot)
        out = np.where(found == keys, self.values.take(slot), np.int32(-1))
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            found = self.keys[slot[left]]
            out[left] = np.where(found == keys[left], self.values[slot[left]], -1)
            left = left[(found != keys[left]) & (found != -1)]
        return out


class _Kept:
    """What was computed last of keys that share a place, packed as key and value: a small table in front of a dear one."""

    def __init__(self, bits: int, value_bits: int) -> None:
        self.shift, self.bits, self.mask = np.uint64(64 - bits), value_bits, (1 << value_bits) - 1
        self.table = np.full(1 << bits, -1, np.int64)

    def __call__(self, keys: np.ndarray, compute) -> np.ndarray:
        """Values of non-negative keys; ``compute(places)`` gives those of some places in ``keys``."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.intp)
        held = self.table.take(slot)
        out = held & self.mask
        new = np.flatnonzero((held >> self.bits) != keys)
        if len(new):
            out[new] = compute(new)
            self.table[slot[new]] = (keys[new] << self.bits) | out[new]
        return out


class Merges:
    """The vocabulary of a byte-level BPE model: how each token is merged, and the automaton of its suffixes.

    Symbols are the bytes 0 to 255 and, if a word's end is marked, 256 more for a last byte.
    """

    def __init__(self, model: dict) -> None:
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd:
            raise ValueError(f"not a plain BPE model: {model.get('type')} {odd}")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.n, self.mark = max(vocab.values()) + 1, 256 if end else 0
        names = byte_names()
        self.symbol = np.array([vocab[c] for c in names] + [vocab[c + end] for c in names], np.int32)
        self.rank, self.left, self.right = np.full(self.n, -1, np.int32), np.full(self.n, -1, np.int32), np.full(self.n, -1, np.int32)
        spelled: dict[int, str] = {}
        for s in range(511, -1, -1):
            spelled[int(self.symbol[s])] = chr(s)
        for r, (a, b) in enumerate(pairs):
            whole = vocab[a + b]
            if whole in spelled:
                raise ValueError(f"two merges give {a + b!r}")
            self.left[whole], self.right[whole], self.rank[whole] = vocab[a], vocab[b], r
            spelled[whole] = spelled[vocab[a]] + spelled[vocab[b]]
        self.size = np.zeros(self.n, np.int32)
        self.size[list(spelled)] = [len(x) for x in spelled.values()]
        merged = np.flatnonzero(self.rank >= 0)
        self.pair = _Lookup(self.left[merged].astype(np.int64) * self.n + self.right[merged], self.rank[merged])
        self._automaton({t: spelled[t] for t in self._made(spelled, merged)})
        self.kept_steps, self.kept_pairs = _Kept(19, len(self.back).bit_length()), _Kept(20, 1)

    def _made(self, spelled: dict[int, str], merged: np.ndarray) -> list[int]:
        """The tokens that their own string is encoded as; BPE never gives others."""
        apart = np.ones(self.n, bool)
        apart[merged] = self.apart(self.left[merged], self.right[merged], self.rank[merged])
        for t in merged[np.argsort(self.rank[merged])].tolist():
            apart[t] &= apart[self.left[t]] & apart[self.right[t]]
        return [t for t in spelled if apart[t]]

    def apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the string of tokens a and b is encoded as these two (by the merges before some rank).

        Undo the merges from the last one on. What touches between a's end and b's start is a pair each time, which
        BPE would have merged if its rank comes before those of the next merges on both sides; of one rank the left
        pair goes first.
        """
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        until_a = np.full(len(a), _NEVER) if before is None else before.astype(np.int32)
        until_b = until_a.copy()
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(at):
            r = self.pair(a * self.n + b)
            joined = (r >= 0) & (r < until_a) & (r <= until_b)
            ok[at[joined]] = False
            of_a, of_b = self.rank.take(a), self.rank.take(b)
            on = np.flatnonzero(~joined & ((of_a >= 0) | (of_b >= 0)))
            at, a, b, of_a, of_b = at[on], a[on], b[on], of_a[on], of_b[on]
            later = of_a > of_b
            until_a, until_b = np.where(later, of_a, until_a[on]), np.where(later, until_b[on], of_b)
            a, b = np.where(later, self.right.take(a), a), np.where(later, b, self.left.take(b))
        return ok

    def _automaton(self, spelled: dict[int, str]) -> None:
        """States are the prefixes of tokens: steps, the state to fall back to, the longest token that ends in each."""
        state = {"": 0}
        for word in spelled.values():
            for i in range(len(word), 0, -1):  # a prefix that is known has all of its own
                if word[:i] in state:
                    break
                state[word[:i]] = -1
        order = sorted(state, key=len)
        state = {s: i for i, s in enumerate(order)}
        token = {s: t for t, s in spelled.items()}
        back, longest = np.zeros(len(order), np.int32), np.full(len(order), -1, np.int32)
        self.shorter = np.full(self.n, -1, np.int32)
        for i, s in enumerate(order[1:], 1):
            if len(s) > 1:
                f = int(back[state[s[:-1]]])
                while f and (order[f] + s[-1]) not in state:
                    f = int(back[f])
                back[i] = state.get(order[f] + s[-1], 0)
            own = token.get(s, -1)
            longest[i] = own if own >= 0 else longest[back[i]]
            if own >= 0:
                self.shorter[own] = longest[back[i]]
        self.back, self.longest = back, longest
        self.step = _Lookup(np.array([state[s[:-1]] * 512 + ord(s[-1]) for s in order[1:]], np.int64), np.arange(1, len(order), dtype=np.int32))

    def _next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.kept_steps(state * 512 + symbol, lambda new: self._fall(state[new], symbol[new]))

    def _fall(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states, by falling back until there is a step; from the start every symbol has one."""
        out = self.step(state * 512 + symbol).astype(np.int64)
        left = np.flatnonzero(out < 0)
        state, symbol = state[left], symbol[left]
        while len(left):
            state = self.back.take(state).astype(np.int64)
            out[left] = got = self.step(state * 512 + symbol)
            more = np.flatnonzero(got < 0)
            left, state, symbol = left[more], state[more], symbol[more]
        return out

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``apart``, of pairs that come again and again."""
        return self.kept_pairs(a.astype(np.int64) * self.n + b, lambda new: self.apart(a[new], b[new])) == 1

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some pieces, none of them empty, and how many each has."""
        size = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(size, kind="stable")
        n, found, at = np.zeros(len(pieces), np.int64), [], 0
        while at < len(order):
            widths = size[order[at : at + TOGETHER]]
            fits = widths * np.arange(1, len(widths) + 1) <= TOGETHER * 16
            own = order[at : at + max(1, int(fits.sum()))]
            if len(own) >= FEW:
                ids, n[own] = self._together([pieces[i] for i in own.tolist()], size[own])
                found.append(ids)
            else:
                for i in own.tolist():
                    found.append(self._alone(pieces[i]))
                    n[i] = len(found[-1])
            at += len(own)
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        start = np.zeros(len(pieces), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return _gather(ids, start, n), n

    def _together(self, pieces: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces in ascending size."""
        n, width = len(pieces), int(size[-1])
        symbols = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width).T.astype(np.int64)
        symbols[size - 1, np.arange(n)] += self.mark
        last = np.full((width + 1, n), -1, np.int32)  # the last token of each prefix, by its size
        state = np.zeros(n, np.int64)
        for pos in range(width):
            lo = int(np.searchsorted(size, pos, "right"))  # shorter ones are done
            state = self._next(state[len(state) - (n - lo) :], symbols[pos, lo:])
            todo, token = np.arange(lo, n), self.longest.take(state)
            while len(todo):
                before = last[pos + 1 - self.size.take(token), todo]
                ok = before < 0
                inside = np.flatnonzero(~ok)
                ok[inside] = self.stay(before[inside], token[inside])
                last[pos + 1, todo[ok]] = token[ok]
                wrong = np.flatnonzero(~ok)
                todo, token = todo[wrong], self.shorter.take(token[wrong])
        parts, at, todo = [], size.copy(), np.arange(n)
        counts = np.zeros(n, np.int64)
        while len(todo):
            token = last[at[todo], todo]
            parts.append((todo, token))
            counts[todo] += 1
            at[todo] -= self.size.take(token)
            todo = todo[at[todo] > 0]
        ids, end = np.zeros(int(counts.sum()), np.uint32), np.cumsum(counts)
        for k, (own, token) in enumerate(parts):
            ids[end[own] - 1 - k] = token
        return ids, counts

    def _alone(self, piece: bytes) -> np.ndarray:
        """One piece, symbol by symbol."""
        step, back, longest, size, shorter = self._plain()[:5]
        symbols = [*piece[:-1], piece[-1] + self.mark]
        last, state, known = [-1] * (len(piece) + 1), 0, {}
        for pos, s in enumerate(symbols, 1):
            while (to := step.get(state * 512 + s)) is None:
                state = back[state]
            state = to
            token = longest[state]
            while (before := last[pos - size[token]]) >= 0:
                pair = before * self.n + token
                if pair not in known:
                    known[pair] = self._stays(before, token)
                if known[pair]:
                    break
                token = shorter[token]
            last[pos] = token
        ids, pos = [], len(piece)
        while pos:
            ids.append(last[pos])
            pos -= size[last[pos]]
        return np.array(ids[::-1], np.uint32)

    def _stays(self, a: int, b: int) -> bool:
        """``apart`` of one pair."""
        rank, left, right, pair = self._plain()[5:]
        until_a = until_b = int(_NEVER)
        while True:
            r = pair.get(a * self.n + b, -1)
            if 0 <= r < until_a and r <= until_b:
                return False
            if rank[a] > rank[b]:
                until_a, a = rank[a], right[a]
            elif rank[b] >= 0:
                until_b, b = rank[b], left[b]
            else:
                return True

    def _plain(self) -> tuple:
        if not hasattr(self, "lists"):
            as_dict = [dict(zip(x.keys[x.keys >= 0].tolist(), x.values[x.keys >= 0].tolist(), strict=True)) for x in (self.step, self.pair)]
            arrays = [x.tolist() for x in (self.back, self.longest, self.size, self.shorter, self.rank, self.left, self.right)]
            self.lists = (as_dict[0], *arrays, as_dict[1])
        return self.lists


class Names:
    """The strings of a vocabulary's tokens, which decoding joins; other tokenizers' own decoders are the library's."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            description = json.load(f)
        vocab = description["model"]["vocab"] | {x["content"]: x["id"] for x in description.get("added_tokens") or ()}
        self.t = None
        if description.get("decoder") is not None:
            from tokenizers import Tokenizer

            self.t = Tokenizer.from_file(path)
        names = [b""] * (max(vocab.values()) + 1)
        for k, i in vocab.items():
            names[i] = k.encode() + b" "
        self.size = np.array([*map(len, names), 0], np.int64)
        self.at, self.pool = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(names) + b" ", np.uint8)

    def texts_of(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The texts of some documents' ids side by side, of which each has ``n``; unknown ids are left out."""
        edges = np.concatenate(([0], np.cumsum(n)))
        if self.t is not None:
            return [self.t.decode(ids[i:j].tolist(), skip_special_tokens=False).encode() for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        ids = np.minimum(ids, len(self.size) - 1)  # the last one stands for unknown ids
        size = self.size[ids]
        text = b"".join([_gather(self.pool, self.at[ids[i : i + JOINED]], size[i : i + JOINED]).tobytes() for i in range(0, len(ids), JOINED)])
        at = np.concatenate(([0], np.cumsum(size)))[edges]
        return [text[i : j - 1] if j > i else b"" for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


class Words(Pieces):
    """A worker's vocabulary, and the words whose ids it remembers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            description = json.load(f)
        # the library's normal forms and splitting, without its vocabulary
        self.t = Tokenizer.from_str(json.dumps(description | {"added_tokens": [], "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        names = [x["content"].encode() for x in description.get("added_tokens") or ()]
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self._empty()
        self.merges = Merges(description["model"])
        added = {x["content"]: x for x in description.get("added_tokens") or ()}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added.values()):
            raise ValueError("added tokens must stand for just their own string")
        self.added = {k.encode(): x["id"] for k, x in added.items()}
        before = (description.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        self.plain = (description.get("normalizer") or {}).get("normalizers") == _NORMAL and [x.get("type") for x in before] == ["Split", "ByteLevel"] and before[0].get("pattern") == {"Regex": _SPLIT}
        self.known: dict = {}
        self.piece_ids, self.piece_at = _Pool(np.uint32), _Pool(np.int64, np.int64)

    def _empty(self) -> None:
        super()._empty()
        self.key, self.place = np.zeros(REMEMBERED_WORDS, np.uint64), np.zeros(REMEMBERED_WORDS, np.int32)
        self.shift = np.uint64(64 - (REMEMBERED_WORDS - 1).bit_length())

    def _ids_of(self, b: np.ndarray, start: np.ndarray, size: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.parts.n + len(start) > REMEMBERED_WORDS * 3 // 4:
            self._empty()
        return super()._ids_of(b, start, size, alone)

    def ids_of(self, b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(b):
            return np.zeros(0, np.uint32), np.zeros(len(edges) - 1, np.int64)
        if self.plain:
            blank = (b == 32) | ((b >= 9) & (b <= 13))
            first, behind = ~blank, ~blank
            first[1:] &= blank[:-1]
            inner = edges[1:-1][edges[1:-1] < len(b)]
            first[inner] = ~blank[inner]
            start = np.flatnonzero(first)
            behind[:-1] &= blank[1:]
            inner = inner[inner > 0]
            behind[inner - 1] = ~blank[inner - 1]
            size = np.flatnonzero(behind) + 1 - start
        else:
            start, size = edges[:-1][np.diff(edges) > 0], np.diff(edges)[np.diff(edges) > 0]
        step, alone = min(1 << 15, REMEMBERED_WORDS // 4), np.zeros(len(start), bool)
        got = [self._ids_of(b, start[i : i + step], size[i : i + step], alone[i : i + step]) for i in range(0, len(start), step)]
        if not got:
            return np.zeros(0, np.uint32), np.zeros(len(edges) - 1, np.int64)
        total = np.concatenate(([0], np.cumsum(np.concatenate([counts for _, counts in got]))))
        return np.concatenate([ids for ids, _ in got]), np.diff(total[np.searchsorted(start, edges)])

    def _add(self, b: np.ndarray, start: np.ndarray, size: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [b[i : i + k].tobytes() for i, k in zip(start.tolist(), size.tolist(), strict=True)]
        easy, rest = [], []
        for i, w in enumerate(words):
            (easy if self.plain and w.isascii() else rest).append(i)
        if self.special is not None and self.special.search(b"\n".join([words[i] for i in easy])):
            rest += [i for i in easy if self.special.search(words[i])]
            easy = [i for i in easy if not self.special.search(words[i])]
        parts = _PLAIN.findall(b"\n".join([words[i] for i in easy]).lower()) if easy else []
        line = np.fromiter((p == b"\n" for p in parts), bool, len(parts))
        of = np.array(easy, np.int64)[np.cumsum(line)[~line]] if easy else np.zeros(0, np.int64)
        parts = [p for p in parts if p != b"\n"]
        hard = self._split([words[i] for i in rest])
        of = np.concatenate((of, np.repeat(np.array(rest, np.int64), [len(x) for x in hard])))
        at, n = self._pieces([*parts, *[p for x in hard for p in x]])
        order = np.argsort(of, kind="stable")
        ids = _gather(self.piece_ids.arrays[0], at[order], n[order])
        n = np.bincount(of, n, len(words)).astype(np.int64)
        first = self.ids.n
        self.ids.add(ids)
        return first + np.cumsum(n) - n, n

    def _pieces(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of pieces and of added tokens (as numbers) are among those remembered, and how many."""
        if max(len(self.known), self.piece_ids.n // 8) > REMEMBERED_PIECES:
            self.known, self.piece_ids, self.piece_at = {}, _Pool(np.uint32), _Pool(np.int64, np.int64)
        old = len(self.known)
        place = np.array([self.known.setdefault(p, len(self.known)) for p in parts], np.int64)
        if len(self.known) > old:
            new = list(islice(self.known, old, None))
            ids, n = self.merges.encode([p for p in new if isinstance(p, bytes)])
            if any(isinstance(p, int) for p in new):
                counts, k = np.ones(len(new), np.int64), np.array([isinstance(p, int) for p in new])
                counts[~k] = n
                ids, n = np.insert(ids, (np.cumsum(counts) - counts)[k] - np.arange(k.sum()), [p for p in new if isinstance(p, int)]).astype(np.uint32), counts
            self.piece_at.add(self.piece_ids.n + np.cumsum(n) - n, n)
            self.piece_ids.add(ids)
        at, n = self.piece_at.arrays
        return at[place], n[place]

    def _split(self, words: list[bytes]) -> list[list]:
        """The pieces of any texts, and the numbers of added tokens in them."""
        out: list[list] = []
        single = []
        for i, w in enumerate(words):
            parts, at = [], 0
            for m in self.special.finditer(w) if self.special is not None else ():
                parts += [*self._parts(w[at : m.start()].decode("utf-8", "replace")), self.added[m.group()]]
                at = m.end()
            if not at:
                single.append(i)
            else:
                parts += self._parts(w[at:].decode("utf-8", "replace"))
            out.append(parts)
        for lo in range(0, len(single), LINES):  # many at a time, if each stays between two spaces
            own = single[lo : lo + LINES]
            texts = [words[i].decode("utf-8", "replace") for i in own]
            together = self._normal(" ".join(texts)) if self.plain else ""
            spaces = [m.start() for m in re.finditer(" ", together)]
            if len(spaces) == len(own) - 1 and not any(x.isspace() for t in texts for x in t):
                spans = [x for _, x in self.t.pre_tokenizer.pre_tokenize_str(together)]
                for k, (i, j) in zip(np.searchsorted(spaces, [i for i, _ in spans]).tolist(), spans, strict=True):
                    out[own[k]].append(together[i:j].encode())
            else:
                for i, t in zip(own, texts, strict=True):
                    out[i] = self._parts(t)
        return out

    def _normal(self, text: str) -> str:
        return self.t.normalizer.normalize_str(text) if self.t.normalizer is not None else text

    def _parts(self, text: str) -> list[bytes]:
        text = self._normal(text) if text else text
        if not text:
            return []
        if self.t.pre_tokenizer is None:
            return [text.encode()]
        return [bytes([_BYTE[c] for c in p]) for p, _ in self.t.pre_tokenizer.pre_tokenize_str(text) if p]


_WORKER: dict = {}


def _held(kind, path: str):
    """A worker's ``Words`` or ``Names``."""
    if (kind, path) not in _WORKER:
        _WORKER[kind, path] = kind(path)
    return _WORKER[kind, path]


def _appended(df: DataFrame, source: str, out: list[T.StructField], fn, keep: list[str] | None) -> DataFrame:
    """The rows (or their columns ``keep``) with columns ``out``, which ``fn(column)`` computes; columns of their names go."""
    named = {f.name.lower() for f in out}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in named]
    schema = T.StructType([df.schema[c] for c in kept] + out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in slices(batches, len(kept)):
            cols = [b.column(i) for i in range(len(kept))] + fn(b.column(len(kept)))
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(cols)], schema=arrow)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias(free_name(df, "__source"))).mapInArrow(run, schema)


def _ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """All ids of some texts, how many each has, and both as columns."""
    found, n = _held(Words, path).ids_of(*_bytes(texts))
    raw, edges = found.astype("<u4").tobytes(), 4 * np.concatenate(([0], np.cumsum(n)))
    return found, n, [pa.array(n, pa.int64()), pa.array([raw[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())]


def _texts(ids: np.ndarray, n: np.ndarray, path: str) -> pa.Array:
    return pa.array(_held(Names, path).texts_of(ids, n), pa.binary()).cast(pa.string())


_ENCODED = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
_DECODED = [T.StructField("decoded", T.StringType())]


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows with ``n_tokens`` and ``ids``: a text's ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Strings of added tokens give their ids. Texts of any length are encoded whole;
    equal rows get equal ids, no rows give none, and columns named like the new ones are replaced.
    """
    return _appended(docs, text_col, _ENCODED, lambda texts: _ids(texts, tokenizer_path)[2], keep)


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The rows with ``decoded``, the text of their ids; added tokens are shown, unknown ids left out. Null ids give an empty text."""

    def texts(column: pa.Array) -> list[pa.Array]:
        b, edges = _bytes(column)
        return [_texts(np.frombuffer(b.tobytes(), "<u4"), np.diff(edges) // 4, tokenizer_path)]

    return _appended(rows, ids_col, _DECODED, texts, keep)


def encode_and_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``encode`` with ``decoded`` as of ``decode``, by one pass and so by one worker a core."""

    def both(texts: pa.Array) -> list[pa.Array]:
        ids, n, cols = _ids(texts, tokenizer_path)
        return [*cols, _texts(ids, n, tokenizer_path)]

    return _appended(docs, text_col, _ENCODED + _DECODED, both, keep)
