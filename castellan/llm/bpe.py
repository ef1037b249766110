"""Encoding with a public byte-level BPE vocabulary in batched numpy merge rounds.

Texts of a batch are cut into words with array operations on code points (the split
pattern of the vocabulary, without a regex engine), distinct words are found with Arrow's
dictionary encoding, and words not met before are merged together: their symbols lie in
one flat array, and each round finds for every word its lowest-rank pair by binary search
over the sorted pair keys and merges all places of that pair.  The result equals merging
pair by pair, because a merge can only make pairs of a higher rank.
"""

from __future__ import annotations

import functools
import heapq
import json
import os

import numpy as np
import pyarrow as pa

#: Vocabulary file; a parameter, never part of this repository.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words of more bytes are merged with a heap instead of rounds, and not remembered.
LONG_WORD = 256
#: Distinct words that a worker remembers before it starts afresh.
CACHE_WORDS = 300_000
#: Bytes of text that are cut into words at once.
SLICE_BYTES = 2_000_000

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space, other."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            first, last = ord(m[0][0]), ord(m[0][-1])
            table[first : last + 1] = kind
    table[0xD800:0xE000] = _OTHER
    return table


class Words:
    """Words of a run of texts: bytes of word i are data[start[i]:start[i + 1]]."""

    __slots__ = ("codes", "data", "first", "start", "chars")

    def __init__(self, data: np.ndarray, text_start: np.ndarray):
        """``text_start``: byte offsets of the texts in ``data``, with the end."""
        self.data = data
        begin = np.flatnonzero((data & 0xC0) != 0x80)
        if len(begin) == len(data):
            cp = data
        else:
            cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.codes, self.chars = cp, begin
        text_char = np.searchsorted(begin, text_start)
        cut = word_cuts(cp, text_char)
        at = np.flatnonzero(cut)
        self.start = np.r_[begin[at], len(data)].astype(np.int64) if len(cp) else np.zeros(1, np.int64)
        #: index of the first word of each text, with the end
        self.first = np.searchsorted(self.start[:-1], text_start)

    def __len__(self) -> int:
        return len(self.start) - 1

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(self.start.astype(np.int32)), pa.py_buffer(self.data)])


def word_cuts(cp: np.ndarray, text_char: np.ndarray) -> np.ndarray:
    """True at each code point where a word starts.

    The pattern, in words: a contraction ('s 't 're 've 'm 'll 'd); else a run of letters,
    of numbers or of other signs, with one space before it; white space otherwise, the
    last one before a sign standing alone or joining it.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    kind = _classes()[cp]
    head = np.zeros(n + 1, bool)
    head[text_char] = True
    head = head[:n]
    cut = head.copy()
    cut[1:] |= kind[1:] != kind[:-1]
    ends = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~head[1:])
    cut[ends] = True
    joined = ends[cp[ends] == 32]
    cut[joined + 1] = False
    marks = np.flatnonzero((cp[:-1] == 39) & cut[:-1] & (kind[1:] == _LETTER) & ~head[1:])
    if len(marks):
        after = cp[marks + 1]
        one = np.isin(after, np.array([ord(c) for c in "stmd"], np.uint32))
        room = marks + 2 < n
        second = np.where(room, cp[np.minimum(marks + 2, n - 1)], 0)
        same = room & ~head[np.minimum(marks + 2, n - 1)]
        two = same & (((after == ord("r")) & (second == ord("e"))) | ((after == ord("v")) & (second == ord("e"))) | ((after == ord("l")) & (second == ord("l"))))
        for found, length in ((one, 2), (two & ~one, 3)):
            at = marks[found]
            cut[at + 1] = False
            rest = at + length
            cut[rest[rest < n]] = True
    return cut


class Encoder:
    """Byte-level BPE from a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.size = max(vocab.values()) + 1
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.by_rank = made
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        # the printable alphabet of byte-level vocabularies: bytes that print stand for themselves
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in shown}
        letters |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        back = {c: b for b, c in letters.items()}
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int32)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)

    # -- merging ---------------------------------------------------------------

    def _rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the number of tokens of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_owner = [], []
        none = np.int32(2**31 - 1)
        while len(sym):
            key = sym[:-1].astype(np.int64) * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(np.r_[rank, none], first)
            live = np.repeat(best != none, np.diff(np.r_[first, len(sym)]))
            hit = np.zeros(len(sym), bool)
            hit[:-1] = (rank != none) & (rank == np.repeat(best, np.diff(np.r_[first, len(sym)]))[:-1])
            if not live.all():
                done_sym.append(sym[~live])
                done_owner.append(owner[~live])
            # of places that overlap, every second counts, from the left
            pos = np.flatnonzero(hit)
            if len(pos):
                run = np.r_[True, np.diff(pos) != 1]
                place = np.arange(len(pos)) - np.repeat(np.flatnonzero(run), np.diff(np.r_[np.flatnonzero(run), len(pos)]))
                pos = pos[place % 2 == 0]
                sym = sym.copy()
                sym[pos] = self.by_rank[rank[pos]]
                live[pos + 1] = False
            sym, owner = sym[live], owner[live]
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return sym[order], np.bincount(owner, minlength=len(words)).astype(np.int32)

    def _heap(self, word: bytes) -> np.ndarray:
        """The same for one long word: pairs in a heap, neighbours in a linked list."""
        sym = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, size, rank_of, by_rank = len(sym), self.size, self.rank_of, self.by_rank
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := rank_of.get(sym[i] * size + sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or rank_of.get(sym[i] * size + sym[j]) != r:
                continue
            sym[i], alive[j] = int(by_rank[r]), False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (q := rank_of.get(sym[i] * size + sym[after[i]])) is not None:
                    heapq.heappush(heap, (q, i))
            if (p := before[i]) >= 0 and (q := rank_of.get(sym[p] * size + sym[i])) is not None:
                heapq.heappush(heap, (q, p))
        return np.array([s for s, a in zip(sym, alive) if a], np.int32)

    def _learn(self, words: list[bytes]) -> None:
        short = [w for w in words if len(w) <= LONG_WORD]
        ids, counts = self._rounds(short) if short else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        long_ = [w for w in words if len(w) > LONG_WORD]
        parts = [self._heap(w) for w in long_]
        ids = np.concatenate([ids, *parts])
        counts = np.r_[counts, np.array([len(p) for p in parts], np.int32)].astype(np.int32)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(len(self.flat), np.int32)]
        base = len(self.index)
        while base + len(words) > len(self.begin):
            self.begin = np.r_[self.begin, np.zeros(len(self.begin), np.int64)]
            self.count = np.r_[self.count, np.zeros(len(self.count), np.int32)]
        self.flat[self.used : self.used + len(ids)] = ids
        self.count[base : base + len(words)] = counts
        self.begin[base : base + len(words)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        for i, w in enumerate(short + long_):
            self.index[w] = base + i

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 come out as replacement signs."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")

    # -- encoding --------------------------------------------------------------

    def words_ids(self, words: pa.Array, with_ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Token ids of the words, end to end, and the number of tokens of each word."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        enc = words.dictionary_encode()
        known = enc.dictionary.to_pylist()
        new = [w for w in known if w not in self.index]
        if new:
            if len(self.index) + len(new) > CACHE_WORDS or self.used > 40 * CACHE_WORDS:
                self._forget()
                new = known
            self._learn(new)
        entry = np.fromiter((self.index[w] for w in known), np.int64, len(known))[enc.indices.to_numpy(zero_copy_only=False)]
        counts = self.count[entry]
        if not with_ids:
            return None, counts
        ends = np.cumsum(counts)
        total = int(ends[-1])
        at = np.repeat(self.begin[entry] - (ends - counts), counts) + np.arange(total)
        return self.flat[at], counts

    def encode(self, texts: pa.Array, with_ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of all texts end to end (null counts as empty), and the offsets of the texts
        among them.  Without ids only the offsets are made."""
        parts, totals = [], []
        for data, start in slices(texts):
            words = Words(data, start)
            ids, counts = self.words_ids(words.array(), with_ids)
            parts.append(ids)
            sums = np.r_[0, np.cumsum(counts, dtype=np.int64)]
            totals.append(np.diff(sums[words.first]))
        sizes = np.concatenate(totals) if totals else np.zeros(0, np.int64)
        ids = (np.concatenate(parts) if parts else np.zeros(0, np.int32)) if with_ids else None
        return ids, np.r_[0, np.cumsum(sizes)]


def slices(texts: pa.Array):
    """(bytes, byte offsets with the end) of successive runs of texts, of SLICE_BYTES or a
    single text; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
        yield data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


@functools.lru_cache(maxsize=2)
def encoder(path: str = DEFAULT_VOCABULARY) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(os.path.realpath(path))
