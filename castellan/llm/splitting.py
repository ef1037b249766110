"""Cutting oversized texts at natural boundaries, with overlap between pieces.

Every token end on a character border is a possible cut with a strength: ends of
paragraphs, lines, sentences, clauses and words, word starts, any character.  A
sparse-table range-maximum index over the strengths of a whole batch answers, for every
text at once, which cut in the permissible window of token positions is strongest; of
equals the rightmost wins.  The next piece starts the overlap before that cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castellan.functions.text import trim_blanks
from castellan.llm.bpe import DEFAULT_VOCABULARY, Encoder, Words, encoder, slices
from castellan.llm.tokens import bounded, with_token_counts

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, TOKEN_GROUP, CHARACTER = 6, 5, 4, 3, 2, 1, 0
#: A piece that is cut holds at least this share of its limit, unless only less ends naturally.
LEAST_FILL = 0.5
_ENDS = np.frombuffer(".!?。！？…।؟".encode("utf-32-le"), np.uint32)
_PAUSES = np.frombuffer(",;:，、；：".encode("utf-32-le"), np.uint32)
_CLOSERS = np.frombuffer("\"')]}»”’」』）".encode("utf-32-le"), np.uint32)


class RangeMax:
    """Sparse table: the greatest of values[lo..hi], both ends included, in two look-ups."""

    def __init__(self, values: np.ndarray, longest: int):
        self.rows = [values]
        step = 1
        while 2 * step <= min(longest, len(values)):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-step], last[step:]))
            step *= 2

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.minimum(np.frexp(hi - lo + 1)[1] - 1, len(self.rows) - 1)
        out = np.empty(len(lo), self.rows[0].dtype)
        for k in np.unique(level):
            at = level == k
            row = self.rows[k]
            out[at] = np.maximum(row[lo[at]], row[hi[at] - (1 << k) + 1])
        return out


def strengths(cp: np.ndarray, at: np.ndarray, word_start: np.ndarray) -> np.ndarray:
    """Strength of a cut before each code point ``at`` (positions inside the text)."""
    from castellan.llm.bpe import _SPACE, _classes

    out = np.where(word_start, TOKEN_GROUP, CHARACTER).astype(np.int64)
    n = len(cp)
    before, here = cp[at - 1], cp[np.minimum(at, n - 1)]
    two, three = cp[np.maximum(at - 2, 0)], cp[np.maximum(at - 3, 0)]
    kinds = _classes()
    white_before, white_here = kinds[before] == _SPACE, kinds[here] == _SPACE
    out[white_before != white_here] = WORD
    # the last sign that is no closing quote or bracket
    sign = np.where(np.isin(before, _CLOSERS), two, before)
    wide = before > 0x2E80
    out[(white_here | wide) & np.isin(sign, _PAUSES)] = CLAUSE
    out[(white_here | wide) & np.isin(sign, _ENDS)] = SENTENCE
    out[(before == 10) | ((before == 13) & (here != 10))] = LINE
    out[(before == 10) & ((two == 10) | ((two == 13) & (three == 10)))] = PARAGRAPH
    # never between the two signs of a line end, nor before the blank lines that follow one
    out[(before == 13) & (here == 10)] = CHARACTER
    out[(before == 10) & ((here == 10) | (here == 13))] = WORD
    return out


def cut_texts(enc: Encoder, data: np.ndarray, start: np.ndarray, most: np.ndarray, overlap: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Pieces of the texts data[start[i]:start[i + 1]] that have more than most[i] tokens:
    (text, piece number, first byte, end byte, first char, end char, tokens shared with the
    piece before, tokens), each an array."""
    words = Words(data, start)
    ids, counts = enc.words_ids(words.array())
    if not len(counts):
        return []
    token_end = np.cumsum(enc.lengths[ids]).astype(np.int64)  # byte offsets
    word_token = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    text_token = word_token[words.first]
    sizes = np.diff(text_token)
    big = np.flatnonzero(sizes > most)
    if not len(big):
        return []
    # possible cuts: token ends on a character border, and the start of each text
    border = np.zeros(len(data) + 1, bool)
    border[words.chars] = True
    border[len(data)] = True
    ok = border[token_end]
    cut_byte = token_end[ok]
    cut_token = np.flatnonzero(ok) + 1
    first_word = np.zeros(len(data) + 1, bool)
    first_word[words.start] = True
    at = np.searchsorted(words.chars, cut_byte)
    inside = np.minimum(np.maximum(at, 1), max(len(words.codes) - 1, 1))
    power = strengths(words.codes, inside, first_word[cut_byte]) if len(words.codes) > 1 else np.zeros(len(at), np.int64)
    n = len(cut_byte)
    index = RangeMax(power * (n + 1) + np.arange(n), int(most[big].max()) + 1)
    # all texts step at once; begin is a token position, its byte and the limit of each
    cap = np.maximum(most[big], 1).astype(np.int64)
    lap = np.minimum(overlap[big], cap - 1).clip(0).astype(np.int64)
    done: list[tuple[np.ndarray, ...]] = []
    # [text, piece, begin token, begin byte, shared tokens]
    text, piece = big, np.zeros(len(big), np.int64)
    begin, begin_byte, shared = text_token[big], start[big], np.zeros(len(big), np.int64)
    limit = cap.copy()
    # where the piece before ended: the next one must reach beyond it
    floor, floor_byte = begin.copy(), begin_byte.copy()
    while len(text):
        end = text_token[text + 1]
        final = end - begin <= limit
        least = begin + np.maximum(np.minimum(lap + 1, limit), np.ceil(limit * LEAST_FILL).astype(np.int64))
        hi = np.searchsorted(cut_token, begin + limit, "right") - 1
        lo = np.searchsorted(cut_token, np.maximum(least, floor + 1), "left")
        # a window without a character border: the last border before it, or the next behind
        none = lo > hi
        progress = np.searchsorted(cut_token, np.maximum(begin + np.minimum(lap, limit - 1), floor), "right")
        lo = np.where(none, np.where(progress <= hi, progress, np.maximum(hi, 0)), lo)
        stuck = lo > hi
        # the overlap leaves no room for a new cut: this piece goes without one
        afresh = (stuck | (cut_token[np.minimum(lo, n - 1)] <= floor)) & (begin < floor) & ~final
        bare = np.searchsorted(cut_token, begin, "right")
        lo = np.where(cut_token[np.minimum(lo, n - 1)] <= begin, bare, lo)
        hi = np.maximum(np.where(stuck, bare, hi), lo)
        best = index.query(lo, hi) % (n + 1)
        # nothing natural in the upper part of the window: the lower part, down to the overlap, may have it
        low = np.searchsorted(cut_token, np.maximum(begin + np.minimum(lap, limit - 1), floor), "right")
        poor = np.flatnonzero((power[best] < WORD) & (low < lo) & ~final)
        if len(poor):
            lower = index.query(low[poor], lo[poor] - 1) % (n + 1)
            best[poor] = np.where(power[lower] >= WORD, lower, best[poor])
        stop = np.where(final, end, cut_token[best])
        stop_byte = np.where(final, start[text + 1], cut_byte[best])
        # cutting inside a word may change its tokens, so each piece is encoded on its own
        own = piece_sizes(enc, data, begin_byte, stop_byte)
        excess = own - cap
        again = (excess > 0) & (limit > 1) & (stop - begin > 1) & ~afresh
        limit = np.where(again, np.minimum(limit, stop - begin) - np.maximum(excess, 1), cap).clip(1)
        keep = ~again & ~afresh
        if keep.any():
            done.append((text[keep], piece[keep], begin_byte[keep], stop_byte[keep], shared[keep], own[keep]))
        # the next piece starts the overlap before this cut, on a character border
        next_token, next_byte, kept_in = stop.copy(), stop_byte.copy(), np.zeros(len(stop), np.int64)
        ask = np.flatnonzero(keep & ~final & (lap > 0))
        if len(ask):
            back, kept_in[ask] = overlap_starts(enc, data, cut_token, cut_byte, begin[ask], stop[ask], stop_byte[ask], lap[ask])
            found = back >= 0
            next_token[ask[found]], next_byte[ask[found]] = cut_token[back[found]], cut_byte[back[found]]
        go = ~keep | ~final
        shared = np.where(again, shared, np.where(afresh, 0, kept_in))[go]
        next_token, next_byte = np.where(afresh, floor, next_token), np.where(afresh, floor_byte, next_byte)
        floor, floor_byte = np.where(keep, stop, floor)[go], np.where(keep, stop_byte, floor_byte)[go]
        begin, begin_byte = np.where(again, begin, next_token)[go], np.where(again, begin_byte, next_byte)[go]
        piece = np.where(keep, piece + 1, piece)[go]
        text, limit, cap, lap = text[go], limit[go], cap[go], lap[go]
    text, piece, a, b, shared, own = (np.concatenate(x) for x in zip(*done))
    order = np.lexsort((piece, text))
    text, piece, a, b, shared, own = (x[order] for x in (text, piece, a, b, shared, own))
    char = lambda byte: np.searchsorted(words.chars, byte) - np.searchsorted(words.chars, start[text])
    return [(text, piece, a, b, char(a), char(b), shared, own)]


def overlap_starts(enc: Encoder, data: np.ndarray, cut_token: np.ndarray, cut_byte: np.ndarray, begin: np.ndarray, stop: np.ndarray, stop_byte: np.ndarray, lap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the cut where the next piece starts, -1 for none, and the tokens of the
    text shared by both pieces, encoded on its own.

    The first guess counts tokens of the whole text; as white space at an end may encode
    otherwise there, its neighbours are tried too, until the shared text has exactly the
    overlap asked.
    """
    guess = np.searchsorted(cut_token, stop - lap, "right") - 1
    best, size = np.full(len(lap), -1), np.zeros(len(lap), np.int64)
    for step in (0, -1, 1, -2, 2):
        at = np.clip(guess + step, 0, len(cut_token) - 1)
        open_ = np.flatnonzero((size != lap) & (guess + step == at) & (cut_token[at] > begin) & (cut_token[at] < stop))
        if not len(open_):
            continue
        got = piece_sizes(enc, data, cut_byte[at[open_]], stop_byte[open_])
        better = (size[open_] == 0) | (got == lap[open_])
        best[open_[better]], size[open_[better]] = at[open_[better]], got[better]
    return best, size


def piece_sizes(enc: Encoder, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tokens of data[a:b] when each is encoded on its own."""
    size = b - a
    off = np.r_[0, np.cumsum(size)]
    own = data[np.repeat(a - off[:-1], size) + np.arange(off[-1])]
    words = Words(own, off)
    counts = enc.words_ids(words.array(), with_ids=False)[1]
    return np.diff(np.r_[0, np.cumsum(counts, dtype=np.int64)][words.first])


def limits_of(chunk_limits: DataFrame) -> dict[str, tuple[int, int]]:
    """Limit and overlap by kind, without case and outer blanks; of several rows the least
    limit and the greatest overlap.  A hand-written list, held on the driver whole."""
    kind = F.lower(trim_blanks(F.col("doc_kind")))
    rows = chunk_limits.where("max_tokens > 0").groupBy(kind.alias("k")).agg(F.min("max_tokens").alias("m"), F.max(F.coalesce("overlap_tokens", F.lit(0))).alias("o")).where("k is not null").collect()
    return {r.k: (r.m, r.o) for r in rows}


def pieces(documents: DataFrame, chunk_limits: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Ordered pieces of every text above the limit of its kind (narrow: no shuffle).

    (doc_id, piece_no, start_char, end_char, n_tokens, overlap_tokens, piece): n_tokens is
    that of the piece encoded on its own and at most max_tokens; overlap_tokens is the size
    of the text shared with the piece before; it differs from the one asked where neither
    the place that many tokens back in the whole text nor a place up to two characters'
    ends beside it gives that size on its own.  Null, empty and small texts give no pieces; a null or unlisted kind takes the
    row 'default'; without that row such texts stay whole.  An overlap not below the limit
    counts as limit - 1.  A single character of more tokens than the limit stays whole.
    """
    table = limits_of(chunk_limits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        usual = table.get("default", (2**31 - 1, 0))
        for batch in batches:
            for b in bounded(batch, 2):
                kinds = [table.get(k, usual) for k in b.column(1).to_pylist()]
                most, lap = np.array([m for m, _ in kinds], np.int64), np.array([o for _, o in kinds], np.int64)
                row = 0
                for data, start in slices(b.column(2)):
                    n = len(start) - 1
                    for text, no, a, e, ca, ce, shared, tokens in cut_texts(enc, data, start, most[row : row + n], lap[row : row + n]):
                        size = e - a
                        off = np.r_[0, np.cumsum(size)]
                        own = data[np.repeat(a - off[:-1], size) + np.arange(off[-1])]
                        texts = pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(off), pa.py_buffer(own)])
                        yield pa.RecordBatch.from_arrays(
                            [
                                b.column(0).take(pa.array(text + row)), pa.array(no.astype("int32")), pa.array(ca.astype("int32")), pa.array(ce.astype("int32")),
                                pa.array(tokens.astype("int32")), pa.array(shared.astype("int32")), texts.cast(pa.string()),
                            ],
                            names=["doc_id", "piece_no", "start_char", "end_char", "n_tokens", "overlap_tokens", "piece"],
                        )
                    row += n

    kind = F.lower(trim_blanks(F.col("doc_kind")))
    return documents.select("doc_id", kind.alias("_kind"), F.col("text").alias("_text")).mapInArrow(
        work, "doc_id long, piece_no int, start_char int, end_char int, n_tokens int, overlap_tokens int, piece string"
    )


def checks(documents: DataFrame, chunk_limits: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, sound) of every document: its pieces without what they share are its text,
    in order, each within the limit of its kind (or one character) and reaching beyond the
    one before; a text without pieces is within the limit."""
    table = limits_of(chunk_limits)
    kind = F.coalesce(F.lower(trim_blanks(F.col("doc_kind"))), F.lit("default"))
    usual = F.lit(table.get("default", (2**31 - 1, 0))[0])
    most = usual
    for k, (m, _) in table.items():
        most = F.when(kind == k, m).otherwise(most)
    docs = with_token_counts(documents.select("doc_id", most.alias("most"), F.coalesce(F.md5("text"), F.md5(F.lit(""))).alias("text_md5"), "text"), vocabulary=vocabulary)
    made = pieces(documents, chunk_limits, vocabulary)
    step = F.struct("piece_no", "start_char", "end_char", "n_tokens", "piece")
    per = made.groupBy("doc_id").agg(F.array_sort(F.collect_list(step)).alias("ps"))
    end_before = lambda i: F.when(i > 0, F.get(F.col("ps"), i - 1)["end_char"]).otherwise(0)
    own = F.transform("ps", lambda p, i: F.substr(p["piece"], end_before(i) - p["start_char"] + 1))
    whole = F.md5(F.array_join(own, ""))
    reach = F.forall(F.transform("ps", lambda p, i: (p["piece_no"] == i) & (p["start_char"] <= end_before(i)) & (p["end_char"] > end_before(i))), lambda x: x)
    fits = F.forall("ps", lambda p: (p["n_tokens"] <= F.col("most")) | (F.length(p["piece"]) == 1))
    joined = docs.join(per, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("ps").isNull(), F.col("n_tokens") <= F.col("most")).otherwise((whole == F.col("text_md5")) & reach & fits & (F.col("n_tokens") > F.col("most"))).alias("sound"))
