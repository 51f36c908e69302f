"""Text quality statistics per document, with lines labelled by a hidden Markov model."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.weighted import task_sums
from tidewire.session import written

#: Characters that numpy handles at once, unless one text has more.
_CHARS = 1 << 20
#: Lines that numpy handles at once, unless one text has more.
_LINES = 1 << 17
#: Lines of a document that a fit goes through one by one; longer ones are cut into pieces.
_PIECE = 256
#: Common words that are sent to all tasks, 8 bytes each; a larger table is joined.
MOST_COMMON = 1_000_000

STATES = ("prose", "list", "table", "junk")
_LETTER, _DIGIT, _WHITE = 1, 2, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
#: Sizes of the line statistics: words, end, begin, symbols, common words, bars.
_SIZES = (5, 3, 6, 5, 4, 3)

# For each state and statistic, how likely its values are before fitting.
#   words 0, 1-3, 4-8, 9-20, more | end of sentence, comma or colon, other
#   begin capital, small letter, bullet, table mark, other symbol, digit
#   symbols to .03, .08, .2, .4, more | common words none, to .15, to .3, more | bars none, one, more
_PRIOR = {
    "prose": ((1, 4, 15, 30, 50), (80, 8, 12), (70, 15, 2, 1, 9, 3), (35, 45, 18, 1, 1), (4, 10, 30, 56), (90, 7, 3)),
    "list": ((2, 30, 40, 20, 8), (6, 4, 90), (3, 3, 88, 1, 2, 3), (5, 35, 40, 15, 5), (20, 20, 25, 35), (85, 12, 3)),
    "table": ((18, 40, 25, 12, 5), (2, 3, 95), (2, 2, 1, 88, 5, 2), (2, 8, 30, 35, 25), (60, 15, 10, 15), (10, 45, 45)),
    "junk": ((25, 40, 20, 10, 5), (5, 5, 90), (14, 16, 2, 8, 50, 10), (10, 10, 20, 25, 35), (65, 15, 10, 10), (70, 15, 15)),
}
_STAY = 0.8

_tables: tuple | None = None


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower-case code point of every code point, made once per process."""
    global _tables
    if _tables is None:
        kind = np.zeros(0x110000, np.uint8)
        low = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            name = unicodedata.category(chr(c))
            if name[0] == "L":
                kind[c] = _LETTER
                small = chr(c).lower()
                if len(small) == 1:
                    low[c] = ord(small)
            elif name == "Nd":
                kind[c] = _DIGIT
        kind[[32, 9, 10, 13]] = _WHITE
        _tables = kind, low
    return _tables


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hash(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every slice low[begin:end]."""
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(low), _ODD)], dtype=np.uint64)
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(low), _BACK)], dtype=np.uint64)
    run = np.r_[np.uint64(0), np.cumsum(_spread(low) * powers[: len(low)], dtype=np.uint64)]
    return _spread((run[end] - run[begin]) * back[begin] + (end - begin).astype(np.uint64))


def _word_hash(words: list[str]) -> np.ndarray:
    codes = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for w in words]
    ends = np.cumsum([len(c) for c in codes])
    return _hash(np.concatenate(codes), np.r_[0, ends[:-1]], ends)


def _languages(langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the first two letters of every language, and which languages are known."""
    short = {x: x[:2].lower() for x in set(langs) if x is not None}
    hashes = dict(zip(short, _spread(_word_hash([short[x] + "." for x in short])), strict=True)) if short else {}
    return np.array([hashes.get(x, 0) for x in langs], np.uint64), np.array([x is not None for x in langs], bool)


def _common_keys(rows: list[tuple[str, str]]) -> np.ndarray:
    """64-bit hashes of language and word, ascending."""
    if not rows:
        return np.zeros(0, np.uint64)
    return np.unique(_word_hash([w for _, w in rows]) ^ _languages([x for x, _ in rows])[0])


class CommonWords:
    """Common words by language: sorted hashes, or None where they are to be joined."""

    def __init__(self, keys: np.ndarray | None):
        self.keys = keys

    def hits(self, keys: np.ndarray) -> np.ndarray:
        if self.keys is None or not len(self.keys):
            return np.zeros(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return self.keys[at] == keys


@dataclass
class Block:
    """Counts per document and statistics per nonempty line of some documents."""

    docs: dict[str, np.ndarray]
    line_doc: np.ndarray
    codes: np.ndarray
    #: Line and hash of every word of a known language.
    word_line: np.ndarray
    word_key: np.ndarray


def _ended(codes: np.ndarray) -> np.ndarray:
    """Which lines end in . ! or ?, as their codes have it."""
    return np.unravel_index(codes, _SIZES)[1] == 0


def measure(texts: list[str], langs: list[str | None], common: CommonWords, given: list[list[dict]] | None = None) -> Block:
    """All counts of some texts at once, on their code points. given has the numbers of common
    words by line of the text, where they don't come from common."""
    kind_of, low_of = _characters()
    n = len(texts)
    parts = [np.frombuffer((t + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    code = np.concatenate(parts)
    doc_end = np.cumsum([len(p) for p in parts])
    doc_begin = np.r_[0, doc_end[:-1]]
    kind = kind_of[code]
    letter = kind == _LETTER
    line_end = np.flatnonzero(code == 10)
    line_begin = np.r_[0, line_end[:-1] + 1]
    seen = np.flatnonzero(kind != _WHITE)
    at0, at1 = np.searchsorted(seen, line_begin), np.searchsorted(seen, line_end)
    full = at1 > at0
    line_begin, line_end, at0, at1 = line_begin[full], line_end[full], at0[full], at1[full]
    line_doc = np.searchsorted(doc_end, line_begin, side="right")
    first, last = code[seen[at0]], code[seen[at1 - 1]]
    first_kind = kind[seen[at0]]
    ended = np.isin(last, [46, 33, 63])

    edge = np.diff(np.r_[np.int8(0), letter.view(np.int8), np.int8(0)])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word_doc = np.searchsorted(doc_end, begin, side="right")
    low = low_of[code]
    sigma = np.flatnonzero(code == 0x3A3)  # ends a word as another letter than inside
    if len(sigma):
        low[sigma[~letter[np.minimum(sigma + 1, len(code) - 1)] & letter[np.maximum(sigma - 1, 0)] & (sigma > 0)]] = 0x3C2
    lang, known = _languages(langs)
    word_key, known = _hash(low, begin, end) ^ lang[word_doc], known[word_doc]
    hit = common.hits(word_key) & known
    word_line = np.searchsorted(line_begin, begin, side="right") - 1

    def per(marks: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.searchsorted(marks, e) - np.searchsorted(marks, b)

    letters, digits = np.flatnonzero(letter), np.flatnonzero(kind == _DIGIT)
    visible = per(seen, doc_begin, doc_end)
    words = np.bincount(word_doc, minlength=n)
    docs = {
        "n_words": words,
        "n_letters": per(letters, doc_begin, doc_end),
        "n_visible": visible,
        "n_symbols": visible - per(letters, doc_begin, doc_end) - per(digits, doc_begin, doc_end),
    }

    w = per(begin, line_begin, line_end)
    c = np.bincount(word_line[hit], minlength=len(line_doc))
    if given is not None:
        for i, (first_line, lines) in enumerate(zip(np.searchsorted(line_doc, np.arange(n)), given, strict=True)):
            for x in lines or []:
                c[first_line + x["line"]] += x["c"]
    docs["n_common"] = np.bincount(line_doc, c, n).astype(np.int64)
    bars = per(np.flatnonzero((code == 124) | (code == 9)), line_begin, line_end)
    symbols = at1 - at0 - per(letters, line_begin, line_end) - per(digits, line_begin, line_end)
    share = symbols / (at1 - at0)
    often = c / np.maximum(w, 1)
    start = np.select(
        [np.isin(first, [42, 35, 8226, 8211, 183]) | ((first == 45) & (share < 0.5)), np.isin(first, [124, 33]) | ((first == 123) & (bars > 0)), first_kind == _DIGIT, (first_kind == _LETTER) & (low[seen[at0]] != first), first_kind == _LETTER, np.isin(first, [39, 34, 8220, 171, 40])],
        [2, 3, 5, 0, 1, 0],
        4,
    )
    features = (
        np.searchsorted([1, 4, 9, 21], w, side="right"),
        np.select([ended, np.isin(last, [44, 58, 59])], [0, 1], 2),
        start,
        np.searchsorted([0.03, 0.08, 0.2, 0.4], share),
        np.where(c == 0, 0, 1 + np.searchsorted([0.15, 0.3], often)),
        np.minimum(bars, 2),
    )
    return Block(docs, line_doc, np.ravel_multi_index(features, _SIZES).astype(np.int32), word_line[known], word_key[known])


def _padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents by falling length, and how many still have a line at every step."""
    order = np.argsort(-lengths, kind="stable")
    steps = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    return order, steps


class LineModel:
    """A hidden Markov model over line statistics with one state per kind of line.

    Statistics are independent given the state. The fit is Baum-Welch with the fixed prior
    counts kept in, so states keep their meaning.
    """

    def __init__(self) -> None:
        self.prior = [np.array([_PRIOR[s][f] for s in STATES], float) for f in range(len(_SIZES))]
        self.emit = [p / p.sum(axis=1, keepdims=True) for p in self.prior]
        self.move = np.full((4, 4), (1 - _STAY) / 3) + np.eye(4) * (_STAY - (1 - _STAY) / 3)
        self.start = np.array([0.5, 0.1, 0.2, 0.2])

    def scores(self) -> np.ndarray:
        """Log-likelihood of every code of line statistics in every state."""
        total = np.zeros((*_SIZES, 4))
        for f, e in enumerate(self.emit):
            total = total + np.log(e).T.reshape([_SIZES[f] if i == f else 1 for i in range(len(_SIZES))] + [4])
        return total.reshape(-1, 4)

    def expected(self, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Forward and backward: the expected counts of statistics by state, moves and starts of
        some documents, one after the other, in one vector.

        Long documents are cut into pieces that run side by side: the product of a piece's steps
        tells how it is entered and left, so the counts are those of the whole document.
        """
        if not len(codes):
            return np.zeros(4 * sum(_SIZES) + 20)
        count = -(-lengths // _PIECE)
        doc = np.repeat(np.arange(len(lengths)), count)
        first = np.cumsum(count) - count
        size = np.minimum(_PIECE, lengths[doc] - (np.arange(len(doc)) - first[doc]) * _PIECE)
        # Lines by their step within the piece, then pieces by falling size: those of a step stand together.
        order, steps = _padded(size)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        offset = np.cumsum(steps) - steps
        end = np.cumsum(size)
        place = offset[np.arange(len(codes)) - np.repeat(end - size, size)] + np.repeat(rank, size)
        placed = np.empty(len(codes), np.int64)
        placed[place] = codes
        b = np.exp(self.scores())[placed]
        enter, leave = np.tile(self.start, (len(size), 1)), np.ones((len(size), 4))
        self._join(count, first, rank, b, offset, steps, enter, leave)

        forward, back = np.empty_like(b), np.empty_like(b)
        for t, m in enumerate(steps):
            at = offset[t]
            f = (enter if t == 0 else forward[offset[t - 1] : offset[t - 1] + m] @ self.move) * b[at : at + m]
            forward[at : at + m] = f / f.sum(axis=1, keepdims=True)
        moved = np.zeros((4, 4))
        for t in range(len(steps) - 1, -1, -1):
            at, m = offset[t], steps[t]
            back[at : at + m] = leave[:m]
            if t:
                moved += self._moves(forward[offset[t - 1] : offset[t - 1] + m], b[at : at + m] * leave[:m], leave)
        later = np.flatnonzero(np.arange(len(doc)) > first[doc])
        begin = rank[later]
        moved += self._moves(forward[place[end[later - 1] - 1]], b[begin] * back[begin])
        gamma = forward * back
        gamma /= gamma.sum(axis=1, keepdims=True)
        by_code = np.stack([np.bincount(placed, gamma[:, s], int(np.prod(_SIZES))) for s in range(4)]).reshape(4, *_SIZES)
        seen = [by_code.sum(axis=tuple(i + 1 for i in range(len(_SIZES)) if i != f)).ravel() for f in range(len(_SIZES))]
        return np.concatenate([*seen, moved.ravel(), gamma[rank[first[count > 0]]].sum(axis=0)])

    def _moves(self, before: np.ndarray, after: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
        """Expected moves between lines with the forward vectors before and likelihood times
        backward vectors after; the lines before get their backward vectors in back."""
        new = after @ self.move.T
        if back is not None:
            back[: len(new)] = new / new.sum(axis=1, keepdims=True)
        return self.move * (before.T @ (after / (before * new).sum(axis=1, keepdims=True)))

    def _join(self, count, first, rank, b, offset, steps, enter, leave) -> None:
        """Fill in how pieces of documents with several are entered and left, by rank."""
        docs = np.flatnonzero(count > 1)
        if not len(docs):
            return
        docs = docs[np.argsort(-count[docs], kind="stable")]
        most = -count[docs]
        cut = np.sort(rank[np.repeat(count > 1, count)])
        through = np.tile(np.eye(4), (len(cut), 1, 1))
        for t, m in enumerate(steps):
            k = np.searchsorted(cut, m)
            if not k:
                break
            x = (through[:k] if t == 0 else through[:k] @ self.move) * b[offset[t] + cut[:k], None, :]
            through[:k] = x / x.sum(axis=(1, 2), keepdims=True)
        for k in range(1, -most[0]):
            p = first[docs[: np.searchsorted(most, -k)]] + k
            e = np.einsum("ni,nij->nj", enter[rank[p - 1]], through[np.searchsorted(cut, rank[p - 1])]) @ self.move
            enter[rank[p]] = e / e.sum(axis=1, keepdims=True)
        for k in range(-most[0] - 1, 0, -1):
            p = first[docs[: np.searchsorted(most, -k)]] + k
            e = np.einsum("nij,nj->ni", through[np.searchsorted(cut, rank[p])], leave[rank[p]]) @ self.move.T
            leave[rank[p - 1]] = e / e.sum(axis=1, keepdims=True)

    def updated(self, counts: np.ndarray, weight: float = 20.0) -> LineModel:
        """The model of expected counts; weight scales the prior ones."""
        new, at = LineModel(), 0
        for f, n in enumerate(_SIZES):
            e = counts[at : at + 4 * n].reshape(4, n) + self.prior[f] * weight
            new.emit[f] = e / e.sum(axis=1, keepdims=True)
            at += 4 * n
        moved, begun = counts[at : at + 16].reshape(4, 4) + 10, counts[at + 16 :] + 10
        new.move, new.start = moved / moved.sum(axis=1, keepdims=True), begun / begun.sum()
        return new

    def change(self, old: LineModel) -> float:
        """The largest difference of a probability from another model's."""
        return max(float(np.abs(a - b).max()) for a, b in zip([*self.emit, self.move, self.start], [*old.emit, old.move, old.start], strict=True))

    def label(self, lengths: np.ndarray, codes: np.ndarray, scores: np.ndarray | None = None) -> np.ndarray:
        """The most likely state of every line (Viterbi), documents one after the other."""
        b = self.scores() if scores is None else scores
        order, steps = _padded(lengths)
        begin = (np.cumsum(lengths) - lengths)[order]
        move = np.log(self.move)
        best = np.zeros((len(lengths), 4))
        came = np.zeros((len(codes), 4), np.int8)
        out = np.zeros(len(codes), np.int8)
        for t, m in enumerate(steps):
            at = begin[:m] + t
            if t == 0:
                best[:m] = np.log(self.start) + b[codes[at]]
            else:
                options = best[:m, :, None] + move
                came[at] = options.argmax(axis=1)
                best[:m] = options.max(axis=1) + b[codes[at]]
        state = best.argmax(axis=1)
        for t in range(len(steps) - 1, -1, -1):
            m = steps[t]
            at = begin[:m] + t
            out[at] = state[:m]
            state[:m] = came[at, state[:m]]
        return out


def _blocks(batches: Iterator[pa.RecordBatch], common: CommonWords) -> Iterator[tuple[pa.Array, Block]]:
    """(keys, measures) of the texts, some at a time; columns are key, lang, text and, where
    common words are joined, their numbers by line."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            to, held = at, 0
            while to < b.num_rows and (to == at or held < _CHARS):
                held += len(b.column(2)[to].as_py())
                to += 1
            part = b.slice(at, to - at)
            given = part.column(3).to_pylist() if part.num_columns > 3 else None
            yield part.column(0), measure(part.column(2).to_pylist(), part.column(1).to_pylist(), common, given)
            at = to


def common_words(table: DataFrame, lang: str = "lang", word: str = "word") -> CommonWords:
    """The hashes of the table of common words, if there are at most MOST_COMMON."""
    rows = table.select(F.lower(lang), word).where(F.col(lang).isNotNull() & F.col(word).isNotNull()).limit(MOST_COMMON + 1).collect()
    return CommonWords(None if len(rows) > MOST_COMMON else _common_keys([(r[0], r[1]) for r in rows]))


def _with_line_counts(texts: DataFrame, table: DataFrame, lang: str = "lang", word: str = "word") -> DataFrame:
    """texts (key, lang, text) with the numbers of common words by line, from a join on the
    hashes of language and word, for tables of common words of any size."""
    texts = written(texts.toDF("key", "lang", "text").withColumn("_id", F.monotonically_increasing_id()), "quality-texts")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(_common_keys(rows).view(np.int64), pa.int64())], ["w"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _blocks(batches, CommonWords(None)):
            first = np.searchsorted(block.line_doc, np.arange(len(ids)))
            line, n = np.unique(np.stack([block.word_line, block.word_key.view(np.int64)]), axis=1, return_counts=True)
            doc = block.line_doc[line[0]]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array((line[0] - first[doc]).astype(np.int32)), pa.array(line[1]), pa.array(n)], ["_id", "line", "w", "n"])

    keys = table.select(F.lower(lang), word).where(F.col(lang).isNotNull() & F.col(word).isNotNull()).mapInArrow(hashed, "w bigint").distinct()
    words = texts.select("_id", "lang", "text").mapInArrow(told, "_id bigint, line int, w bigint, n bigint")
    lines = words.join(keys, "w").groupBy("_id", "line").agg(F.sum("n").alias("c"))
    return texts.join(lines.groupBy("_id").agg(F.collect_list(F.struct("line", "c")).alias("given")), "_id", "left").select("key", "lang", "text", "given")  # an entry per line of the text


def _documents(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, numbers of lines, codes) of a column of lists of codes, some documents at a time."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    codes, ends = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + _LINES, side="right")) - 1)
        yield slice(at, to), lengths[at:to], codes[ends[at] : ends[to]].astype(np.int64)
        at = to


def fit_lines(codes: DataFrame, tol: float = 1e-4, max_rounds: int = 1000) -> LineModel:
    """Fit the line model by Baum-Welch on a table of the codes of every document's lines, all of
    them, until no probability changes by more than tol. A round reads the table once and adds up
    one small vector per task."""
    size = 4 * sum(_SIZES) + 20
    model = LineModel()
    for _ in range(max_rounds):
        sums = task_sums(codes.select("codes"), size, lambda b, m=model: sum((m.expected(n, c) for _, n, c in _documents(b.column(0))), np.zeros(size)))
        old, model = model, model.updated(sums)
        if model.change(old) <= tol:
            return model
    raise RuntimeError(f"the line model changes by {model.change(old):.2g} after {max_rounds} rounds")


_COUNTS = ("n_words", "n_letters", "n_visible", "n_symbols", "n_lines", "n_ended", "n_common")
_MEASURED = ("n_words", "n_letters", "n_visible", "n_symbols", "n_common")
_SHARES = tuple(f"{s}_share" for s in STATES)


def _measured(texts: DataFrame, common: CommonWords) -> DataFrame:
    """Key, whether the language is known, counts and codes of the lines of texts (key, lang,
    text) as a written table."""
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, block in _blocks(batches, sent.value):
            ends = np.searchsorted(block.line_doc, np.arange(len(keys) + 1))
            codes = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(block.codes))
            yield pa.RecordBatch.from_arrays([keys.field(0), keys.field(1), *(pa.array(block.docs[c].astype(np.int64)) for c in _MEASURED), codes], ["key", "known", *_MEASURED, "codes"])

    # The language goes around the Python step as a flag: no language, no share of common words.
    flagged = texts.withColumn("key", F.struct("key", F.col("lang").isNotNull().alias("known")))
    kind = dict(texts.dtypes)["key"]
    return written(flagged.mapInArrow(counted, f"key {kind}, known boolean, " + ", ".join(f"{c} bigint" for c in _MEASURED) + ", codes array<int>"), "quality-measured")


def text_quality(documents: DataFrame, common_table: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document of a non-null text, with its statistics.

    Columns: the key; n_words (runs of letters), n_letters, n_visible (characters but white
    space), n_symbols (visible, neither letter nor decimal digit), n_lines (nonempty after
    trimming), n_ended (lines that end in . ! or ?), n_common (words that are common in the
    language); mean_word_length, symbol_share, line_end_share, common_share, each null where
    its denominator is 0, the last also for a null language; the shares of lines that the
    hidden Markov model labels prose, list, table and junk, and kind, the largest of them;
    these are null for a text without lines. n_lines and n_ended are sums over the labels.
    Documents with null text give no row, equal documents each their own; an empty table gives
    none; other columns are ignored.

    One pass over the texts without a shuffle writes counts and a number per line; the model is
    fitted on the lines of all documents and sent out, and every line is labelled by it. More
    common words than MOST_COMMON are joined to the lines instead.
    """
    common = common_words(common_table)
    texts = documents.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    if common.keys is None:
        texts = _with_line_counts(texts, common_table)
    measured = _measured(texts, common)
    model = fit_lines(measured)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scores()
        for b in batches:
            for rows, lengths, codes in _documents(b.column(b.num_columns - 1)):
                n = len(lengths)
                label = np.repeat(np.arange(n) * 4, lengths) + model.label(lengths, codes, scores)
                lines, ended = (np.bincount(label[own], minlength=4 * n).reshape(n, 4) for own in (slice(None), _ended(codes)))
                counts = {"n_lines": lines.sum(axis=1), "n_ended": ended.sum(axis=1)}
                with np.errstate(invalid="ignore"):
                    shares = lines / counts["n_lines"][:, None]
                none = counts["n_lines"] == 0
                part = b.slice(rows.start, n)
                given = dict(zip(part.schema.names, part.columns, strict=True)) | {c: pa.array(v.astype(np.int64)) for c, v in counts.items()}
                yield pa.RecordBatch.from_arrays([given[c] for c in ("key", "known", *_COUNTS)] + [pa.array(shares[:, i], mask=none) for i in range(4)], ["key", "known", *_COUNTS, *_SHARES])

    schema = f"key {dict(texts.dtypes)['key']}, known boolean, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", " + ", ".join(f"{c} double" for c in _SHARES)
    inner = measured.mapInArrow(labelled, schema)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    top = F.greatest(*_SHARES)
    return inner.select(
        F.col("key").alias(key), *_COUNTS,
        ratio("n_letters", "n_words").alias("mean_word_length"),
        ratio("n_symbols", "n_visible").alias("symbol_share"),
        ratio("n_ended", "n_lines").alias("line_end_share"),
        F.when(F.col("known"), ratio("n_common", "n_words")).alias("common_share"),
        *_SHARES,
        F.coalesce(*(F.when(F.col(c) == top, s) for c, s in zip(_SHARES, STATES, strict=True))).alias("kind"),
    )


def failed_checks(stats: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document and failed check of its statistics: key and failed."""
    checks = {
        "few_words": F.col("n_words") < 25,
        "word_length": (F.col("mean_word_length") < 3.5) | (F.col("mean_word_length") > 7.5),
        "symbols": F.col("symbol_share") > 0.2,
        "line_ends": F.col("line_end_share") < 0.2,
        "common_words": F.col("common_share") < 0.25,
    }
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))
    return stats.select(key, F.explode(named).alias("failed"))
