"""Test passages inside a training corpus, by a distributed positional inverted index."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import written

#: Test passages that are sent to all tasks; more of them are routed to the blocks that may hold them.
MOST_WINDOWS = 200_000
#: Bits of the filter of test words, of which words the index keeps postings.
FILTER_BITS = 1 << 24
#: Words of a block of the index, unless one document has more.
BLOCK_WORDS = 400_000
#: Candidates that a block looks at together; words whose hashes a task remembers.
_STEP, _KNOWN = 1 << 20, 1 << 20

_ALNUM = re.compile(r"[^\W_]+")
_BLOCK = "block bigint, doc_ids array<bigint>, lengths array<int>, terms array<bigint>, starts array<int>, dfs array<int>, docs array<int>, places array<int>"
_NAMES = ["block", "doc_ids", "lengths", "terms", "starts", "dfs", "docs", "places"]
_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4]
_FOUND = "doc_id bigint, item_id bigint, kind string, n_words int, doc_word int, item_word int"
_FOUND_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]


def _other_numbers() -> str:
    """Characters that re counts to \\w but that are neither letters nor decimal digits."""
    return "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) in ("No", "Nl"))


class _Words:
    """Splits a text into maximal runs of letters and digits, lower-cased."""

    def __init__(self) -> None:
        odd = _other_numbers()
        # A set of the lower plane alone is a bitmap to re; the others make it a list of ranges.
        self.low = re.compile(f"[{''.join(c for c in odd if ord(c) < 0x10000)}]")
        self.all = re.compile(f"[{odd}]")

    def __call__(self, text: str) -> list[str]:
        text = text.lower()
        if not text.isascii():
            wide = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
            odd = self.all if wide else self.low
            if odd.search(text):
                text = odd.sub(" ", text)
        return _ALNUM.findall(text)


_words: _Words | None = None


def words(text: str) -> list[str]:
    """The words of a text; none if it holds neither letters nor digits."""
    global _words
    _words = _words or _Words()
    return _words(text)


class _Terms(dict):
    """The 64-bit hash of a word, 0 for words that the filter knows not to be in a test text."""

    def __init__(self, bits: bytes | None = None):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        if self.bits is not None and not all(self.bits[p >> 3] >> (p & 7) & 1 for p in (h % (8 * len(self.bits)), (h >> 32) % (8 * len(self.bits)))):
            h = 0
        if len(self) >= _KNOWN:
            self.clear()
        self[word] = h = h - (1 << 64) if h >= 1 << 63 else h
        return h


def coded_items(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Every test item with the hashes of its words, as a written table: row, item_id, terms."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for b in batches:
            lists = [[terms[w] for w in words(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int64()))], ["item_id", "terms"])

    texts = items.select(F.col(item).cast("bigint").alias("item_id"), F.col(text)).where(F.col(text).isNotNull())
    return written(texts.mapInArrow(coded, "item_id bigint, terms array<bigint>").withColumn("row", F.monotonically_increasing_id()), "leak-items")


def word_filter(coded: DataFrame) -> bytes:
    """A Bloom filter of all test words. It has FILTER_BITS bits however many there are; when it
    fills up the index keeps postings that no test asks for, and nothing is lost."""
    places = F.expr(f"array(t & {FILTER_BITS - 1}, shiftrightunsigned(t, 32) & {FILTER_BITS - 1})")
    p = coded.select(F.explode("terms").alias("t")).distinct().select(F.explode(places).alias("p"))
    rows = p.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).collect()  # at most FILTER_BITS / 64
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    for r in rows:
        out[r["w"]] = r["bits"]
    return out.tobytes()


def build_index(corpus: DataFrame, bits: bytes | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional inverted index of the corpus, as a written table of blocks.

    A block holds whole documents: their ids and lengths in words, and for each term its
    postings (document of the block, place in it) in order, with its document frequency. With
    bits, terms that the filter rules out are left away. Documents of a null text have no
    postings. The corpus is read once, however many test items are looked up.
    """
    sent = corpus.sparkSession.sparkContext.broadcast(bits)

    def packed(block: int, ids: list[int], tokens: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in tokens], np.int32)
        term = np.concatenate(tokens)
        doc_ = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        place = np.arange(len(term), dtype=np.int32) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int32)
        keep = term != 0
        term, doc_, place = term[keep], doc_[keep], place[keep]
        order = np.argsort(term, kind="stable")
        term, doc_, place = term[order], doc_[order], place[order]
        new_term = np.r_[True, np.diff(term) != 0][: len(term)]
        starts = np.flatnonzero(new_term)
        new_doc = new_term | np.r_[True, np.diff(doc_) != 0][: len(term)]
        dfs = np.add.reduceat(new_doc, starts, dtype=np.int32) if len(starts) else starts
        columns = [np.array(ids, np.int64), lengths, term[starts], starts, dfs, doc_, place]
        lists = [pa.array([c.astype(k.value_type.to_pandas_dtype())], k) for c, k in zip(columns, _KINDS[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([block]), *lists], _NAMES)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, held, terms = [], [], 0, _Terms(sent.value)
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = words(t.as_py())
                ids.append(i)
                tokens.append(np.fromiter(map(terms.__getitem__, w), np.int64, len(w)))
                held += len(w)
                if held >= BLOCK_WORDS:
                    yield packed(block, ids, tokens)
                    ids, tokens, held, block = [], [], 0, block + 1
        if ids:
            yield packed(block, ids, tokens)

    texts = corpus.select(F.col(doc).cast("bigint"), F.col(text)).where(F.col(text).isNotNull() & F.col(doc).isNotNull())
    return written(texts.mapInArrow(indexed, _BLOCK), "leak-index")


_WINDOW = "item_id bigint, at int, terms array<bigint>, offsets array<int>"


def passages(coded: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """Every run of n words of every test item, as a written table: where it begins, and its
    terms with their offsets, from the rarest in the corpus to the most common (equally rare
    ones as they stand). Runs with a word that no document has are nowhere and left out."""
    df = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.dfs").alias("df"))
    # Within a row of an item a much repeated word is looked up once.
    wanted = coded.select("row", F.explode(F.array_distinct("terms")).alias("t")).join(df, "t")
    known = wanted.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("t", "df"))).alias("df"))  # at most one entry per word of the item
    rows = coded.where(F.size("terms") >= n).join(known, "row").select("item_id", "terms", F.transform("terms", lambda t: F.coalesce(F.try_element_at("df", t), F.lit(0))).alias("dfs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, terms, dfs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                view = np.lib.stride_tricks.sliding_window_view
                term, df_ = view(terms.values.to_numpy(), n), view(dfs.values.to_numpy(), n)
                at = np.flatnonzero((df_ > 0).all(axis=1))
                for k in range(0, len(at), 10_000):
                    own = at[k : k + 10_000]
                    order = np.argsort(df_[own], axis=1, kind="stable")
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), n).cast(pa.list_(x_kind)) for x, x_kind in ((np.take_along_axis(term[own], order, axis=1), pa.int64()), (order.astype(np.int32), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i)), pa.array(own.astype(np.int32)), *lists], ["item_id", "at", "terms", "offsets"])

    return written(rows.mapInArrow(cut, _WINDOW), "leak-passages")


class _Windows:
    """Test passages, each in the order rarest first, with their words by number."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        self.item, self.at = t["item_id"].to_numpy(), t["at"].to_numpy()
        terms, offsets = (t[c].combine_chunks().flatten().to_numpy() for c in ("terms", "offsets"))
        self.n = len(terms) // max(len(self.item), 1)
        self.vocabulary, code = np.unique(terms, return_inverse=True)
        self.code, self.offset = (x.reshape(len(self.item), -1) if len(x) else np.zeros((0, 1), np.int64) for x in (code, offsets))


class _Block:
    """One block of the index, ready for look-ups of some passages."""

    def __init__(self, row: dict, w: _Windows):
        lengths, terms, starts, docs, places = (np.asarray(row[c]) for c in ("lengths", "terms", "starts", "docs", "places"))
        self.ids = np.asarray(row["doc_ids"], np.int64)
        self.base = np.cumsum(lengths + w.n) - lengths
        self.first, self.many = starts.astype(np.int64), np.diff(np.r_[starts, len(docs)])
        self.place = self.base[docs] + places
        #: All postings as term and place in one number, ascending.
        self.lists = np.repeat(np.arange(len(terms)), self.many).astype(np.int64) << 40 | self.place
        #: The passages' words as terms of the block, -1 where it hasn't the word.
        at = np.searchsorted(terms, w.vocabulary)
        at[at == len(terms)] = 0
        known = terms[at] == w.vocabulary if len(terms) else np.zeros(len(at), bool)
        self.term = np.where(known, at, -1)[w.code]

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the term's list has the place."""
        key = term.astype(np.int64) << 40 | place
        at = np.searchsorted(self.lists, key)
        at[at == len(self.lists)] = 0
        return self.lists[at] == key

    def candidates(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passage, place) of all postings of the rarest word of the passages, some at a time."""
        term = self.term[rows, 0]
        many = self.many[term]
        ends = np.cumsum(many)
        at = 0
        while at < len(term):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _STEP)))
            m = many[at:to]
            row = np.repeat(np.arange(at, to), m)
            yield rows[row], self.place[np.repeat(self.first[term[at:to]] - np.cumsum(m) + m, m) + np.arange(len(row))]
            at = to


def _phrases(block: _Block, w: _Windows) -> list[tuple]:
    """Exact passages: the list of the rarest word, intersected with the offset-adjusted lists of
    the others from rare to common; adjoining passages join into runs. The longest per pair."""
    rows, places = [], []
    for row, place in block.candidates(np.flatnonzero((block.term >= 0).all(axis=1))):
        place = place - w.offset[row, 0]
        for j in range(1, w.n):
            same = block.holds(block.term[row, j], place + w.offset[row, j])
            row, place = row[same], place[same]
        rows.append(row)
        places.append(place)
    row, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, places))
    if not len(row):
        return []
    item, at = w.item[row], w.at[row]
    order = np.lexsort((at, place - at, item))
    item, at, place = item[order], at[order], place[order]
    doc = np.searchsorted(block.base, place, side="right") - 1
    new = np.r_[True, (np.diff(item) != 0) | (np.diff(place - at) != 0) | (np.diff(at) != 1) | (np.diff(doc) != 0)]
    begin = np.flatnonzero(new)
    long = np.diff(np.r_[begin, len(item)]) + w.n - 1
    item, at, place, doc = item[begin], at[begin], place[begin], doc[begin]
    order = np.lexsort((at, place, -long, item, doc))
    first = order[np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0)]]
    return [(int(block.ids[doc[i]]), int(item[i]), "phrase", int(long[i]), int(place[i] - block.base[doc[i]]), int(at[i])) for i in first]


def _proximities(block: _Block, w: _Windows, rarest: int, span: int, known: set) -> list[tuple]:
    """Passages whose rarest words all stand within span words of the rarest one, in any order."""
    out = {}
    for row, place in block.candidates(np.flatnonzero((block.term[:, :rarest] >= 0).all(axis=1))):
        anchor = np.searchsorted(block.base, place, side="right") - 1
        for j in range(1, min(rarest, w.n)):
            repeated = block.term[row, j] == block.term[row, 0]
            base = block.term[row, j].astype(np.int64) << 40
            at = np.searchsorted(block.lists, base | np.maximum(place - span, block.base[anchor]))
            at[at == len(block.lists)] = 0
            hit = block.lists[at]
            near = repeated | ((hit >= base) & (hit <= (base | (place + span))) & (np.searchsorted(block.base, hit & ((1 << 40) - 1), side="right") - 1 == anchor))
            row, place, anchor = row[near], place[near], anchor[near]
        # One hit per document and item is enough: the first.
        _, first = np.unique(np.stack([anchor, w.item[row]]), axis=1, return_index=True) if len(row) else (None, [])
        for i in first:
            r, p, d = row[i], place[i], anchor[i]
            pair = int(block.ids[d]), int(w.item[r])
            if pair not in known:
                out.setdefault(pair, (*pair, "proximity", int(min(rarest, w.n)), int(p - block.base[d]), int(w.at[r])))
    return list(out.values())


def _look_up(row: dict, w: _Windows, proximity: bool, rarest: int, span: int) -> Iterator[pa.RecordBatch]:
    block = _Block(row, w)
    found = _phrases(block, w)
    if proximity:
        found += _proximities(block, w, rarest, span, {f[:2] for f in found})
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), _FOUND_KINDS, strict=True)], ["doc_id", "item_id", "kind", "n_words", "doc_word", "item_word"])


def _row(b: pa.RecordBatch | pa.Table, i: int) -> dict:
    return {n: b[n][i].values.to_numpy(zero_copy_only=False) for n in _NAMES[1:]}


def _routed(index: DataFrame, windows: DataFrame, how: tuple) -> DataFrame:
    """Search with any number of passages: each goes to the blocks that have its rarest word,
    where an item's passages stay together and at most about MOST_WINDOWS meet in a task."""
    holding = index.select("block", F.explode("terms").alias("rare"))
    going = windows.withColumn("rare", F.col("terms")[0]).join(holding, "rare").drop("rare")
    parts = written(going.groupBy("block").agg(F.ceil(F.count("*") / MOST_WINDOWS).alias("m")), "leak-parts")
    left = going.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("item_id"), "m")).drop("m")
    right = index.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))).drop("m")

    def searched(passages_: pa.Table, blocks: pa.Table) -> pa.Table:
        kinds = pa.schema(zip(["doc_id", "item_id", "kind", "n_words", "doc_word", "item_word"], _FOUND_KINDS, strict=True))
        some = passages_.num_rows and blocks.num_rows
        return pa.Table.from_batches(list(_look_up(_row(blocks, 0), _Windows(passages_), *how)) if some else [], kinds)

    sides = [d.withColumnsRenamed({"block": f"{s}_block", "part": f"{s}_part"}) for s, d in (("p", left), ("b", right))]
    names = [d.withColumns({f"{s}_k": F.col(f"{s}_block"), f"{s}_j": F.col(f"{s}_part")}).groupBy(f"{s}_k", f"{s}_j") for s, d in zip("pb", sides, strict=True)]
    return names[0].cogroup(names[1]).applyInArrow(searched, _FOUND)


def leaks(corpus: DataFrame, items: DataFrame, n_words: int = 10, proximity: bool = False, rarest: int = 4, span: int = 20, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Which documents hold passages of which test items.

    One row per document, item and kind: 'phrase' for a shared run of at least n_words words,
    with the length of the longest run and where it begins in either text, and with proximity
    'proximity' for pairs without one in which the rarest words of some passage all stand
    within span words of the rarest. Words are runs of letters and digits of the lower-cased
    text. Null texts, and items shorter than n_words, match nothing; equal items are reported
    each; empty tables give no rows; extra columns are ignored.

    The corpus is read once at any number of items, into blocks of positional postings from
    which exact document frequencies are added up. Passages are a table too. While there are
    at most MOST_WINDOWS of them they go to all blocks where these lie, so no posting is
    shuffled; more of them are joined to the blocks by their rarest word. Words are compared
    by 64-bit hashes.
    """
    coded = coded_items(items, item, text)
    index = build_index(corpus, word_filter(coded), doc, text)
    windows = passages(coded, index, n_words)
    how = (proximity, rarest, span)
    if windows.count() > MOST_WINDOWS:
        return _routed(index, windows, how)
    sent = corpus.sparkSession.sparkContext.broadcast(_Windows(windows.toArrow()))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(sent.value.item):
            for b in batches:
                for i in range(b.num_rows):
                    yield from _look_up(_row(b, i), sent.value, *how)

    return index.mapInArrow(searched, _FOUND)
