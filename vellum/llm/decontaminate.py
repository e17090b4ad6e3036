"""Benchmark passages in documents, found through an embedding of edit
distance into Hamming distance.

Texts are sequences of words. A random walk reads a window: at each step it
writes the word it stands on, and a random bit of (step, word) tells whether it
moves on. Two windows a few edits apart soon walk in step again, so that their
writings differ in few places. Samples of a few places each, over several
walks, are the hash tables: a window that equals an item in all places of one
sample is a candidate, and its neighbourhood is searched for the item by exact
edit distance. How many samples reach the target recall is tried out on edited
copies of every item before the documents are read; a size whose items miss it
after many walks is searched without samples.

Windows are as long as the items. One can hold an item within its edits only if
no more of its words than the edits are foreign to the items of its size; the
others are passed over, which loses none.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

#: Items of one index, and bytes of items that one pass over the documents
#: looks for, an index after the other.
ITEMS, PASS_BYTES = 2000, 4 << 20
#: Places of a sample, samples of a walk, steps of a walk for each word.
PLACES, SAMPLES, STEPS = 3, 64, 1.6
RECALL, LEAST_RECALL, MOST_WALKS, TRIALS = 0.99, 0.9, 48, 40
SEED = 11


def words_of(text: str) -> list[str]:
    return text.lower().split()


def window_size(n: int) -> int:
    """Words of the windows for an item of n words: n, rounded down by less
    than an eighth."""
    return n - n % max(1, n // 8)


class Size:
    """The items of one window size, and their walks."""

    def __init__(self, size: int, items: list[tuple[int, list[int]]], most: int, vocabulary: int, rng):
        self.size, self.most = size, most
        self.items = items
        local: dict[int, int] = {}
        for _, words in items:
            for w in words:
                local.setdefault(w, len(local) + 1)
        self.lookup = np.zeros(vocabulary + 1, np.uint16 if len(local) < 65_000 else np.int32)
        for w, k in local.items():
            self.lookup[w] = k
        self.steps = max(PLACES, int(STEPS * size))
        self.heads = np.array([[local[w] for w in words[:size]] for _, words in items])
        self.walks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.rng = rng
        self._grow()
        copies, owner = self._edited()
        missing = np.ones(len(copies), bool)
        while True:
            missing[missing] = ~self._meets(copies[missing], owner[missing], len(self.walks) - 1)
            by_item = 1 - np.bincount(owner, missing, len(items)) / np.bincount(owner, minlength=len(items))
            self.recall, self.least = 1 - float(missing.mean()), float(by_item.min())
            if self.recall >= RECALL and self.least >= LEAST_RECALL:
                break
            if len(self.walks) >= MOST_WALKS:
                # every window of few enough foreign words is a candidate
                self.walks = []
                self.recall = self.least = 1.0
                break
            self._grow()

    def _grow(self) -> None:
        """One more walk: its bits, samples, the items' writings, and for
        each step and word the samples that the word keeps open there."""
        v = int(self.lookup.max()) + 1
        bits = self.rng.integers(0, 2, (self.steps, v), dtype=np.uint8)
        samples = np.sort(np.array([self.rng.choice(self.steps, PLACES, replace=False) for _ in range(SAMPLES)]), axis=1)
        written = self.write(np.pad(self.heads, ((0, 0), (0, 1))), bits)
        open_ = np.zeros((self.steps, v), np.uint64)
        for s, places in enumerate(samples):
            for j in range(self.steps):
                if j in places:
                    open_[j, written[:, j]] |= np.uint64(1 << s)
                else:
                    open_[j] |= np.uint64(1 << s)
        self.walks.append((bits, samples, written, open_))

    def write(self, rows: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """What the walk writes over each row; a row's last column is padding."""
        at = np.zeros(len(rows), np.int64)
        own = np.arange(len(rows))
        out = np.empty((len(rows), self.steps), np.int64)
        for j in range(self.steps):
            out[:, j] = rows[own, at]
            at = np.minimum(at + bits[j, out[:, j]], rows.shape[1] - 1)
        return out

    def _edited(self) -> tuple[np.ndarray, np.ndarray]:
        """Copies of each item with as many random edits as are let through,
        by foreign words and by words of the items."""
        out, owner = [], []
        width, known = self.size, int(self.lookup.max())
        for t in range(max(300, TRIALS * len(self.items))):
            k = t % len(self.items)
            row = list(self.heads[k])
            for _ in range(self.most):
                kind, at = self.rng.integers(3), int(self.rng.integers(len(row)))
                word = 0 if self.rng.integers(2) else int(self.rng.integers(1, known + 1))
                if kind == 0:
                    row[at] = word
                elif kind == 1:
                    row.insert(at, word)
                elif len(row) > 1:
                    row.pop(at)
            out.append((row + [0] * width)[:width] + [0])
            owner.append(k)
        return np.array(out), np.array(owner)

    def _meets(self, rows: np.ndarray, owner: np.ndarray, walk: int) -> np.ndarray:
        bits, samples, written, _ = self.walks[walk]
        equal = self.write(rows, bits) == written[owner]
        return equal[:, samples].all(axis=2).any(axis=1)

    def candidates(self, flat: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
        """(start, item) of windows in ``flat`` that equal an item in all
        places of a sample. ``stop``: the past-the-last start, by place."""
        local = self.lookup[flat]
        size = self.size
        total = np.zeros(len(flat) + 1, np.int32)
        np.cumsum(local > 0, out=total[1:])
        starts = np.flatnonzero(total[size:] - total[:-size] >= size - self.most)
        starts = starts[starts + size <= stop[starts]]
        if not self.walks:
            return [(start, k) for start in starts.tolist() for k in range(len(self.items))]
        found: set[tuple[int, int]] = set()
        for at in range(0, len(starts), 1 << 15):
            part = starts[at : at + (1 << 15)]
            for bits, samples, written, open_ in self.walks:
                alive, place = part, part.copy()
                left = np.full(len(part), ~np.uint64(0))
                for j in range(self.steps):
                    word = local[place]
                    # the window's end pads it
                    word = np.where(place < alive + size, word, 0)
                    left &= open_[j, word]
                    place += bits[j, word]
                    if j % 4 == 3:
                        keep = np.flatnonzero(left)
                        if len(keep) < len(alive):
                            alive, place, left = alive[keep], place[keep], left[keep]
                        if not len(alive):
                            break
                if not len(alive):
                    continue
                alive = alive[left != 0]
                for cut in range(0, len(alive), 256):
                    some = alive[cut : cut + 256]
                    rows = np.pad(local[some[:, None] + np.arange(size)].astype(np.int64), ((0, 0), (0, 1)))
                    equal = self.write(rows, bits)[:, None, :] == written[None, :, :]
                    w, k = np.nonzero(equal[:, :, samples].all(axis=3).any(axis=2))
                    found.update(zip(some[w].tolist(), k.tolist()))
        return sorted(found)


def best_match(pattern: list[int], text: list[int]) -> tuple[int, int, int]:
    """(edits, begin, end) of the stretch of ``text`` nearest to ``pattern``:
    least edits, then first end, then longest. Bit-parallel columns."""
    edits, end = _scan(pattern, text, free=True)
    _, back = _scan(pattern[::-1], text[:end][::-1], free=False, want=edits)
    return edits, end - back, end


def _scan(pattern, text, free: bool, want: int | None = None) -> tuple[int, int]:
    n = len(pattern)
    full, high = (1 << n) - 1, 1 << (n - 1)
    places: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        if w:
            places[w] |= 1 << i
    up, down, score = full, 0, n
    best, at = n, 0
    for j, w in enumerate(text, 1):
        eq = places.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 | (0 if free else 1)) & full
        mh = mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        if score < best or want is not None and score == want:
            best, at = score, j
        if want is not None and j > 2 * n + want:
            break
    return (want, at) if want is not None else (best, at)


class Index:
    """Items ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, least_words: int):
        self.words: dict[str, int] = {}
        self.allowed: dict[int, int] = {}
        by_size: dict[int, list] = defaultdict(list)
        for item, text in items:
            found = words_of(text)
            if len(found) >= least_words:
                by_size[window_size(len(found))].append((item, [self.words.setdefault(w, len(self.words) + 1) for w in found]))
        rng = np.random.default_rng(SEED)
        self.similarity = similarity
        self.sizes = [Size(s, own, max(self.most(len(w)) for _, w in own), len(self.words), rng) for s, own in sorted(by_size.items())]
        self.pad = max((s.most for s in self.sizes), default=0) + 1

    def most(self, n: int) -> int:
        return math.floor(n * (1 - self.similarity) + 1e-9)

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text (item, words of the item, edits, begin, end), the
        nearest place for each item that is near enough."""
        get = self.words.get
        docs = [np.array([get(w, 0) for w in words_of(t)], np.int32) for t in texts]
        ends = np.cumsum([len(d) + self.pad for d in docs])
        begins = ends - [len(d) + self.pad for d in docs]
        out: list[dict[int, tuple]] = [{} for _ in texts]
        if not self.sizes or not len(docs):
            return [[] for _ in texts]
        flat = np.zeros(int(ends[-1]), np.int32)
        for a, d in zip(begins, docs):
            flat[a : a + len(d)] = d
        stop = np.repeat(ends, ends - begins)
        for size in self.sizes:
            if len(flat) < size.size:
                continue
            regions: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
            for start, k in size.candidates(flat, stop):
                doc = int(np.searchsorted(ends, start, side="right"))
                near = regions[doc, k]
                reach = len(size.items[k][1])
                if near and start <= near[-1][1] + reach:
                    near[-1][1] = start
                else:
                    near.append([start, start])
            for (doc, k), spans in regions.items():
                item, pattern = size.items[k]
                n = len(pattern)
                most = self.most(n)
                words = docs[doc]
                for a, b in spans:
                    low = max(0, a - begins[doc] - most)
                    edits, begin, end = best_match(pattern, words[low : b - begins[doc] + n + most].tolist())
                    if edits <= most:
                        hit = (edits, int(low + begin), int(low + end), n)
                        if item not in out[doc] or hit < out[doc][item]:
                            out[doc][item] = hit
        return [[(item, n, edits, a, b) for item, (edits, a, b, n) in sorted(hits.items(), key=lambda x: str(x[0]).zfill(20))] for hits in out]


@functools.lru_cache(32)
def _index(items: tuple[tuple[int, str], ...], similarity: float, least_words: int) -> Index:
    return Index(list(items), similarity, least_words)


def _search(items: list[tuple[int, str]], similarity: float, least_words: int):
    """A function from texts to their hits among the items."""
    parts = [tuple(items[at : at + ITEMS]) for at in range(0, max(1, len(items)), ITEMS)]

    def search(texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
        found = [_index(p, similarity, least_words).search(texts) for p in parts]
        return [[hit for own in hits for hit in own] for hits in zip(*found)]

    return search


def _passes(benchmark: DataFrame, item_col: str, item_text_col: str, least_words: int):
    """The items as sorted (id, text) lists of about ``PASS_BYTES`` each."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    passes = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PASS_BYTES))
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        rows = [(r.item_id, r.text) for r in part.collect()]
        yield sorted((x for x in rows if len(words_of(x[1])) >= least_words), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def benchmark_matches(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, least_words: int = 5) -> DataFrame:
    """(doc_id, item_id, item_words, edits, similarity, begin, end): for every
    document and every benchmark item that it holds with a similarity, one less
    the edits of words for each word of the item, of at least ``similarity``,
    the nearest place (the first of equal ones), as words from 0, end
    exclusive. Words are of lower-cased text between white space.

    No shuffle; the items travel to the tasks, about ``PASS_BYTES`` of them in
    a pass over the documents. An item within its edits of a passage is found
    with a chance of about ``RECALL`` or more over all items of a size, of
    ``LEAST_RECALL`` or more for each, an exact copy always. Items of fewer
    words than ``least_words``, empty and null ones are not looked for; equal
    items are each found. Null and empty documents hold none, a text of any
    length is searched whole; a repeated row is searched again; a null doc_id
    stays null; other columns are not looked at; an empty table of either kind
    gives an empty one.
    """
    docs = common.documents(df, id_col, text_col)
    schema = "doc_id long, item_id long, item_words int, edits int, similarity double, begin int, end int"
    out = None
    for chosen in _passes(benchmark, item_col, item_text_col, least_words):

        def make(chosen=chosen):
            search = _search(chosen, similarity, least_words)

            def apply(ids, texts):
                rows = [(i, item, n, e, 1 - e / n, a, b) for i, hits in zip(ids, search(texts)) for item, n, e, a, b in hits]
                return dict(zip(("doc_id", "item_id", "item_words", "edits", "similarity", "begin", "end"), zip(*rows) if rows else [[]] * 7))

            return apply

        found = common.map_documents(docs, make, schema)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, least_words: int = 5) -> DataFrame:
    """The rows of ``df``, all their columns, in which ``benchmark_matches``
    would find no item. Decided in place, a pass for ``PASS_BYTES`` of items.

    Null and empty texts stay, texts of any length are searched whole,
    repeated rows, null ids and columns of any name stay as they are, an empty
    table gives an empty one.
    """
    for chosen in _passes(benchmark, item_col, item_text_col, least_words):

        def make(chosen=chosen):
            search = _search(chosen, similarity, least_words)
            return lambda texts: [not hits for hits in search(texts)]

        df = df.where(common.per_text(make, "boolean")(F.col(text_col).cast("string")))
    return df
