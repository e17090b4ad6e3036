"""Token counts by linear longest-match.

The vocabulary is a trie of two roots: pieces that begin a word and pieces
that continue one. Every node has a failure link, the node to go on from once
the longest pieces of what was read so far are taken off, and the number of
pieces so taken. A word is then read once, character by character, adding up
those numbers; no piece is built. The greedy longest match has as many pieces,
and a word with a place where no piece fits counts as one unknown token.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, deque

from pyspark.sql import DataFrame

from vellum.llm import common, pieces

WORD = re.compile(r"\w+|[^\w\s]")
#: Distinct words whose counts a worker keeps.
REMEMBERED = 200_000


class LongestMatch:
    """Greedy word-piece lengths over the given first and later pieces."""

    def __init__(self, first: set[str], later: set[str]):
        self.step: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, words in ((0, first), (1, later)):
            for word in words:
                node = root
                for c in word:
                    nxt = self.step[node].get(c)
                    if nxt is None:
                        nxt = self.step[node][c] = len(self.step)
                        self.step.append({})
                        ends.append(False)
                    node = nxt
                if word:
                    ends[node] = True
        none = -1
        self.fail, self.pops = [none] * len(self.step), [0] * len(self.step)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.step[node].items():
                queue.append(child)
                if ends[child]:
                    self.fail[child], self.pops[child] = 1, 1
                    continue
                popped, back = self.pops[node], self.fail[node]
                while back != none and c not in self.step[back]:
                    popped += self.pops[back]
                    back = self.fail[back]
                if back != none:
                    self.fail[child], self.pops[child] = self.step[back][c], popped

    def count(self, word: str) -> int:
        node = total = 0
        step, fail, pops = self.step, self.fail, self.pops
        for c in word:
            while (child := step[node].get(c)) is None:
                if fail[node] < 0:
                    return 1
                total += pops[node]
                node = fail[node]
            node = child
        while node > 1:
            if fail[node] < 0:
                return 1
            total += pops[node]
            node = fail[node]
        return total


def vocabulary(model_path: str) -> tuple[set[str], set[str]]:
    """First and later pieces from a piece model: those with the mark of a
    word's beginning, and those without."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    mark = pieces.MARK
    return {p[1:] for p in names if p.startswith(mark) and len(p) > 1 and mark not in p[1:]}, {p for p in names if mark not in p}


@functools.lru_cache(4)
def automaton(model_path: str) -> LongestMatch:
    return LongestMatch(*vocabulary(model_path))


def token_counts(df: DataFrame, model_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown), longs, one row for each row of
    ``df``. Words are runs of word characters and single other characters,
    white space apart. One pass, no shuffle.

    A null or blank text has zeros. Repeated rows each have a row, a null
    doc_id stays null, other columns are not looked at. A text or a word of
    any length is counted whole, in time linear in it.
    """
    path = model_path or pieces.default_model()

    def make():
        tool = automaton(path)
        known: dict[str, int] = {}

        def length(word: str) -> int:
            n = known.get(word)
            if n is None:
                n = tool.count(word)
                if n == 1 and not _is_piece(tool, word):
                    n = -1
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = n
            return n

        def apply(ids, texts):
            out = {"doc_id": ids, "n_words": [], "n_tokens": [], "n_unknown": []}
            for text in texts:
                words = tokens = unknown = 0
                for word, k in Counter(WORD.findall(text)).items():
                    n = length(word)
                    words += k
                    tokens += k * abs(n)
                    unknown += k if n < 0 else 0
                out["n_words"].append(words)
                out["n_tokens"].append(tokens)
                out["n_unknown"].append(unknown)
            return out

        return apply

    return common.map_documents(common.documents(df, id_col, text_col), make, "doc_id long, n_words long, n_tokens long, n_unknown long")


def _is_piece(tool: LongestMatch, word: str) -> bool:
    node = 0
    for c in word:
        node = tool.step[node].get(c, -1)
        if node < 0:
            return False
    return node > 1 and tool.fail[node] == 1 and tool.pops[node] == 1
