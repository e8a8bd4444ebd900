"""Token counts of a unigram vocabulary, without keeping the tokens.

A text's spaces become ``▁``, one is put in front unless the text starts with one, and the text is cut before
each of them; pieces never cross such a cut, so equal words are counted once per worker and looked up.
Within a word an Aho-Corasick automaton lists every vocabulary match, longest first at each
end, and a forward dynamic programme carries the best score and its number of pieces. The rules are
those of the public unigram tokenizer: a path is replaced only by a strictly better one, so on ties the earlier start (the
longer last piece) wins; a character without a piece of its own may be unknown at the smallest score less 10
and counts one token for each of its bytes.

Defined cases: missing and empty texts have no tokens; rows are counted one by one, so repeated rows
agree; extra columns pass through; a long word costs time in proportion to its length.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .tables import map_texts

UNKNOWN_PENALTY = 10.0
SPACE = "▁"
_CACHE_WORDS = 500_000
_counters: dict[str, "Counter"] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces on the best path through one word."""
        size = len(word)
        ending: list[list] = [[] for _ in range(size)]
        single = bytearray(size)
        for end, match in self.automaton.iter(word):
            ending[end].append(match)
            if match[0] == 1:
                single[end] = 1
        score, count = [0.0] * (size + 1), [0] * (size + 1)
        for end in range(size):
            best, pieces = None, 0
            for length, own in sorted(ending[end], reverse=True) if len(ending[end]) > 1 else ending[end]:
                start = end + 1 - length
                total = own + score[start]
                if best is None or total > best:
                    best, pieces = total, count[start] + 1
            if not single[end]:
                total = self.unknown + score[end]
                if best is None or total > best:
                    best, pieces = total, count[end] + len(word[end].encode())
            score[end + 1], count[end + 1] = best, pieces
        return count[size]

    def text(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        words = marked.split(SPACE)
        if words[0] == "":
            words = words[1:]
        known = self.known
        total = 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.word(SPACE + w)
                if len(known) < _CACHE_WORDS:      # frequent words come early and stay
                    known[w] = n
            total += n
        return total


def count_tokens(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Kept columns and n_tokens."""
    def run(texts: pa.Array) -> list:
        if path not in _counters:
            _counters[path] = Counter(vocabulary(path))
        counter = _counters[path]
        return [[counter.text(t) for t in texts.to_pylist()]]

    return map_texts(docs, docs.columns if keep is None else keep, [T.StructField("n_tokens", T.LongType())], run, text=text)
