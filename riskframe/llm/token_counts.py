"""Token counts under a unigram vocabulary: Viterbi that carries a score and a count, nothing else.

An Aho-Corasick automaton over the pieces gives all matches of a word, at each end the longest
first. Best score and piece count up to an end come from the best start: scores are compared in
double precision, and a later, shorter piece replaces an earlier one only if it is strictly better.
A character without a piece of its own may stand as unknown at ten below the least score; a run of
unknown characters counts one token per UTF-8 byte where the vocabulary has all bytes, else one in
all, and one if the run happens to be a piece. These are the rules of the ``Unigram`` model of the
``tokenizers`` library behind a splitting ``Metaspace``, and the tests hold the counts against it.

No pieces are kept, so memory is two numbers per character of a word. Words met before in a worker
are looked up. Texts are processed whole; null counts as empty, and an empty text has 0 tokens and
score 0. Rows are independent, a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words that one worker remembers; beyond it starts afresh.
REMEMBERED = 1_000_000


class UnigramCounter:
    """Counts of words under pieces with scores. byte_pieces: whether unknown text falls back to bytes."""

    def __init__(self, pieces: dict[str, float], byte_pieces: bool):
        import ahocorasick

        self.pieces, self.byte_pieces = pieces, byte_pieces
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - 10.0
        self.memory: dict[str, tuple[int, float]] = {}

    def _run_cost(self, run: str) -> int:
        if run in self.pieces or not self.byte_pieces:
            return 1
        return len(run.encode("utf-8"))

    def word(self, word: str) -> tuple[int, float]:
        """Tokens and score of one word, its leading space included."""
        n = len(word)
        score = [0.0] + [None] * n
        count = [0] * (n + 1)
        run: dict[int, int] = {}  # end of a run of unknown characters -> its start
        at, single = 0, False
        matches = self.automaton.iter(word)
        item = next(matches, None)
        while at < n:
            best, took, single = None, 0, False
            while item is not None and item[0] == at:
                length, piece = item[1]
                single = single or length == 1
                reached = piece + score[at + 1 - length]
                if best is None or reached > best:
                    best, took = reached, length
                item = next(matches, None)
            if not single:
                reached = self.unknown + score[at]
                if best is None or reached > best:
                    best, took = reached, 0
            at += 1
            score[at] = best
            if took:
                count[at] = count[at - took] + 1
            else:
                start = run.get(at - 1, at - 1)
                run[at] = start
                count[at] = count[start] + self._run_cost(word[start:at])
        return count[n], score[n] or 0.0

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = (text[1:] if text[0] in (" ", SPACE) else text).replace(SPACE, " ").split(" ")
        memory = self.memory
        try:
            found = [memory[w] for w in words]
        except KeyError:
            if len(memory) > REMEMBERED:
                memory.clear()
            for w in words:
                if w not in memory:
                    memory[w] = self.word(SPACE + w)
            found = [memory[w] for w in words]
        counts, scores = zip(*found)
        return sum(counts), sum(scores)


@lru_cache(maxsize=4)
def counter(path: str) -> UnigramCounter:
    """The plain pieces of a SentencePiece model file with their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return UnigramCounter({sp.id_to_piece(i): float(sp.get_score(i)) for i in plain}, sum(map(sp.is_byte, ids)) == 256)


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens and score of every row; columns other than id and text are not read."""

    @F.pandas_udf("n_tokens long, score double")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for texts in batches:
            yield pd.DataFrame([c.text(t or "") for t in texts], columns=["n_tokens", "score"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), counts(F.col(text_column)).alias("c"))
    return rows.select("doc_id", "c.n_tokens", "c.score")
