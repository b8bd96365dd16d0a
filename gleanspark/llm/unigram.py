"""Token counts of a unigram vocabulary by a Viterbi pass that carries counts, not pieces."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.shared import byte_views, utf8

SPACE = "▁"  # stands for a space in pieces
UNKNOWN_PENALTY = 10.0  # fixed value: what an unknown character costs below the worst piece
REMEMBERED = 400_000  # units whose counts a worker keeps


class Unigram:
    """Pieces with log scores; ``fallback`` counts an unknown character as its UTF-8 bytes."""

    def __init__(self, pieces: Iterable[tuple[str, float]], fallback: bool = True):
        self.matches, scores, apart, lone = ahocorasick.Automaton(), [], True, False
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), float(score)))
            scores.append(float(score))
            apart &= SPACE not in piece.lstrip(SPACE)
            lone |= piece == SPACE
        self.matches.make_automaton()
        self.unknown, self.fallback = min(scores) - UNKNOWN_PENALTY, fallback
        # cut before each run of spaces: exact if no piece crosses such a place, no unknown run
        # can, and sums of scores are exact in any order
        self.by_unit = apart and lone and all(s == int(s) and abs(s) < 1 << 31 for s in scores)
        self.known: dict[str, tuple[int, float]] = {}

    def unit(self, text: str) -> tuple[int, float]:
        """Number of pieces of the best path, and its score.

        Positions are settled from left to right. Of paths with equal scores the one whose last
        piece begins earliest wins; an unknown character comes after all pieces, and is offered
        only where no piece of that one character starts. Neighbouring unknown ones are one piece,
        or without one their bytes.
        """
        n = len(text)
        best, count, lost = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)

        def unknown(end: int) -> None:
            best[end], lost[end] = best[end - 1] + self.unknown, True
            if self.fallback:
                count[end] = count[end - 1] + len(text[end - 1].encode("utf-8", "replace"))
            else:
                count[end] = count[end - 1] + (not lost[end - 1])

        settled, top, start, single = 0, None, 0, False
        # matches come by their end, at one end the longest first, so the earliest start wins ties
        for last, (length, score) in self.matches.iter(text):
            if last != settled:
                if top is not None:
                    settled += 1
                    if single or top >= best[settled - 1] + self.unknown:
                        best[settled], count[settled] = top, count[start] + 1
                    else:
                        unknown(settled)
                for end in range(settled + 1, last + 1):
                    unknown(end)
                settled, top, single = last, None, False
            at = best[last + 1 - length] + score
            if top is None or at > top:
                top, start = at, last + 1 - length
            if length == 1:
                single = True
        if top is not None:
            settled += 1
            if single or top >= best[settled - 1] + self.unknown:
                best[settled], count[settled] = top, count[start] + 1
            else:
                unknown(settled)
        for end in range(settled + 1, n + 1):
            unknown(end)
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of a whole text; a space is put before it, as before every word."""
        if not text:
            return 0, 0.0
        if not self.by_unit:
            return self.unit(SPACE + text.replace(" ", SPACE))
        words = text.replace(SPACE, " ").split(" ")
        if "" in words:
            words = self._runs(words)
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for word in set(words).difference(known):
            known[word] = self.unit(SPACE + word)
        found = [known[word] for word in words]
        return sum([c for c, _ in found]), sum([s for _, s in found])

    @staticmethod
    def _runs(words: list[str]) -> list[str]:
        """Words after more than one space carry the others along; spaces at the end stay one unit."""
        out, more = [], 0
        for word in words:
            if word:
                out.append(SPACE * more + word)
                more = 0
            else:
                more += 1
        if more:
            out.append(SPACE * (more - 1))
        return out


@cache
def loaded(path: str, fallback: bool) -> Unigram:
    """The ordinary pieces of a SentencePiece file with their scores, once for each worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return Unigram(rows, fallback)


def token_counts(text: Column, path: str, fallback: bool = True) -> Column:
    """Struct ``n_tokens, score`` of whole texts by the pieces of the file at ``path``, which
    every machine must have, taken as a unigram vocabulary. Null and empty texts have none."""

    @F.arrow_udf("struct<n_tokens: long, score: double>")
    def counts(texts: pa.Array) -> pa.Array:
        model = loaded(path, fallback)
        rows = [model.count(str(v, "utf-8", "replace")) for v in byte_views(texts)]
        return pa.StructArray.from_arrays(
            [
                pa.array(np.array([r[0] for r in rows], np.int64)),
                pa.array(np.array([r[1] for r in rows], np.float64)),
            ],
            ["n_tokens", "score"],
        )

    return counts.asNondeterministic()(utf8(text))


def counted(docs: DataFrame, path: str, fallback: bool = True) -> DataFrame:
    """``doc_id, n_tokens, score`` for every row of ``docs`` (``doc_id, text``; others not read).

    Repeated rows are each counted; an empty table gives no rows. A text without spaces is one
    unit however long; its cost is by its matches, not its square.
    """
    return docs.select("doc_id", token_counts(F.col("text"), path, fallback).alias("found")).select(
        "doc_id", "found.n_tokens", "found.score"
    )
