"""Token counts of whole texts by heap-and-linked-list byte-pair merging.

A sentencepiece BPE model merges, again and again, the adjacent pair of symbols whose piece ranks first,
the leftmost of equals.  The number of tokens is the number of initial symbols less the number of merges;
no identifier is looked up or emitted.  A character outside the vocabulary counts as its UTF-8 bytes and
never merges.

No piece holds a space mark behind another character, so no merge crosses the start of a word: a text is
counted word by word, and a worker keeps the counts of words it has met (at most ``KEPT_WORDS``, then it
starts anew; words over ``LONG_WORD`` characters are counted each time).

Null and empty texts have 0 tokens.  Every row keeps all its columns; repeated rows are counted alike.
"""

from __future__ import annotations

import functools
import re
from heapq import heapify, heappop, heappush

import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import importable

KEPT_WORDS = 600_000
LONG_WORD = 64
SPACE = "▁"
PROBE = "ﬁ 　 ①é "


class PieceCounter(dict):
    """Counts tokens as the model would; as a dict it maps a word to the tokens of space mark and word."""

    def __init__(self, path: str):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError("only models that keep characters and spaces as they are can be counted word by word")
        plain = [i for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(SPACE in piece.lstrip(SPACE) for piece in score):
            raise ValueError("a piece crosses the start of a word")
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {piece: order[s] for piece, s in score.items()}

    def merged(self, chunk: str) -> int:
        """Tokens of a stretch of characters: initial symbols minus merges."""
        rank = self.rank
        piece: list[str | None] = list(chunk)
        n = len(piece)
        symbols = sum(1 if c in rank else len(c.encode()) for c in piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[pair], i, pair) for i, pair in enumerate(map(str.__add__, chunk, chunk[1:])) if pair in rank]
        heapify(heap)
        merges = 0
        while heap:
            _, i, whole = heappop(heap)
            left, j = piece[i], after[i]
            if left is None or j >= n or left + piece[j] != whole:
                continue  # one of the two has merged with another since
            piece[i], piece[j] = whole, None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = whole + piece[k]
                if pair in rank:
                    heappush(heap, (rank[pair], i, pair))
            k = before[i]
            if k >= 0:
                pair = piece[k] + whole
                if pair in rank:
                    heappush(heap, (rank[pair], k, pair))
        return symbols - merges

    def __missing__(self, word: str) -> int:
        count = self.merged(SPACE + word)
        if len(word) <= LONG_WORD:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = count
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.__getitem__, text.split(" ")))
        marked = SPACE + text.replace(" ", SPACE)
        return sum(self[x[1:]] if x[1:2] != SPACE else self.merged(x) for x in re.findall(f"{SPACE}+[^{SPACE}]*", marked))


@functools.cache
def counter(path: str) -> PieceCounter:
    """One per worker process and model."""
    return PieceCounter(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text under the sentencepiece model at ``path``."""
    importable()

    @F.pandas_udf("long")
    def count(values: pd.Series) -> pd.Series:
        known = counter(path)
        return pd.Series([known.count(x) for x in values], dtype="int64")
    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every document."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"),
                        token_count(whole, path).alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
