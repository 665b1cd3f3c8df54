"""The pieces of an existing SentencePiece vocabulary file, and lattices over them."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

MARK = "▁"


def default_vocabulary() -> str:
    return os.environ.get("POLISLAKE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


class Vocabulary:
    """names[i]: text of piece i (white space as U+2581); logp[i]: its natural log probability; byte_ids[b]: the piece of byte b.

    A unigram file's scores are taken as they are. A merge-ranked (BPE) file has ranks for scores (-0, -1, ...); they become
    Zipf-Mandelbrot probabilities, the usual law of frequency by rank: p ~ 1 / (rank + 2.7). Single bytes share BYTE_SHARE."""

    BYTE_SHARE = 1e-3

    def __init__(self, path: str) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path, n = path, p.get_piece_size()
        self.names = [p.id_to_piece(i) for i in range(n)]
        self.is_byte = np.array([p.is_byte(i) for i in range(n)])
        unused = np.array([p.is_control(i) or p.is_unknown(i) or p.is_unused(i) for i in range(n)])
        score = np.array([p.get_score(i) for i in range(n)], float)
        self.normal = ~(self.is_byte | unused)
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.is_byte):
            self.byte_ids[int(self.names[i][1:-1], 16)] = i
        ranked = bool((score[self.normal] == np.round(score[self.normal])).all())
        weight = np.zeros(n)
        if ranked:
            rank = np.where(score <= -1e8, n, -score)
            weight[self.normal] = 1 / (rank[self.normal] + 2.7)
        else:
            weight[self.normal] = np.exp(score[self.normal])
        weight[self.normal] *= (1 - self.BYTE_SHARE) / weight[self.normal].sum()
        weight[self.is_byte] = self.BYTE_SHARE / 256
        with np.errstate(divide="ignore"):
            self.logp = np.log(weight)
        self.piece = {self.names[i]: int(i) for i in np.flatnonzero(self.normal)}
        self.longest = max(map(len, self.piece))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
