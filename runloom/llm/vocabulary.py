"""An existing subword vocabulary, read from a public tokenizer's file, and unigram weights for it."""

from __future__ import annotations

import math

import sentencepiece

#: Where the vocabulary lies; every operator takes another path as a parameter.
PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


class Vocabulary:
    """Pieces by id, which ids stand for single bytes, and a log weight for each piece.

    The file orders its pieces by score; its scores are ranks, so a piece's weight is that of
    a word of this rank under Zipf's law with Mandelbrot's shift, normalised: natural log of
    1 / (rank + 2.7) over their sum.
    """

    def __init__(self, pieces: list[str], byte_ids: dict[int, int], unknown: int, ranks: dict[int, float]):
        self.pieces, self.byte_ids, self.unknown = pieces, byte_ids, unknown
        order = sorted(ranks, key=lambda i: (-ranks[i], i))
        weight = {i: 1 / (r + 2.7) for r, i in enumerate(order)}
        total = math.log(sum(weight.values()))
        self.weights = {i: math.log(w) - total for i, w in weight.items()}
        #: A byte piece weighs as much as the rarest piece.
        self.byte_weight = min(self.weights.values(), default=-10.0)


def load(path: str = PATH) -> Vocabulary:
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
    ranks = {i: m.get_score(i) for i in range(len(pieces)) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
    return Vocabulary(pieces, {int(pieces[i][1:-1], 16): i for i in range(len(pieces)) if m.is_byte(i)}, m.unk_id(), ranks)
