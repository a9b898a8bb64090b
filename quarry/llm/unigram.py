"""Unigram scores of an existing piece vocabulary, and recursions over all segmentations of a word.

Pieces are byte strings in which a space stands for the mark of a word's start. Every byte also has its
fallback piece, so that any word has a segmentation. The vocabulary files at hand rank their pieces (a score is
minus a rank); a rank becomes a probability by Zipf's law, ``1 / (rank + 2.7)``, and a fallback piece gets a
millionth of the least of those.
"""

from __future__ import annotations

import math

_ZIPF = 2.7
_FALLBACK = 1e-6


def vocabulary(model_path: str) -> tuple[list[bytes], list[float]]:
    """Pieces of a sentencepiece model and their natural log probabilities; fallback pieces come last, by byte.

    Pieces with a word mark inside can't occur within a word and are left out, as are control pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces, weights = [], []
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if "▁" not in piece[1:]:
            pieces.append(piece.replace("▁", " ").encode())
            weights.append(1 / (_ZIPF - model.get_score(i)))
    weights += [min(weights, default=1.0) * _FALLBACK] * 256
    pieces += [bytes([b]) for b in range(256)]
    total = sum(weights)
    return pieces, [math.log(w / total) for w in weights]


class Lattice:
    """All segmentations of words into pieces, by a trie over the pieces' bytes."""

    def __init__(self, pieces: list[bytes], log_p: list[float]):
        self.trie: dict = {}
        for k, piece in enumerate(pieces):
            node = self.trie
            for b in piece:
                node = node.setdefault(b, {})
            node.setdefault(-1, []).append((k, log_p[k]))

    def forward(self, word: bytes) -> float:
        """The natural log of the summed probability of all segmentations, by forward recursion in log space."""
        s = b" " + word
        n = len(s)
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        exp, log1p, trie = math.exp, math.log1p, self.trie
        for i in range(n):
            at, node = alpha[i], trie
            for j in range(i, n):
                node = node.get(s[j])
                if node is None:
                    break
                for _, p in node.get(-1, ()):
                    x, y = at + p, alpha[j + 1]
                    if y == -math.inf:
                        alpha[j + 1] = x
                    elif x > y:
                        alpha[j + 1] = x + log1p(exp(y - x))
                    else:
                        alpha[j + 1] = y + log1p(exp(x - y))
        return alpha[n]

    def expect(self, word: bytes, weight: float, counts: list[float]) -> None:
        """Adds to ``counts`` how often each piece is used, over all segmentations, by ``weight`` such words."""
        s = b" " + word
        n = len(s)
        arcs = []
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        exp, log1p, trie = math.exp, math.log1p, self.trie
        for i in range(n):
            at, node = alpha[i], trie
            for j in range(i, n):
                node = node.get(s[j])
                if node is None:
                    break
                for k, p in node.get(-1, ()):
                    arcs.append((i, j + 1, k, p))
                    x, y = at + p, alpha[j + 1]
                    if y == -math.inf:
                        alpha[j + 1] = x
                    elif x > y:
                        alpha[j + 1] = x + log1p(exp(y - x))
                    else:
                        alpha[j + 1] = y + log1p(exp(x - y))
        beta = [-math.inf] * (n + 1)
        beta[n] = 0.0
        total = alpha[n]
        # Arcs lie in order of their starts, so going back every arc's end is complete when it is met.
        for i, j, k, p in reversed(arcs):
            x, y = beta[j] + p, beta[i]
            if y == -math.inf:
                beta[i] = x
            elif x > y:
                beta[i] = x + log1p(exp(y - x))
            else:
                beta[i] = y + log1p(exp(x - y))
            share = alpha[i] + x - total
            if share > -30:
                counts[k] += weight * exp(share)
