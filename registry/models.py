"""A stand-in for a user's embedding model."""

from __future__ import annotations

from hashlib import md5

import numpy as np

from quillrank.operators.embedding import ModelFactory


def hashing_model(dim: int = 64) -> ModelFactory:
    """A deterministic stand-in for a model: counts words by the MD5 of the word."""

    def make():
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in enumerate(texts):
                for word in text.lower().split(" "):
                    if word:
                        out[row, int(md5(word.encode()).hexdigest()[:8], 16) % dim] += 1
            return out

        return embed

    return make
