from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ko", "mi", "ru", "se", "ta", "vo", "zel") for b in ("dan", "fir", "gol", "lim", "nor", "pex", "ras", "tun", "wick")]


@pytest.fixture
def docs(spark):
    """A frame of documents from (id, text) pairs."""
    def make(*rows):
        return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    return make


@pytest.fixture
def prose():
    """Random words, the same for a seed."""
    def make(n, seed):
        rng = random.Random(seed)
        return [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    return make
