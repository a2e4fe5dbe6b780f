"""Long runs of spaces through the SentencePiece encoder."""

from __future__ import annotations

import random
import time

import numpy as np
import sentencepiece

from codonlake.llm import pieces


def test_runs_of_marks_equal_the_library_and_stay_fast():
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoder = pieces.Encoder(pieces.Vocabulary.load())
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "     ", "in", "\n", "é"]) for _ in range(60)) for _ in range(500)]
    texts += [" " * n + "end" for n in (1, 2, 3, 15, 16, 17, 33, 20_000)]
    for text, got in zip(texts, encoder.texts(texts)):
        assert np.frombuffer(got, np.int32).tolist() == library.encode(text), text[:80]
    start = time.process_time()
    encoder.texts([" " * 200_000])
    assert time.process_time() - start < 30  # hours, were every merge to look at all parts
