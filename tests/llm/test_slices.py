"""Memory of one working slice, which a worker keeps between the stages of the pipeline."""
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from labelforge.llm import bpe, language
from labelforge.llm.common import slices


def test_a_slice_of_language_identification_takes_little_memory():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(300)) for _ in range(1200)]  # 2.5 MB
    model = language.LanguageModel(["de", "en", "es", "fr"], np.log(np.random.default_rng(0).random((language.BUCKETS, 4)) * 1e-4 + 1e-6))
    parts = list(slices(iter([pa.RecordBatch.from_pydict({"text": texts})]), "text", language.SLICE))
    assert sum(p.num_rows for p in parts) == len(texts)
    tracemalloc.start()
    rows, _ = language.infer(parts[0].column(0).to_pylist(), model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 2 MB of such text take four times as much
    assert len(rows) == parts[0].num_rows and peak < 160 << 20, peak


def test_what_an_encoder_remembers_is_bounded():
    # two generations of words and of pre-tokens, some 200 bytes each, and the new ones of a group
    assert 4 * 200 * bpe.CACHE <= 100 << 20 and bpe.GROUP_BYTES <= 4 << 20
