"""What a task leaves in its Python worker."""

import gc
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import textscan, toxicity
from helixframe.llm.workers import returning


def own_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_a_task_gives_back_its_memory():
    """Also when it fails; collection of cycles, which a task may stop, goes on."""

    def run(batches):
        gc.disable()
        for b in batches:
            textscan.Scan(pa.array([b * (1 << 20)])).words
            yield b
        raise ValueError(b)

    with pytest.raises(ValueError, match="ab "):
        list(run(iter(["ab "])))
    held = own_mb()
    with pytest.raises(ValueError, match="ab "):
        list(returning(run)(iter(["ab "])))
    assert gc.isenabled() and len(textscan._POW) == len(textscan._INV) == 1
    assert own_mb() < held - 40  # the powers alone took 48 MB


def test_grams_gathered_in_parts_are_the_same(monkeypatch):
    words = toxicity.read(["naïve words of many kinds, some a b c twice words", "", "more of them"])[0]
    model = toxicity.ToxicityModel()
    whole = model.inputs(words)
    assert whole.shape == (len(words.bucket), 2 * toxicity.EMBED)
    for n in (1, 3):
        monkeypatch.setattr(toxicity, "GATHERED", n)
        assert np.array_equal(model.inputs(words), whole)
    assert model.inputs(words.take(np.zeros(0, np.int64))).shape == (0, 2 * toxicity.EMBED)
