"""What Python workers hold of a task, and from task to task."""

import tracemalloc
import weakref

import numpy as np
import pyarrow as pa

from clausewright.llm import common, lm_score, packing, token_counts


def test_a_task_lets_go_of_the_tables_of_the_stage_before(monkeypatch):
    task, path = [1], common.tokenizer_path("word_bpe_49k.json")
    monkeypatch.setattr(common, "_task", lambda: task[0], raising=False)
    texts = lambda: common.runs(iter([pa.record_batch([pa.array(["one two"])], ["text"])]))
    for encoder in (packing.encoder, token_counts.encoder):
        first = weakref.ref(encoder(path))
        list(texts())
        task[0] += 1
        assert encoder(path) is first()  # tasks that follow each other share it
        list(texts())
        task[0] += 1
        list(texts())
        assert first() is None


def _peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_s_ngrams_are_held_one_order_at_a_time():
    words = 200_000
    text = " ".join(f"{i:05x}" for i in np.random.default_rng(1).integers(0, 1 << 20, words).tolist()).encode()
    rows = pa.record_batch([pa.array([0]), pa.array([[len(text) + 1]], pa.list_(pa.int64())), pa.array([pa.compress(text, "zstd", asbytes=True)], pa.binary())], ["block", "ends", "data"])
    grams = lm_score._Grams(rows.column("ends")[0], rows.column("data")[0])
    others = {n: np.zeros(len(grams.distinct(n)[0]), np.int64) for n in (1, 2, 3)}
    del grams  # hash tables of the module live on
    peak = _peak(lambda: lm_score._scores(lm_score._Grams(rows.column("ends")[0], rows.column("data")[0]), others, words, 0.4))
    assert peak < 150 * words  # bytes; 170 a word with all orders held to the end
