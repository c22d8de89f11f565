"""Slices of batches are whole and bounded."""

import random

import pyarrow as pa

from charterloom.functions import batches
from charterloom.llm import frequency, spans


def batch(seed=1, n=50):
    r = random.Random(seed)
    lists = [None if r.random() < 0.1 else [r.choice(["a", "b", "", None]) for _ in range(r.randint(0, 30))] for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(lists, pa.list_(pa.string()))], names=["k", "t"])


def test_slices_by_elements():
    whole = batch()
    for most in (1, 10, 40, 10**6):
        parts = list(batches.by_elements(whole, 1, most))
        assert sum((p.to_pylist() for p in parts), []) == whole.to_pylist()
        assert all(p.num_rows == 1 or sum(len(t or []) for t in p.column(1).to_pylist()) <= most for p in parts)
    assert list(batches.by_elements(whole.slice(0, 0), 1)) == []
    again = list(batches.by_elements(whole.slice(7, 20), 1, 25))
    assert sum((p.to_pylist() for p in again), []) == whole.slice(7, 20).to_pylist()


def test_results_do_not_depend_on_slices(spark, monkeypatch):
    text = [f"t{k}" for k in range(45)]
    rows = [(k, 1, ["x"] * k + text[k % 3 :] + ["y"] * k, None) for k in range(12)] + [(50, 1, None, None)]
    df = spark.createDataFrame(rows, "doc_idx bigint, corpus int, tokens array<string>, tokenized_at timestamp")
    results = []
    for most in (batches.MOST_ELEMENTS, 60):
        monkeypatch.setattr(frequency, "by_elements", lambda b, c, most=most: batches.by_elements(b, c, most))
        monkeypatch.setattr(spans, "by_elements", lambda b, c, most=most: batches.by_elements(b, c, most))
        results.append((sorted(map(tuple, frequency.term_frequencies(df).collect()), key=str), sorted(map(tuple, spans.shared_spans(df).collect()))))
    assert results[0] == results[1] and results[0][1]
