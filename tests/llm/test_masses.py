"""Near-duplicates in masses whose fingerprints don't tell them apart."""

from __future__ import annotations

import numpy as np
import pytest

from hazeframe.llm import simhash


def test_a_mass_with_one_fingerprint_loses_no_link(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):  # two sets that are alike each, all of one fingerprint
        own = np.unique(rng.integers(0, 2**63, 12, dtype=np.uint64))
        for half in range(2):
            held = own[half:]
            rows.append((2 * k + half, len(held), 1, 2, 3, 2 * k + half, bytearray(held.tobytes())))
    points = spark.createDataFrame(rows, "node long, size long, w0 long, w1 long, w2 long, cluster long, shingles binary")
    links = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash._met(points, 32).collect()}
    assert links == {(2 * k, 2 * k + 1) for k in range(300)}


@pytest.mark.parametrize("most", [10, 27])
def test_texts_that_are_surely_kept_do_not_move(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MAX_ID_BITS", most)  # 10: a full filter, which costs rows on their way, not results
    ids = [7 * k for k in range(3000)] + [2**63 - 1]
    may = simhash.id_filter(spark.createDataFrame([(k,) for k in ids], "id long"))
    asked = spark.range(21000).unionByName(spark.createDataFrame([(2**63 - 1,)], "id long"))
    let = {r.id for r in asked.filter(may("id")).collect()}
    assert set(ids) <= let and (most == 10 or len(let) < len(ids) + 900)
    none = simhash.id_filter(spark.createDataFrame([], "id long"))
    assert asked.filter(none("id")).count() == 0
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a text of its own that nobody else has"), (2, text), (2, text), (3, text + " end"), (None, text), (5, None), (6, "")]
    docs = spark.createDataFrame([(k, t, f"x{i}") for i, (k, t) in enumerate(rows)], "doc_id long, text string, extra string")
    assert sorted((r.doc_id, r.extra) for r in simhash.near_unique(docs).collect()) == [(1, "x0"), (2, "x1"), (2, "x2"), (5, "x5")]
