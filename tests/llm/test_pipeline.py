"""The pipeline's stages against brute force, on the driver's smallest tables."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
from hazeframe.llm import _common as C
from hazeframe.llm import decontamination, registry, simhash, toxicity

from .test_text_operators import brute_lines

DATA = "/root/testdata/sf0.001"


def test_stages_follow_brute_force(spark):
    before = C.table(spark, DATA, "documents")
    columns, after = before.columns, {}
    for name, stage in P.STAGES:
        after[name] = C.stored(stage(spark, before, DATA), name)
        rows = {r.doc_id: r for r in before.collect()}
        out = after[name].collect()
        kept = {r.doc_id for r in out}
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in C.table(spark, DATA, "labels").collect()}
            model = toxicity.fit(before, C.table(spark, DATA, "labels"), C.fold(4) != 2)
            assert kept == {k for k, r in rows.items() if toxicity.score((r.text or "").encode(), model) < 0.3}
            clean = [k for k, t in labels.items() if t == 0]
            assert len([k for k in clean if k in kept]) >= 0.9 * len(clean)
        elif name == "line_dedup":
            want = brute_lines([(k, r.text) for k, r in rows.items()])
            assert {r.doc_id: r.text for r in out} == {k: v[2] for k, v in want.items()}
            assert all(r.n_chars == len(r.text) for r in out)
        elif name == "simhash_near_dedup":
            sets = {k: set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for k, r in rows.items()}
            holders = defaultdict(list)
            for k, own in sorted(sets.items()):
                for h in own:
                    holders[h].append(k)
            shared = Counter((a, b) for ks in holders.values() for i, b in enumerate(ks) for a in ks[:i])
            alike = {pair: n / len(sets[pair[0]] | sets[pair[1]]) for pair, n in shared.items()}
            gone = set(rows) - kept
            assert gone >= {b for (a, b), j in alike.items() if j >= 0.9}
            assert all(any(j >= 0.7 for (x, y), j in alike.items() if k in (x, y)) or not sets[k] for k in gone)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in C.table(spark, DATA, "benchmark").collect()]
            matcher = decontamination.Matcher(items)
            assert kept == {k for k, r in rows.items() if not matcher.find(r.text or "")}
            assert not any(decontamination.normalised(t) in decontamination.normalised(r.text or "") for r in out for _, t in items)
        else:
            assert kept == set(rows)
            fill = Counter()
            for r in out:
                fill[r.sequence_id] += r.length
            assert max(fill.values()) <= 2048
        if name != P.STAGES[-1][0]:
            assert after[name].columns == columns
            before = after[name]


def test_stages_take_nulls_ties_empty_tables_and_columns_of_any_name(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, toxicity string, n_lines string, drops string, node string"
    texts = [None, "", "a line that is long enough\nshort", "A LINE that is long enough \nother", " ".join(f"w{k}" for k in range(5000)), "same text of some words here", "same text of some words here"]
    rows = [(k, t, None, None, None, *["mine"] * 6) for k, t in enumerate(texts)] + [(3, texts[3], None, None, None, *["mine"] * 6), (None, "text of no id, long enough", None, None, None, *["mine"] * 6)]
    docs = spark.createDataFrame(rows, names)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        own = out.collect()
        assert all(r["row"] == r["drops"] == r["node"] == "mine" for r in own), name
        if name == "simhash_near_dedup":
            assert sorted(r.doc_id if r.doc_id is not None else -1 for r in own) == [-1, 0, 2, 3, 3, 4, 5]
        elif name == "line_dedup":
            assert len(own) == len(rows) and {r.text for r in own if r.doc_id == 3} == {"other"} and [r.text for r in own if r.doc_id == 0] == [None]
        elif name == "decontamination":
            assert len(own) == len(rows)
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    packed = P.STAGES[-1][1](spark, docs, DATA).collect()
    assert len({r.doc_id for r in packed}) == 8 and P.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0


def test_registered_queries_return_their_contracts(spark):
    contracts = {
        "op1": "doc_id n_bytes n_tokens over_limit", "op2": "doc_id fingerprint component_id", "op3": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op4": "doc_id n_bytes n_removed n_spans kept_sha256", "op5": "doc_id held_out lang_pred score", "op6": "doc_id held_out score predicted", "op8": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op9": "doc_id n_lines n_dropped kept_sha256", "op10": "doc_id piece start length ids_crc32 sequence_id offset",
    }
    ids = {r.doc_id for r in C.table(spark, DATA, "documents").collect()}
    for name, query in registry.QUERIES.items():
        rows = query(spark, DATA).toPandas()
        assert set(contracts.get(name.split("_")[0], "doc_id item_id").split()) <= set(rows.columns), name
        if not name.startswith("op7"):
            assert set(rows["doc_id"]) == ids, name
        if "held_out" in rows:
            modulus, rest = (5, 1) if name.startswith("op8") else (4, 2)
            assert (rows["held_out"] == rows["doc_id"].map(lambda k: zlib.crc32(str(k).encode()) % modulus == rest)).all()  # noqa: B023
