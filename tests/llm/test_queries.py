"""The registered queries against brute force or held-out labels, over whole tables."""

import hashlib
import os
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from vecloom.llm import queries as Q
from vecloom.llm._tokens import vocabulary

from .test_operators import B, brute_components, brute_measures, brute_spans, crc, direct_ids, prose

SF = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def table(sf, name):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet' ORDER BY 1").fetchall()


def test_token_output(spark):
    docs = table(SF, "documents")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op3_arrow_sequences(spark, SF).collect()}
    at, want = 0, {}
    for (d, *_), ids in zip(docs, direct_ids("word_bpe_49k.json", [r[1] or "" for r in docs], 2)):
        want[d] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def test_packing(spark):
    docs = table(SF, "documents")
    ids = dict(zip([r[0] for r in docs], direct_ids("byte_bpe_50k.json", [r[1] or "" for r in docs], 0)))
    got = Q.op9_binary_packing(spark, SF).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    seen = {d: 0 for d in ids}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.offset == 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
    assert seen == {d: len(x) for d, x in ids.items()}


def test_personal_data(spark):
    got = {r.doc_id: r for r in Q.op10_pii_disclosure(spark, LABELLED).collect()}
    for d, t, *_ in table(LABELLED, "documents"):
        spans = brute_spans(t or "")
        base = ",".join(f"{k}:{a}:{z}" for k, found in zip(("email", "ip", "card", "phone"), spans) for a, z in found)
        r = got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in spans]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)


def test_mixing(spark):
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in table(LABELLED, "documents")}
    got = Q.op8_sainte_lague_mix(spark, LABELLED).collect()
    assert {r.doc_id: r.size for r in got} == sizes and all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault((r.target, r.source_size), []).append(r.taken)
    assert abs(sum(r.taken for r in got) - sum(sizes.values())) < 0.01 * sum(sizes.values())
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in Q.op8_sainte_lague_mix(spark, LABELLED).collect())


def test_held_out_accuracy(spark):
    labels = {d: (q, t) for d, q, t in table(LABELLED, "labels")}
    langs = {r[0]: r[2] for r in table(LABELLED, "documents")}
    ids = set(langs)
    toxic = Q.op1_toxicity_grammar(spark, LABELLED).collect()
    assert {r.doc_id for r in toxic} == ids and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in toxic)
    held = [(r.predicted, labels[r.doc_id][1]) for r in toxic if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) >= 0.94 and sum(p > y for p, y in held) <= 1
    caught = sum(p and y for p, y in held)
    assert caught >= 0.75 * sum(y for _, y in held) and caught >= 0.95 * sum(p for p, _ in held)  # recall and precision
    quality = Q.op7_quality_attention(spark, LABELLED).collect()
    held = [(r.predicted, labels[r.doc_id][0]) for r in quality if r.held_out and r.doc_id in labels]
    assert {r.doc_id for r in quality} == ids and np.mean([p == y for p, y in held]) >= 0.95
    found = Q.op2_language_id(spark, LABELLED).collect()
    held = [r.lang_pred == langs[r.doc_id] for r in found if r.held_out and langs[r.doc_id]]
    assert {r.doc_id for r in found} == ids and np.mean(held) >= 0.98


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    texts = [(i, prose(120, i)) for i in range(24)]
    texts += [(30, prose(120, 3).replace(" ", "  ", 5)), (31, prose(120, 4) + " tail"), (32, prose(10, 99)), (33, None), (34, "spam spam spam " * 40), (35, B), (36, B)]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for i, t in texts:
        n, *_, repeated = brute_measures(t or "")
        if n >= 50 and 100 * repeated <= 50 * n:
            kept[i] = t
    by = {}
    for i, t in kept.items():
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    kept = {min(v)[1]: kept[min(v)[1]] for v in by.values()}
    comp = brute_components(list(kept.items()))
    kept = {i: t for i, t in kept.items() if comp[i][1] == i}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
    assert {r.doc_id: r.text for r in docs.collect()} == kept
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    got = mixed.collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    for r in got:
        assert words(r.text) == words(kept[r.doc_id])[: len(words(r.text))]
    assert abs(sum(len(words(r.text)) for r in got) - sum(len(words(t)) for t in kept.values())) <= 3 * 128
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = sorted(tuple(ids) for ids in direct_ids("byte_bpe_50k.json", [r.text for r in got], 0))
    whole, part = [], []
    for r in sorted(packed, key=lambda r: r.sequence_id):
        assert len(r.ids) == r.length and r.length & (r.length - 1) == 0
        (whole if r.start == 0 else part).append(r)
    assert sum(r.length for r in packed) == sum(map(len, want)) and len(whole) == len(want)
    assert Path(vocabulary("byte_bpe_50k.json")).exists()
