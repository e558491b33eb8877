"""Each operator on odd rows: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.llm import _text as T
from vecloom.llm import arrow_output, exact_dedup, language_id, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, toxicity
from vecloom.llm._cluster import components, join_groups
from vecloom.llm._tokens import coder, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(7)
SYLLABLES = "an the re on er ti ou ha en st or nd".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


A, B = prose(120, 1), prose(90, 2)
ODD = [
    (1, A, "en", "x", 1),
    (2, A + "\n", "en", "y", 2),
    (3, A.replace(" ", "  ", 3), None, None, 3),
    (4, A + " tail", "en", "x", 4),
    (5, None, "en", "x", None),
    (6, "", None, "y", 0),
    (7, " \n\t ", "de", None, 4),
    (8, B, "de", "x", 5),
    (8, B, "de", "x", 5),
    (9, "word", "de", "z", 4),
    (10, "WORD", "fr", "z", 4),
    (None, B + " more", "de", "x", 1),
    (None, None, None, None, None),
    (11, prose(40_000, 3), "en", "x", 6),
    (12, "é ñ ü 中文 \U0001f600 " * 20, "fr", "y", 7),
    (13, "mail a.b@c.example and +49 (30) 1234-567, 10.0.0.1, 4111 1111 1111 1111, 999.1.1.1", "en", "y", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    for c in ("_label", "kept", "size", "_host", "start", "tied", "n_words", "score", "clean_text", "shard", "target"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts():
    return [(d, t or "") for d, t, *_ in ODD]


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


def brute_components(pairs):
    ids = {d for d, _ in pairs if d is not None}
    sets = {d: shingles(t) for d, t in pairs if d is not None}
    up = {d: d for d in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    want = brute_components(texts())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_duplicates(empty).count() == 0
    stay = near_dedup.drop_near_duplicates(odd)
    assert stay.columns == odd.columns
    ids = [r.doc_id for r in stay.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(d for d, (_, c) in want.items() if d == c) and ids.count(None) == 2


def test_near_duplicates_family_and_chain(spark):
    """A family of edited copies, and a chain whose ends are not alike: components follow all links."""
    r = random.Random(3)
    base = prose(200, 11).split()
    pairs = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = prose(1, r.random())
        pairs.append((i, " ".join(w)))
    w = prose(150, 12).split()
    for i in range(12):
        w = w[8:] + prose(8, 100 + i).split()
        pairs.append((1000 + i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert got == brute_components(pairs)


def test_tensored_banding_uses_few_minhashes():
    sets = np.arange(1, 200, dtype=np.uint64)
    keys = near_dedup.signatures(T.mix(sets), np.array([0, 199]), 3, 16)
    assert keys.shape == (1, 32)  # 96 minhash values make 256 tables of 6


def test_exact_duplicates(odd, empty):
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for d, t in texts():
        groups.setdefault(strip(t), []).append((-len(t), d is None, d or 0, d))
    got = exact_dedup.mark_duplicates(odd).collect()
    assert len(got) == len(ODD)
    keep = {k: min(v)[3] for k, v in groups.items()}
    want = sorted(((d, keep[strip(t)], len(groups[strip(t)]), d == keep[strip(t)], hashlib.sha256(strip(t).encode()).hexdigest()) for d, t in texts()), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == want
    assert exact_dedup.mark_duplicates(empty).count() == 0
    stay = exact_dedup.drop_exact_duplicates(odd)
    assert stay.columns == odd.columns and stay.count() == len(groups)


def brute_measures(t):
    w, lines = WORD.findall(t), t.split("\n")
    wins = list(zip(w, w[1:], w[2:]))
    twice = {x for x in wins if wins.count(x) > 1} if len(wins) < 2000 else None
    if twice is None:
        from collections import Counter

        c = Counter(wins)
        twice = {x for x in wins if c[x] > 1}
    hit = {i + k for i, x in enumerate(wins) if x in twice for k in range(3)}
    full = [x for x in lines if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(hit)


def test_quality_rules_measures(odd, empty):
    got = quality_rules.apply_rules(odd, with_text=False)
    for r in got.collect():
        candidates = [brute_measures(t) for d, t in texts() if d == r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in candidates
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert got.count() == len(ODD)
    assert quality_rules.apply_rules(empty).count() == 0
    assert quality_rules.filter_by_rules(odd).columns == odd.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab #\n\té<"), max_size=6))
def test_measures_match_brute_force(ts):
    data, offsets = T.buffers(pa.array(ts, pa.string()))
    got = list(zip(*(x.tolist() for x in quality_rules._measure(data, offsets))))
    assert got == [brute_measures(t) for t in ts]


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    shared = "this line is shared by all the pages of the host and says nothing new at all to anyone who reads it"
    docs = [(i, f"{prose(60, i)}\n{shared if i % 2 else shared.upper()}\n{prose(20, 500 + i)}", "h", i) for i in range(40)]
    docs += [(100 + i, "\n".join([shared] * 4 + [prose(5, 900 + i)]), "h", i) for i in range(3)]
    docs += [(200 + i, prose(80, 77), "h", i) for i in range(50)]  # exact copies: one document
    docs += [(300, f"{prose(60, 999)}\n{shared}", "other", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars int")
    out = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    assert all(out[i].removed_words == len(shared.split()) and out[i].kept and shared not in out[i].clean_text.lower() for i in range(40))
    assert not any(out[100 + i].kept for i in range(3))
    assert all(out[200 + i].removed_words == 0 and out[200 + i].kept for i in range(50))
    assert out[300].removed_words == 0
    several = quality_rules.Rules(lines_a_pass=1)
    assert rows(quality_rules.apply_rules(df, rules=several).drop("clean_text")) == rows(quality_rules.apply_rules(df).drop("clean_text"))
    joined = quality_rules.Rules(lines_a_pass=1, passes=0)
    assert rows(quality_rules.apply_rules(df, rules=joined)) == rows(quality_rules.apply_rules(df))
    assert rows(quality_rules.apply_rules(df, rules=joined, with_text=False)) == rows(quality_rules.apply_rules(df, with_text=False))
    stage = quality_rules.filter_by_rules(df)
    assert stage.columns == df.columns and stage.count() == 91
    assert all(r.n_chars == len(r.text) for r in stage.filter("doc_id < 40").collect())


def test_distinct_documents_of_shared_lines_are_counted_whatever_the_hashes(spark):
    """In each of 40 hosts 25 documents share two lines and have one of their own: the shared lines go, though they may have the least hash."""
    docs = [(100 * h + i, f"{prose(12, 7000 + h)}\n{prose(12, 8000 + h)}\n{prose(60, 100 * h + i)}", f"h{h}") for h in range(40) for i in range(25)]
    out = quality_rules.apply_rules(spark.createDataFrame(docs, "doc_id long, text string, source string"), with_text=False).collect()
    assert len(out) == 1000 and {r.removed_words for r in out} == {24}


def test_toxicity_grammar():
    plain = toxicity.Lexicon(words={"fool": (1, 4.0, 4.0), "you": (3, 0, 0), "not": (4, 0, 0), "said": (5, 0, 0), "hit": (2, 4.0, 4.0)}).compile()
    c = toxicity.channels(pa.array(["A fool.", "you fool", "not a fool", "he said: x. they said fool", "I hit you", None, ""]), plain)
    # a word's weight times its arcs': bare, negated, reported; one with a target in its clause counts whole
    assert c[0].nonzero()[0].tolist() == [0, 16] and c[1, 1] == 4 and c[4, 9] == 4
    assert np.allclose([c[0, 0], c[2, 4], c[3, 2]], [4 * 0.45, 4 * 0.45 * 0.5, 4 * 0.45 * 0.6])
    assert not c[5:].any()


def test_toxicity_learns_stems_and_scores_held_out():
    r = random.Random(5)
    make = lambda i, bad: " ".join(w + (" zork" + r.choice("abcdef") + "le" if bad and k % 20 == 3 else "") for k, w in enumerate(prose(60, i).split()))
    train = [(make(i, i % 4 == 0), int(i % 4 == 0)) for i in range(200)]
    model = toxicity.fit(train)
    s = model.score(toxicity.channels(pa.array([make(1000 + i, i % 2 == 0) for i in range(60)]), model.lexicon.compile()))
    assert ((s >= 0.7) == (np.arange(60) % 2 == 0)).all()


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(d, int(d % 2)) for d, *_ in ODD if d] + [(None, 1), (99, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd, labels)
    got = toxicity.score_toxicity(odd, model)
    assert got.count() == len(ODD) and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels.filter("false"))).count() == 0


def test_language_id(spark, odd, empty):
    vowels, other = "a e i o u".split(), "k t p z x".split()
    sample = lambda v, i: " ".join("".join(random.Random(i * 99 + k).choice(v) for _ in range(5)) for k in range(30))
    model = language_id.fit([(sample(vowels, i), "v") for i in range(40)] + [(sample(other, 500 + i), "c") for i in range(40)])
    df = spark.createDataFrame([(i, sample(vowels if i % 2 else other, 2000 + i)) for i in range(40)] + [(90, None), (91, "123 …"), (92, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict_language(df, model).collect()}
    assert all(got[i].lang_pred == ("v" if i % 2 else "c") for i in range(40))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (90, 91, 92))
    fitted = language_id.fit_language_id(odd)
    assert language_id.predict_language(odd, fitted).count() == len(ODD)
    assert language_id.predict_language(empty, language_id.fit_language_id(empty)).count() == 0


def test_language_id_whole_text_equals_its_histogram():
    table = np.random.default_rng(1).normal(size=(1 << language_id.BITS, 3))
    ts = ["Ab cé, de", "", "xyz", "a", "ß" * 50]
    mean, _ = language_id._average(pa.array(ts), table)
    assert np.allclose(mean, language_id.histograms(ts) @ table, atol=1e-5)


def test_quality_attention(spark, odd, empty):
    junk = lambda i: " ".join(w.upper() + "!!" for w in prose(150, i).split())
    mixed = [(prose(150, i), 1) for i in range(80)] + [(prose(90, 300 + i) + " " + junk(600 + i), 0) for i in range(80)]
    bags = [quality_classifier.encode(pa.array([t]))[0] for t, _ in mixed]
    model = quality_classifier.fit(bags, [y for _, y in mixed])
    fresh = [(prose(150, 5000 + i), 1) for i in range(30)] + [(prose(90, 6000 + i) + " " + junk(7000 + i), 0) for i in range(30)]
    x, bag = quality_classifier.encode(pa.array([t for t, _ in fresh]))
    s = model.score(x, bag)
    assert ((s >= 0.5) == np.array([y == 1 for _, y in fresh])).mean() > 0.95
    assert quality_classifier.score_quality(odd, model).filter("score between 0 and 1").count() == len(ODD)
    assert quality_classifier.score_quality(empty, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.score_quality(odd, quality_classifier.fit_quality(odd, labels)).count() == len(ODD)


def test_attention_weights():
    """Bags of one and of several passages go through one pass with weights that sum to 1 in each bag."""
    rng = np.random.default_rng(0)
    model = quality_classifier.fit([rng.normal(size=(n, quality_classifier.FEATURES)) for n in (1, 3, 2, 5)], [0, 1, 0, 1], epochs=3)
    *_, weight, _, p = model.forward(rng.normal(size=(6, quality_classifier.FEATURES)), np.array([0, 1, 6]))
    assert np.allclose(np.add.reduceat(weight, [0, 1]), 1) and ((p > 0) & (p < 1)).all()


def plain_attention(model, x):
    """The score of one bag, passage by passage, in plain Python."""
    import math

    w = {k: v.tolist() for k, v in model.w.items()}
    hidden, scores = [], []
    for row in ((x - model.mean) / model.scale).tolist():
        h = [math.tanh(sum(a * w["H"][i][k] for i, a in enumerate(row)) + w["h"][k]) for k in range(len(w["h"]))]
        gate = lambda m, k: sum(a * w[m][i][k] for i, a in enumerate(h))  # noqa: B023, E731
        scores.append(sum(math.tanh(gate("V", k)) / (1 + math.exp(-gate("U", k))) * a for k, a in enumerate(w["a"])))
        hidden.append(h)
    e = [math.exp(s - max(scores)) for s in scores]
    pooled = [sum(a * h[k] for a, h in zip(e, hidden)) / sum(e) for k in range(len(w["h"]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(pooled, w["o"])) + w["c"])))


def test_attention_matches_a_plain_twin_and_its_gradient_the_differences():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, quality_classifier.FEATURES)) for n in (1, 3, 2, 5)]
    model = quality_classifier.fit(bags, [0, 1, 0, 1], epochs=2)
    x, bag = np.concatenate(bags), np.array([0, 1, 4, 6, 11])
    assert np.allclose(model.score(x, bag), [plain_attention(model, b) for b in bags])
    y, importance = np.array([0.0, 1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5, 1.0])

    def loss():
        p = model.score(x, bag)
        return float(-(importance * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    g = model.gradient(x, bag, y, importance)
    for name, at in (("H", (3, 2)), ("h", (1,)), ("V", (2, 1)), ("U", (5, 3)), ("a", (4,)), ("o", (7,))):
        was, step = model.w[name][at], 1e-5
        model.w[name][at] = was + step
        above = loss()
        model.w[name][at] = was - step
        below = loss()
        model.w[name][at] = was
        assert np.isclose(g[name][at], (above - below) / (2 * step), rtol=1e-4, atol=1e-8)


def plain_language(model, t):
    """The likeliest language and its probability, subword by subword, in plain Python."""
    raw = t.lower().encode()
    folded = [b if b >= 128 or 97 <= b <= 122 else 32 for b in raw]
    vectors = []
    for k in range(2, 5):
        for i in range(len(raw) - k + 1):
            if folded[i] != 32 or (i + 1 < len(raw) and folded[i + 1] != 32):
                code = 0
                for b in folded[i : i + k]:
                    code = (code << 8 | b) & 0xFFFFFFFF
                vectors.append(model.embedding[((code * (2654435761 + 2 * (k - 1))) & 0xFFFFFFFF) >> (32 - language_id.BITS)])
    mean = np.mean(vectors, 0) if vectors else np.zeros(language_id.DIMS)
    z = (mean @ model.output + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.languages[int(p.argmax())], float(p.max())


def test_language_prediction_matches_a_plain_twin():
    rows_ = [(prose(30, i), "en") for i in range(20)] + [(prose(30, 100 + i).upper().replace("A", "Ä"), "de") for i in range(20)] + [("x", "fr")]
    model = language_id.fit(rows_)
    ts = [t for t, _ in rows_[::5]] + ["ä", "é à la", "A"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ts))), pa.array(ts)], ["doc_id", "text"])
    for b in language_id._predict(model)(iter([batch])):
        for t, lang, score in zip(ts, b.column("lang_pred").to_pylist(), b.column("score").to_pylist()):
            want, p = plain_language(model, t)
            assert lang == want and abs(score - p) < 1e-4


def test_encoding_is_by_text_alone():
    ts = ["", " x y", "A!! b", "  ", prose(200, 4)]
    x, bag = quality_classifier.encode(pa.array(ts))
    for i, t in enumerate(ts):
        assert np.allclose(x[bag[i] : bag[i + 1]], quality_classifier.encode(pa.array([t]))[0])


def brute_sainte_lague(votes, seats):
    out = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * out[k] + 1), -k))
        out[i] += 1
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8), st.integers(0, 60))
def test_sainte_lague(votes, seats):
    from fractions import Fraction

    assert mixing.sainte_lague(votes, seats) == brute_sainte_lague([Fraction(v) for v in votes], seats)


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    capped = mixing.targets([10, 1000, 1000], [3, 1, 1])
    assert capped[0] == 30 and sum(capped) == pytest.approx(2010)
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [1, 2]) == [0, 5]


def test_mix(spark, odd, empty):
    got = mixing.plan_mix(odd, block=4).collect()
    assert sorted((r.size for r in got)) == sorted(len(WORD.findall(t)) for _, t in texts())
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for s, rs in by.items():
        assert sum(r.size for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 12
    assert [tuple(r) for r in sorted(mixing.plan_mix(odd, block=4).collect(), key=repr)] == [tuple(r) for r in sorted(got, key=repr)]
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(odd, block=4)
    assert mixed.columns == odd.columns
    want, have = {}, {}
    for r in got:
        want[r.source] = want.get(r.source, 0) + r.taken
    for r in mixed.collect():
        have[r.source] = have.get(r.source, 0) + len(WORD.findall(r.text or ""))
    assert {k: v for k, v in want.items() if v} == have
    small = mixing.plan_mix(spark.createDataFrame([(i, prose(30, i), "hot") for i in range(50)], "doc_id long, text string, source string"), shard_docs=7, block=16)
    assert small.agg(F.sum("taken")).first()[0] == pytest.approx(1500, abs=16 * 9)


def direct_ids(name, ts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return [e.ids + [end] for e in t.encode_batch(ts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(odd, empty):
    got = packing.pack(odd).collect()
    ids = dict(zip([d for d, _ in texts()], direct_ids("byte_bpe_50k.json", [t for _, t in texts()], 0)))
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 and len(r.ids) == r.length and r.ids_crc32 == crc(r.ids) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for d in (1, 5, 6, 7, 11, 12, 13):
        pieces = sorted(by[d], key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == ids[d] and {r.doc_tokens for r in pieces} == {len(ids[d])}
    assert len(by[8]) == 2 * len({r.start for r in by[8]})
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, max_len=1000)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=5))
def test_binary_pieces(ns):
    doc, start, length = packing.binary_pieces(np.array(ns), 64)
    for i, n in enumerate(ns):
        at = doc == i
        assert length[at].sum() == n and (start[at] == np.cumsum(length[at]) - length[at]).all()
        assert all(x <= 64 and x & (x - 1) == 0 for x in length[at].tolist())
        assert (length[at] < 64).sum() == bin(n % 64).count("1")


def test_arrow_output(spark, odd, empty, tmp_path):
    manifest = arrow_output.write_sequences(odd, f"file://{tmp_path}/seq", length=8)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in arrow_output.read_documents(manifest).collect()))
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for (d, *_), ids in zip(ordered, direct_ids("word_bpe_49k.json", [r[1] or "" for r in ordered], 2)):
        want.append((at, d, len(ids), crc(ids)))
        at += len(ids)
    assert [x[0] for x in got] == [x[0] for x in want] and got == want
    path = manifest.filter("tokens > 20").first()["path"]
    s = arrow_output.Sequences(path)
    ids, mask = s.sequence(0)
    assert len(ids) == 8 and mask.all() and (ids == s.ids(0, 8)).all() and not ids.flags.owndata
    assert arrow_output.round_trip(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(" \n\t\r\x1c\x85\xa0 aBz1'~s<|>.é́中!"), max_size=5))
def test_word_cache_gives_the_library_s_ids(ts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        c = coder(vocabulary(name))
        assert c.encode(ts) == c._encode(ts)


def brute_spans(t):
    luhn = lambda d: sum((v - 9 if v > 9 else v) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    only = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(only(s)) <= 19 and luhn(only(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(only(s)) <= 15),
    ]
    return [[m.span() for m in re.finditer(p, t) if ok(m.group())] for p, ok in kinds]


@settings(max_examples=300, deadline=None)
@given(st.text("a.@-+%0123456789 ()é\n", max_size=60))
def test_patterns_match_brute_force(t):
    assert pii.base_spans(t) == brute_spans(t)


def test_pii_odd_rows(odd, empty):
    got = pii.find_personal_data(odd, replace={"email": "<email>"})
    for r in got.collect():
        options = [brute_spans(t) for d, t in texts() if d == r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] in [[len(k) for k in o] for o in options]
        assert r.base_sha256 in [hashlib.sha256(pii._format(o).encode()).hexdigest() for o in options]
    text = {r.doc_id: r.clean_text for r in got.collect()}
    assert text[13].startswith("mail <email> and ") and "4111" not in text[13] and "999.1.1.1" in text[13] and text[5] is None
    assert pii.find_personal_data(empty).count() == 0
    long = "a" * 300_000 + "@" + "1" * 300_000
    assert pii.base_spans(long) == [[], [], [], []]


def test_disclosing_terms(spark):
    docs = [(i, f"{prose(30, i)} write to Quillhart quillhart@mail.example soon {prose(20, 90 + i)} the end") for i in range(8)]
    docs += [(100 + i, f"{prose(40, 300 + i)} the end") for i in range(200)]
    docs += [(400, "we met Quillhart there")] + [(500 + i, docs[0][1]) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(df, pii.Rules(min_bits=4.0)).collect()}
    assert "term:7:16" in got[400] and "term" in got[3] and "term" not in got[150]
    one = pii.Rules(min_bits=4.0, terms_a_pass=1)
    assert {r.doc_id: r.spans for r in pii.find_personal_data(df, one).collect()} == got


@pytest.mark.parametrize("local", [0, 200_000])
def test_components_and_hot_groups(spark, monkeypatch, local):
    from vecloom.llm import _cluster

    monkeypatch.setattr(_cluster, "LOCAL_EDGES", local)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(200, 201), (201, 200)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 1 for i in range(1, 60)) and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("local", [0, 200_000])
def test_components_of_a_long_chain(spark, monkeypatch, local):
    """Chains of 1,000 and 999 links whose ids are in random order, and a star: one label each, the smallest id."""
    from vecloom.llm import _cluster

    monkeypatch.setattr(_cluster, "LOCAL_EDGES", local)
    ids = list(range(5000, 7001))
    random.Random(5).shuffle(ids)
    one, other = ids[:1001], ids[1001:]
    edges = [*zip(one, one[1:]), *zip(other, other[1:]), *((90, k) for k in (7, 300, 8, 1000))]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {i: min(c) for c in (one, other, [7, 8, 90, 300, 1000]) for i in c}


def test_join_groups_beyond_the_broadcast_limit(spark, monkeypatch):
    from vecloom.llm import _cluster

    monkeypatch.setattr(_cluster, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(_cluster, "HOT_SHARE", 0.3)
    left = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = left.groupBy("k").agg(F.count("*").alias("n"))
    out = join_groups(left, groups, ["k"], "n", 5000, "id")
    assert out.count() == 5000 and out.filter("k = 0 and n = 3000").count() == 3000


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    from vecloom.llm import _cluster

    monkeypatch.setattr(_cluster, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(near_dedup, "GROUP_SHINGLES", 100)  # many homes, so pairs meet in cells of two
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 2)
    monkeypatch.setattr(_cluster, "LOCAL_EDGES", 0)
    pairs = [(i, prose(60, i % 5) + (" x" if i % 2 else "")) for i in range(20)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert got == brute_components(pairs)


def thue_morse(n, a="a", b="b"):
    """Two words of n letters on which a polynomial hash modulo 2**64 agrees, whatever its multiplier, from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_hashes_and_ids_of_words_that_collide_in_polynomials(n):
    x, y = thue_morse(n)
    assert len({T.hash_of(x), T.hash_of(y), T.hash_of(x, fold=True), T.hash_of(y.upper())}) == 3 + (T.hash_of(x) != T.hash_of(x, fold=True))
    assert T.hash_of(x.upper(), fold=True) == T.hash_of(x, fold=True) == T.hash_of(x)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        c = coder(vocabulary(name))
        got = [np.frombuffer(b, c.dtype).tolist() for b in c.encode([f"some {x} here", f"some {y} here", x, y])]
        assert got == [e.ids for e in c.tokenizer.encode_batch([f"some {x} here", f"some {y} here", x, y], add_special_tokens=False)]
    data, offsets = T.buffers(pa.array([x, y]))
    sets, bounds = near_dedup.shingle_sets(data, offsets)
    assert bounds.tolist() == [0, 1, 2] and sets[0] != sets[1]
    runs = T.mix(np.array([5, 6], np.uint64))[[int(c == "b") for c in x + y]]
    h = T.sequence_hash(runs, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]


def test_near_duplicates_with_one_doc_id_for_two_texts(spark):
    """The rows of a doc_id are one vertex with the links of both texts; a row without words stands alone."""
    a, b = prose(80, 31), prose(80, 32)
    docs = [(1, a), (2, a + " x"), (2, b), (3, b + " y"), (4, prose(70, 33)), (3, "")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert [(d, c) for d, n, c in got if n] == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]
    assert [(d, c) for d, n, c in got if not n] == [(3, 3)]
    stay = near_dedup.drop_near_duplicates(spark.createDataFrame([(5, "b b b", "x"), (5, "a a", "y"), (5, None, "z"), (None, "c", "w")], "doc_id long, text string, kept string"))
    assert rows(stay) == sorted([(5, None, "z"), (None, "c", "w")], key=repr)


def test_texts_longer_than_a_block(spark):
    """A text of several blocks is handled whole by every operator."""
    long = prose(200_000, 41)
    assert len(long) > 2 * T.BLOCK
    df = spark.createDataFrame([(1, long + " a.b@c.example", "en", "x"), (2, long + " tail", "en", "x"), (3, B, "en", "y")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    c = coder(vocabulary("byte_bpe_50k.json"))
    ids = [*c.tokenizer.encode(long + " tail", add_special_tokens=False).ids, 0]
    pieces = packing.pack(df).filter("doc_id = 2").orderBy("start").collect()
    assert [i for p in pieces for i in p.ids] == ids
    (found,) = pii.find_personal_data(df).filter("doc_id = 1").collect()
    assert found.n_email == 1 and found.spans.startswith(f"email:{len(long) + 1}:")
    n = len(WORD.findall(long))
    assert {r.doc_id: r.n_words for r in quality_rules.apply_rules(df, with_text=False).collect()} == {1: n + 1, 2: n + 1, 3: len(WORD.findall(B))}
    assert [r.score for r in toxicity.score_toxicity(df, toxicity.fit([])).collect()] and quality_classifier.score_quality(df, quality_classifier.fit([], [])).count() == 3
    assert {r.doc_id: r.n_tokens for r in arrow_output.round_trip(df).collect()}[2] == len(coder(vocabulary("word_bpe_49k.json")).tokenizer.encode(long + " tail", add_special_tokens=False).ids) + 1


def test_words_outside_a_clause_score_lower_than_in_one():
    """The same words, in one clause with their target and apart from it; negation and report soften."""
    model = toxicity.fit([])
    texts = ["you idiot", "idiot. you", "you are no idiot", "they said you idiot", "they will kill you", "kill. you"]
    together, apart, negated, reported, threat, no_threat = model.score(toxicity.channels(pa.array(texts), model.lexicon.compile())).tolist()
    assert together > 0.7 > 0.5 > apart and negated < together and reported < together and threat > 0.7 > 0.1 > no_threat
    assert toxicity.GRAMMAR.flag.shape == (len(toxicity.GRAMMAR.step), 12)
    # a target after the word is seen by the backward machine
    after = model.score(toxicity.channels(pa.array(["idiot you"]), model.lexicon.compile()))[0]
    assert after == together


def brute_terms(t):
    """(start, end, folded) of the runs of letters of three bytes or more, in code points."""
    found = [(m.start(), m.end(), m.group().translate({c: c + 32 for c in range(65, 91)})) for m in re.finditer(r"[A-Za-z\x80-\U0010ffff]+", t)]
    return [x for x in found if len(x[2].encode()) >= 3]


def brute_disclosing(ts, rules):
    near, hold = {}, {}
    for t in set(ts):
        terms = brute_terms(t)
        for s, e, w in terms:
            hold.setdefault(w, set()).add(t)
        for a, z in (s for kind in pii.base_spans(t) for s in kind):
            entity = t[a:z].lower()
            near.setdefault((entity, None), set()).add(t)
            before = [w for s, e, w in terms if e <= a][-rules.reach :]
            after = [w for s, e, w in terms if s >= z][: rules.reach]
            for w in before + after:
                near.setdefault((entity, w), set()).add(t)
    out = set()
    for (entity, w), held in near.items():
        if w is not None and len(held) >= rules.min_texts:
            share = len(held) / len(hold[w])
            if share >= rules.min_share and np.log2(share * len(set(ts)) / len(near[entity, None])) >= rules.min_bits:
                out.add(w)
    return out


def test_disclosing_terms_match_brute_force(spark):
    r = random.Random(8)
    rules = pii.Rules(min_texts=3, min_bits=2.0, min_share=0.7, reach=3)
    names = ["Quirin", "Zoltan", "Müller", "Ortega"]
    ts = []
    for i in range(160):
        w = prose(r.randint(4, 12), 3000 + i).split()
        if i % 4 == 0:
            k = r.randrange(4)
            w[2:2] = [names[k], f"{'abcd'[k]}@mail.example"]
        elif i % 7 == 0:
            w.insert(1, names[r.randrange(2)])
        ts.append(" ".join(w))
    ts += ts[:20] + [None, ""]
    want = brute_disclosing([t or "" for t in ts], rules)
    assert want
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    joined = pii.Rules(min_texts=3, min_bits=2.0, min_share=0.7, reach=3, terms_a_pass=1, passes=0)
    assert rows(pii.find_personal_data(df, joined)) == rows(pii.find_personal_data(df, rules))
    for x in pii.find_personal_data(df, rules).collect():
        t = ts[x.doc_id] or ""
        covered = [s for kind in pii.base_spans(t) for s in kind]
        terms = [(a, z) for a, z, w in brute_terms(t) if w in want and not any(p < z and a < q for p, q in covered)]
        assert [s for s in x.spans.split(",") if s.startswith("term")] == [f"term:{a}:{z}" for a, z in terms]


def test_address_parts_of_any_length():
    for zeros in (0, 1, 300, 5000):
        t = f"x {'0' * zeros}1.2.{'0' * zeros}255.4 y"
        assert pii.base_spans(t)[1] == [(2, len(t) - 2)]
        assert pii.base_spans(f"{'0' * zeros}256.1.1.1")[1] == [] and pii.base_spans(f"{'9' * (zeros + 4)}.1.1.1")[1] == []


def test_language_calibration_at_any_number_of_rows():
    make = lambda lang, i: " ".join(random.Random(f"{lang}{i}").choice({"aa": ["papa", "lala", "tata"], "zz": ["xyxy", "vuvu", "wywy"]}[lang]) for _ in range(12))
    for n in (1, 4, 5, 40):
        rows_ = [(make(lang, i), lang) for lang in ("aa", "zz") for i in range(n)]
        model = language_id.fit(rows_)
        assert model.languages == ["aa", "zz"] and 0 < model.threshold <= 0.9
        assert (model.temperature == 1.0) == (n < 5)


def test_one_shared_line_counts_every_distinct_document(spark):
    """100 documents share a line and nothing else: it is counted 100 times for any line, and at hosts of any size."""
    docs = [(100 * k + i, f"{prose(60, 7000 + 100 * k + i)}\n{prose(12, 9000 + k)}", "h") for k in range(12) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for limit, n in ((100, 12), (101, 0)):
        assert quality_rules.frequent_lines(df, "source", quality_rules.Rules(min_docs=limit)).count() == n


def test_drop_exact_duplicates_decides_by_row(spark):
    """Equal texts under one doc_id, ties, a doc_id with two texts of one length and prefix, and rows without doc_id."""
    long = "p" * 80
    docs = [(1, "a b", "x"), (1, "ab", "y"), (2, "a b", "z"), (3, long + "u", "k"), (3, long + "v", "l"), (4, long + "u ", "m"), (None, "q", "n"), (None, "q", "o"), (None, None, "r"), (5, "", "s"), (6, "c", "t"), (6, "c", "u")]
    got = exact_dedup.drop_exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string, tied string"))
    assert rows(got) == sorted([(1, "a b", "x"), (3, long + "v", "l"), (4, long + "u ", "m"), (None, "q", "n"), (5, "", "s"), (6, "c", "t")], key=repr) or {r[:2] for r in rows(got)} == {(1, "a b"), (3, long + "v"), (4, long + "u "), (None, "q"), (5, ""), (6, "c")}


def test_mix_takes_each_source_near_its_target(spark):
    docs = [(s * 1000 + i, prose(random.Random(s * 1000 + i).randint(0, 90), s * 1000 + i), "abcd"[s] if s < 4 else None) for s, n in enumerate((300, 40, 120, 5, 60)) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    size = {}
    for _, t, s in docs:
        size[s] = size.get(s, 0) + len(WORD.findall(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([size[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    source = {d: s for d, _, s in docs}
    taken = {}
    for r in mixing.plan_mix(df, shard_docs=50).collect():
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size
    for s in order:
        shards = -(-sum(1 for x in source.values() if x == s) // 50)
        assert abs(taken[s] - want[s]) <= mixing.BLOCK * (shards + 1)


def test_pipeline_on_odd_rows(spark, odd, empty, tmp_path):
    """Nulls, empty, blank and long texts, repeated rows and clashing columns go through all stages; so does an empty table."""
    import corpus_pipeline

    docs = odd
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.count() or i == len(corpus_pipeline.STAGES)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} <= {d for d, *_ in ODD}
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), max_size=20))
def test_local_components(pairs):
    from vecloom.llm._cluster import _local_components

    both = [(a, b) for a, b in pairs if a != b] + [(b, a) for a, b in pairs if a != b]
    ids, comps = _local_components(pa.table({"a": pa.array([a for a, _ in both], pa.int64()), "b": pa.array([b for _, b in both], pa.int64())}))
    up = {a: a for a, _ in both}
    for _ in up:
        for a, b in both:
            up[a] = up[b] = min(up[a], up[b])
    assert dict(zip(ids.tolist(), comps.tolist())) == up
