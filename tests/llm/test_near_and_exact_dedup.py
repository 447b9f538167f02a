import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from conftest import rows_of
from fixtures import SCHEMA, awkward, frame, plain_near, plain_repeats, reachable, words

import corpus_pipeline
from orbitflow.llm import common, embed_dedup, minhash, queries, suffix_dedup
from orbitflow.llm.common import Scratch
from orbitflow.llm.components import components


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_minhash_equals_all_pairs(spark):
    rows = awkward()
    assert sorted_rows(minhash.classes(frame(spark, rows))) == plain_near(rows)
    assert minhash.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_minhash_blocks_lose_no_link(spark, monkeypatch):
    """Chains and a star, with blocks of a few members."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(1)
    base = words(rng, 120, "abcdefghijklmnop").split()
    rows, chain = [], list(base)
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 14)):
            own[rng.randrange(120)] = f"y{rng.randrange(999)}"
        rows.append((i, " ".join(own)))
        chain[(7 * i) % 120] = f"z{i}"
        rows.append((1000 + i, " ".join(chain)))
    assert sorted_rows(minhash.classes(frame(spark, rows))) == plain_near(rows)


@pytest.mark.parametrize("block", [1024, 7])
def test_pipeline_links_from_four_fifths_on(spark, monkeypatch, block):
    """Pairs on both sides of 0.80, most of them under the 0.85 of the query, and a group that is compared in blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(2)
    rows = []
    for i in range(60):
        base = words(rng, 204, "abcdefghijklmnop").split()
        own = list(base)
        for k in range(i % 12):
            own[10 + 17 * k] = f"y{i}"
        rows += [(i, " ".join(base)), (1000 + i, " ".join(own))]
    base = words(rng, 120, "abcdefghijklmnop").split()
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(120)] = f"x{rng.randrange(999)}"
        rows.append((2000 + i, " ".join(own)))
    want = plain_near(rows, 80)
    assert sorted_rows(minhash.classes(frame(spark, rows), least=80)) == want
    stage = corpus_pipeline.distinct(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in stage.collect()) == sorted(i for i, _, _, kept in want if kept)
    assert sum(kept for *_, kept in want) < sum(kept for *_, kept in plain_near(rows, 85))


def test_lower_thresholds_take_longer_sketches():
    assert (minhash.bins_for(85), minhash.estimate_for(85)) == (128, 0.60) and (minhash.bins_for(80), minhash.estimate_for(80)) == (180, 0.57)
    assert minhash.bins_for(100) == 128
    for least in (0, 101, 60):
        with pytest.raises(ValueError):
            minhash.bins_for(least)


def test_sketch_fills_every_coordinate():
    for n in (1, 2, 30, 5000):
        s = minhash.sketch(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        assert (s != np.iinfo(np.uint64).max).all()
    a, b = (np.arange(x, x + 1000).astype(np.uint64) for x in (0, 50))
    agree = np.mean(minhash.sketch(a) == minhash.sketch(b))
    assert abs(agree - 950 / 1050) < 0.12


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50, 90)] + [(7, 100 + i) for i in range(200)] + [(7, 90), (300, 300), (301, 302), (302, 301)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()))
    want = reachable({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if n != 300}


def test_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    part = [words(rng, 300) for _ in range(4)]
    rows = awkward() + [(500, part[0] + part[1]), (501, "é" + part[1] + part[2]), (502, part[3][:399]), (503, part[3][:400] + "ü" + part[3][:400]), (504, "a" * 900), (505, "ab" * 401), (506, part[2][5:] + part[0][:-3])]
    assert repeats(frame(spark, rows)) == sorted(plain_repeats(rows), key=repr)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def repeats(df, **options):
    got = suffix_dedup.remove_repeats(df, **options)
    return sorted([(r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got.collect()], key=repr)


@pytest.mark.parametrize("shared", [250, 80, 130])
def test_repeats_where_one_place_is_crowded(spark, monkeypatch, shared):
    """The same stretch, long enough or too short, before ever different neighbours takes the path of crowded places."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 3)
    rng = random.Random(4)
    middle, side = words(rng, shared), words(rng, 60)
    rows = [(i, words(rng, 100) + middle + words(rng, 100)) for i in range(12)] + [(50, middle[:500]), (51, middle[100:])]
    rows += [(60 + i, words(rng, 30) + side[-20 * i :] + middle + side[: 15 * i] + words(rng, 30)) for i in range(9)] + [(80, rows[3][1])]
    assert repeats(frame(spark, rows), batches=3) == sorted(plain_repeats(rows), key=repr)


def test_crowded_windows_go_as_runs():
    raw = words(random.Random(5), 300).encode()[:671]
    own = pd.DataFrame({"doc_id": [1, 2, 3], "h": 0, "place": [271, 371, 271], "first": [0, 100, 0], "last": [271, 371, 271], "raw": [raw] * 3, "r": [400, 400, 390], "l": [271, 271, 100]})
    got = pd.concat(suffix_dedup._run_rows([own]))
    assert got.groupby("doc_id")["n"].agg(["size", "sum"]).values.tolist() == [[17, 272], [17, 272], [5 + 5 + 6, 91]]
    assert got[got.doc_id == 1].w.tolist() == got[got.doc_id == 2].w.tolist() and set(got[(got.doc_id == 3) & (got.n > 1)].w) < set(got.w[got.doc_id == 1])
    one = pd.concat(suffix_dedup._single_rows([got[got.doc_id == 1]]))
    assert one.start.tolist() == list(range(272)) and set(got[(got.doc_id == 3) & (got.n == 1)].w) < set(one.w)


def test_repeats_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    part = [words(rng, 200, "abé") for _ in range(5)]
    rows = awkward() + [(600 + i, words(rng, 20) + rng.choice(part) + words(rng, 20)) for i in range(20)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_suffix_dedup(spark, str(tmp_path)).collect()
    want = sorted(((*r[:4], hashlib.sha256(r[4]).hexdigest(), r[4].decode(errors="replace")) for r in plain_repeats(rows)), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text or "") for r in got), key=repr) == want
    assert sum(r.text is None for r in got) == sum(t is None for _, t in rows)


def plain_vectors(rows):
    ok = [(i, np.array(v, float), w) for i, v, w in rows if i is not None and w is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, n = [], {}
    for x, (a, u, p) in enumerate(ok):
        for b, v, q in ok[x + 1 :]:
            if p == q and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                links.append((a, b))
                n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    to = reachable({i for i, _, _ in rows if i is not None}, links)
    return {i: (n.get(i, 0), to[i], to[i] == i) for i, _, _ in rows if i is not None}


@pytest.mark.parametrize("leaf", [256, 8])
def test_embeddings_equal_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(embed_dedup, "LEAF", leaf)
    monkeypatch.setattr(embed_dedup, "BLOCK", 16 if leaf == 8 else 1024)
    rng = np.random.default_rng(leaf)
    near = lambda c, e: (c + rng.normal(0, e, len(c)) * np.linalg.norm(c) / 8).tolist()
    centres = rng.normal(size=(6, 64))
    rows = [(i, near(centres[i % 6], 0.15 * rng.random()), i % 2) for i in range(150)]
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [None] * 64, 1), (904, centres[0].tolist(), None), (905, [float("inf")] + [1.0] * 63, 0), (906, [], 0), (907, [1.0, 0.0], 0), (908, [2.0, 0.0], 0)]
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(20)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rep string, weight int, code int")
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], w) for i, v, w in rows]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.classes(df).collect()}
    assert got == plain_vectors(single)


def test_a_cluster_must_name_its_shared_folder():
    unset = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master)))
    assert common.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file://")


def test_hot_groups_of_copies_are_dealt_out(spark, monkeypatch):
    """The same classes where every group of copies counts as hot."""
    rows = awkward() + [(2000 + i, "many copies of one text here") for i in range(40)] + [(3000 + i, None) for i in range(40)]
    monkeypatch.setattr(common, "HOT", 1)
    assert sorted_rows(minhash.classes(frame(spark, rows))) == plain_near(rows)
    vectors = [(i, [1.0 + (i % 3), 2.0], 1) for i in range(60)] + [(100 + i, None, 1) for i in range(20)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.classes(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == plain_vectors(vectors)


@pytest.mark.parametrize("dim, spread", [(64, 1.0), (8, 1.0), (64, 0.05)])
def test_forest_finds_the_links_of_thousands_of_vectors(spark, dim, spread):
    """Isotropic vectors of many and few dimensions, and vectors huddled around a few directions; depth 6 at least."""
    rng = np.random.default_rng(dim)
    n = 4000
    base = rng.normal(size=(20, dim))[rng.integers(0, 20, n)] / spread if spread < 1 else np.zeros((n, dim))
    v = base * spread * 3 + rng.normal(size=(n, dim))
    v[n // 2 :] = v[: n // 2] + rng.normal(size=(n // 2, dim)) * rng.uniform(0.02, 0.25, (n // 2, 1)) * np.linalg.norm(v[: n // 2], axis=1, keepdims=True) / dim**0.5
    v = v.astype(np.float32)
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    links = (u @ u.T >= 0.98).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embed_dedup.classes(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")).collect()}
    mine = np.array([got[i] for i in range(n)])
    assert links.sum() > 500 and (mine <= links).all() and mine.sum() >= 0.999 * links.sum()


def test_embeddings_without_rows_or_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embed_dedup.classes(spark.createDataFrame([], schema)).count() == 0
    rows = rows_of(embed_dedup.classes(spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], schema)))
    assert rows == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]
