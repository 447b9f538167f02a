import random
import zlib

import numpy as np
import pytest
from conftest import rows_of
from fixtures import BIG, SCHEMA, awkward, frame, words

from orbitflow.llm import decontam, quality, revisit
from orbitflow.llm.common import Scratch

# Quality


def labelled(n=400):
    rng = random.Random(9)
    good = lambda: ". ".join(words(rng, 12, "etaoinshr").capitalize() for _ in range(4)) + "."
    bad = lambda: "!!! $$ " + " ".join(rng.choice(["BUY", "$99", "###", "http://x"]) for _ in range(30))
    return [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(n)]


def test_quality_learns_and_keeps_every_row(spark):
    rows = labelled()
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(10_000 + i, t) for i, t, _ in labelled(60)] + [r for r in awkward() if r[0] is None or r[0] in (1, 2, BIG, 7, 9)])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows[:300]] + [(None, 1, 0), (5, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model)
    assert got.count() == docs.count() and set(docs.columns) | {"text_score", "meta_score", "score", "kept"} == set(got.columns)
    want = {i: q for i, _, q in rows}
    unseen = [r for r in got.collect() if r.doc_id in want and r.doc_id >= 300]
    assert len(unseen) == 100 and np.mean([r.kept == bool(want[r.doc_id]) for r in unseen]) > 0.97
    assert got.where(f"doc_id = {BIG}").count() == 1 and got.where("doc_id IS NULL").count() == 2


def plain_co_training(rows, labels):
    """Both views of every document in memory: doc_id to score."""
    rows = [r for r in rows if r[0] is not None]
    x = [np.stack(v).astype(np.float16).astype(np.float32) for v in quality.both_views([r[1:] for r in rows])]
    ids = np.array([r[0] for r in rows])
    of = dict(zip(ids.tolist(), range(len(ids))))
    known = sorted((i, float(q > 0.5)) for i, q in labels if i in of and q is not None)
    at, y = np.array([of[i] for i, _ in known]), np.array([q for _, q in known])
    held = np.array([zlib.crc32(str(i).encode()) % quality.HELD == 0 for i, _ in known])
    pool = np.array([k for k, i in enumerate(ids.tolist()) if i not in dict(known)])

    def surest(views, most):
        out = []
        for v in range(2):
            p = views[1 - v].p(x[1 - v][pool])
            yes, no = np.argsort(-p, kind="stable")[:most], np.argsort(p, kind="stable")[:most]
            chosen = sorted([(ids[pool[k]], pool[k], 1.0) for k in yes if p[k] >= quality.SURE] + [(ids[pool[k]], pool[k], 0.0) for k in no if p[k] <= 1 - quality.SURE])
            out.append((x[v][[k for _, k, _ in chosen]], np.array([c for *_, c in chosen])))
        return out

    return quality.CoTrained(tuple(v[at] for v in x), y, held, surest)


def test_quality_equals_co_training_in_memory(spark, monkeypatch):
    """Fewer than GROW sure documents a kind, so that no tie decides; every unlabelled document takes part."""
    rows = labelled(600)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = [(i, q) for i, _, q in rows[:200]]
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    full = [(r.doc_id, r.text, r.source, r.lang, r.n_chars) for r in docs.collect()]
    want = plain_co_training(full, labels)
    x = quality.both_views([r[1:] for r in full])
    assert np.allclose(model.score(x), want.score(x), atol=1e-6) and len(set(np.round(want.score(x)[:, 2], 6))) > 3


def test_quality_without_labels(spark):
    docs = frame(spark, awkward())
    for labels in ([], [(1, 1)]):
        got = quality.score(docs, quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int")))
        assert got.where("score = 0.5 AND kept").count() == docs.count()
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.score(empty, quality.train(empty, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))).count() == 0


def test_logistic_regression_fits_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4)).astype(np.float32)
    y = (x @ [1, -2, 0, 0.5] + rng.normal(0, 0.5, 500) > 0).astype(float)
    whole = quality.Logistic(x, y)
    monkeypatch.setattr(quality, "AT_ONCE", 37)
    assert np.allclose(quality.Logistic(x, y).w, whole.w) and np.mean((whole.p(x) > 0.5) == y) > 0.9


# Decontamination


def plain_hits(docs, items):
    """Every passage against every item: BM25 as a share of the item's own, then word 5-grams."""
    import math
    from collections import Counter

    kept = [(i, t) for i, t in items if decontam.words(t)]
    tf = [Counter(decontam.words(t)) for _, t in kept]
    size = [sum(c.values()) for c in tf]
    if not kept:
        return {}
    stride, mean = max([decontam.STRIDE, *size]), sum(size) / len(size)
    df = Counter(t for c in tf for t in c)
    idf = {t: math.log(1 + (len(kept) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    out = {}
    for d, (doc, text) in enumerate(docs):
        w = decontam.words(text)
        for s in range(max(1, -(-len(w) // stride))):
            p = w[s * stride : s * stride + 2 * stride]
            for (item, body), c, n in zip(kept, tf, size):
                wt = {t: idf[t] * x * (decontam.K1 + 1) / (x + decontam.K1 * (1 - decontam.B + decontam.B * n / mean)) for t, x in c.items()}
                score = sum(v for t, v in wt.items() if t in set(p)) / sum(wt.values())
                if score < decontam.SCORE:
                    continue
                share = []
                for part in (decontam.words(body), *decontam.question_and_answer(body)):
                    k = min(decontam.GRAM, len(part))
                    g = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)} if k else set()
                    have = {tuple(p[i : i + k]) for i in range(len(p) - k + 1)} if k else set()
                    share.append(len(g & have) / len(g) if g else 1.0)
                if share[0] >= decontam.OVERLAP and min(share[1:]) >= decontam.PART:
                    out[d, item] = max(out.get((d, item), 0.0), round(score, 9))
    return out


def contaminated():
    rng = random.Random(8)
    items = [(i, f"What is {words(rng, 14)}? It is {words(rng, 7)}.") for i in range(30)] + [(90, None), (91, ""), (92, "one"), (93, "A single sentence without an end " + words(rng, 10)), (None, words(rng, 20))]
    docs = [r for r in awkward() if r[0] not in (7, 8)]
    for i in range(12):
        lead = words(rng, rng.randint(0, 150))
        docs.append((300 + i, f"{lead} {items[i][1].upper() if i % 2 else items[i][1]} {words(rng, 80)}"))
    docs += [(400, items[3][1][: len(items[3][1]) // 2]), (401, " ".join(sorted(items[4][1].split()))), (402, f"{items[5][1]} {words(rng, 300)} {items[6][1]}")]
    return docs, items


@pytest.mark.parametrize("block, bounds", [(16, 4_000_000), (2, 40)])
def test_search_equals_all_passages_and_items(spark, monkeypatch, block, bounds):
    docs, items = contaminated()
    want = plain_hits(docs, items)
    monkeypatch.setattr(decontam, "BLOCK", block)
    monkeypatch.setattr(decontam, "BOUNDS", bounds)
    index = decontam.Index(items)
    got = {(d, item): round(score, 9) for d, item, score, *_ in index.hits([t or "" for _, t in docs])}
    assert got == want and len(got) >= 14


def test_decontamination_in_spark(spark):
    docs, items = contaminated()
    df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.search(df, bench)
    bad = {docs[d][0] for d, _ in plain_hits(docs, items)}
    assert {r.doc_id for r in found.collect()} == bad
    clean = decontam.clean(df, bench)
    assert clean.columns == df.columns and clean.count() == len([d for d in docs if d[0] not in bad])
    assert clean.where(f"doc_id = {BIG}").count() == 1
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.search(df, none).count() == 0 and decontam.clean(df, none).count() == df.count() and decontam.search(df.limit(0), bench).count() == 0


def test_rows_do_not_depend_on_the_number_of_shards(spark, monkeypatch):
    docs, items = contaminated()
    long_one = (500, words(random.Random(1), 90) + " ends here.")
    items.append(long_one)  # sets the passage length, wherever it lies
    docs.append((501, "before " * 130 + long_one[1]))
    df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    want, clean = rows_of(decontam.search(df, bench)), rows_of(decontam.clean(df, bench).select("doc_id", "text"))
    assert {(d, item): round(score, 9) for d, item, score, *_ in want} == {(docs[d][0], item): score for (d, item), score in plain_hits(docs, items).items()}
    monkeypatch.setattr(decontam, "SHARD", 500)
    assert decontam.Shards(bench, Scratch(spark, "t")).n > 4
    assert rows_of(decontam.search(df, bench)) == want and rows_of(decontam.clean(df, bench).select("doc_id", "text")) == clean


# Revisits

RECORDS = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string, slice int, canonical_url string"


def plain_revisits(records):
    out = []
    for r in records:
        if r[3] != "revisit":
            continue
        before = [x for x in records if x[3] == "response" and x[4] == 200 and canon(x[1]) == canon(r[1]) and (x[2] or 0) <= (r[2] or 0)]
        to = max(before, key=lambda x: (x[2] or 0, x[0] is not None, x[0] or 0), default=None)
        h = r[5] or {}
        if to is None:
            state = "unresolved"
        elif h.get("etag") is not None:
            state = "resolved" if h["etag"].removeprefix("W/") == (to[5] or {}).get("etag", "").removeprefix("W/") else "changed"
        elif h.get("last-modified") is not None:
            state = "resolved" if h["last-modified"] == (to[5] or {}).get("last-modified") else "changed"
        elif r[6] is not None:
            state = "resolved" if r[6] == to[6] else "changed"
        else:
            state = "unverified"
        merged = {**(to[5] or {}), **{k: v for k, v in h.items() if k in revisit.PERMITTED and v is not None}} if state == "resolved" else None
        out.append((r[0], to[0] if to else None, state, merged))
    return sorted(out, key=repr)


def canon(url):
    url = (url or "").strip().split("#")[0]
    url = url.split("://", 1)[-1]
    host, _, rest = url.partition("/")
    host = host.lower().split("@")[-1].removeprefix("www.").removesuffix(":80").removesuffix(":443")
    path, _, query = rest.partition("?")
    kept = "&".join(q for q in query.split("&") if q and not q.startswith(("utm_", "ref=")))
    return host + (("/" + path).rstrip("/") if rest else "") + ("?" + kept if kept else "")


@pytest.mark.parametrize("most", [250_000, 3])
def test_revisits_equal_a_search_of_all_records(spark, monkeypatch, most):
    monkeypatch.setattr(revisit, "ROWS", most)
    rng = random.Random(6)
    urls = ["http://A.com/x", "https://www.a.com/x/", "a.com/x?utm_source=1#top", "http://b.org:80/p?q=1&ref=z", "https://u@b.org/p?q=1", None, ""]
    rows = []
    for i in range(400):
        url = urls[0] if rng.random() < 0.4 else rng.choice(urls)
        tag = rng.choice(["a", "b"])
        if rng.random() < 0.4:
            rows.append((i, url, rng.randrange(300), "response", rng.choice([200, 200, 206]), {"etag": tag, "last-modified": tag, "server": "s"} if rng.random() < 0.9 else None, tag, 1, "x"))
        else:
            own = rng.choice([{"etag": "W/" + tag, "date": "d", "server": "z"}, {"last-modified": tag, "vary": "v"}, {}, None])
            rows.append((i, url, rng.choice([rng.randrange(300), None]), "revisit", 304, own, rng.choice([tag, None]), 1, "x"))
    rows += [(None, urls[0], 150, "response", 200, {"etag": "a"}, "a", 1, "x"), (None, urls[0], 151, "revisit", 304, {"etag": "a"}, None, 1, "x"), (None, None, None, None, None, None, None, None, None)]
    got = revisit.resolve(spark.createDataFrame(rows, RECORDS)).select("record_id", "response_id", "state", "headers")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_revisits(rows)
    assert {r[2] for r in plain_revisits(rows)} == {"resolved", "changed", "unverified", "unresolved"}
    assert revisit.resolve(spark.createDataFrame([], RECORDS)).count() == 0


def test_captures_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>"), (2, None, None), (None, "x", "y"), (1, "http://a/", "<p>")], "page_id long, url string, html string")
    assert revisit.resolve(revisit.captures(pages)).count() == 4


def test_captures_look_back_over_others(spark):
    """States of every kind, and most resolved to another page's response."""
    pages = spark.range(900).selectExpr("id AS page_id", "concat('http://x.example/', id) AS url", "cast(id AS string) AS html")
    got = revisit.resolve(revisit.captures(pages)).collect()
    assert {r.state for r in got} == {"resolved", "changed", "unverified", "unresolved"}
    others = [r for r in got if r.response_id is not None and r.response_id != r.record_id - 1]
    assert len(others) > len(got) / 4 and any(r.state == "resolved" for r in others)


def test_captures_without_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert rows_of(revisit.captures(pages.limit(0))) == []
