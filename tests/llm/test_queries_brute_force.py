"""Registered queries on whole tables against plain versions, and what the learned parts decide."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import awkward, frame, words
from test_quality_decontam_revisits import plain_hits
from test_text_operators import plain_base, plain_license

from orbitflow.llm import bpe, langid, licenses, pii, queries
from orbitflow.llm.license_texts import STATEMENTS, TEXTS

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


# Personal data


def test_pii_query(spark, sf_dir, docs):
    text = {i: t for i, t, _ in docs}
    for r in queries.op5_pii(spark, sf_dir).collect():
        base = plain_base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base) for k in pii.KINDS]
        assert set(base) <= set(filter(None, r.spans.split(","))) and r.n_spans == len(list(filter(None, r.spans.split(","))))


def plain_em(votes, rounds=25):
    """Expectation-maximisation over single spans instead of counts."""
    v = np.array(votes)
    share, yes, no = 0.7, np.array([pii.YES] * pii.LABELERS), np.array([pii.NO] * pii.LABELERS)
    for _ in range(rounds):
        at = np.arange(pii.LABELERS)
        a, b = share * np.prod(yes[at, v], 1), (1 - share) * np.prod(no[at, v], 1)
        p = a / (a + b)
        share = np.clip((p.sum() + 1) / (len(v) + 2), 0.02, 0.98)
        yes = np.array([[(p[v[:, j] == c].sum() + pii.PRIOR * pii.YES[c]) / (p.sum() + pii.PRIOR) for c in range(3)] for j in at])
        no = np.array([[((1 - p)[v[:, j] == c].sum() + pii.PRIOR * pii.NO[c]) / ((1 - p).sum() + pii.PRIOR) for c in range(3)] for j in at])
    return share, yes, no


def test_reliabilities_equal_a_plain_em():
    rng = random.Random(3)
    votes = [tuple(rng.choices(range(3), (1, 3, 6) if rng.random() < 0.6 else (6, 3, 2))[0] for _ in range(pii.LABELERS)) for _ in range(500)]
    share, yes, no = pii.reliabilities(Counter(votes))
    want = plain_em(votes)
    assert np.isclose(share, want[0]) and np.allclose(yes, want[1]) and np.allclose(no, want[2])
    assert pii.reliabilities({})[0] == 0.7


def test_added_spans_are_right(spark):
    """Planted spans that no base pattern sees, and look-alikes: precision and recall of what is added."""
    rng = random.Random(7)
    filler = lambda: words(rng, 8, "abcdeopst")
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, true, false = [], set(), set()
    for i in range(300):
        text, own = filler() + " ", []
        for _ in range(3):
            kind = rng.randrange(9)
            phone = f"{rng.choice('23456789')}{digits(2)}-{digits(3)}-{digits(4)}"
            lead, span, good = [
                ("mail ", f"{words(rng, 1)}.{words(rng, 1)}@mail.example.org", None),
                ("host ", f"{rng.randint(11, 99)}.{rng.randint(1, 255)}.3.4", None),
                ("write to ", f"{words(rng, 1, 'abc')}x (at) example (dot) {rng.choice(['com', 'org', 'de'])}", True),
                ("call ", phone, True),
                ("phone ", f"({rng.choice('2345')}{digits(2)}) {digits(3)}-{digits(4)}", True),
                ("host ip ", ":".join(f"{rng.randrange(4096, 65536):04x}" for _ in range(8)), True),
                ("order ", f"1{digits(2)}.{digits(3)}.{digits(4)}", False),
                ("part version ", f"0{digits(2)} {digits(3)} {digits(4)}", False),
                ("build ", f"{words(rng, 1, 'abc')} (at) {words(rng, 1, 'xyz')} (dot) q{words(rng, 1, 'xyz')}", False),
            ][kind]
            text += lead
            if good is not None:
                own.append((len(text), len(text) + len(span), good))
            text += span + ". " + filler() + " "
        rows.append((i, text))
        for a, b, good in own:
            (true if good else false).add((i, a, b))
    added = {(r.doc_id, s.start, s.end) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans if s not in r.base}
    hit = lambda some: {x for x in some if any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in added)}
    caught, wrong = len(hit(true)), len(hit(false))
    assert len(true) > 200 and len(false) > 200
    assert caught >= 0.95 * len(true) and caught >= 0.95 * (caught + wrong), (caught, len(true), wrong, len(false))


# Licences


def plain_scan(text):
    """Labels and score by counting the votes of every diagonal in lists."""
    low = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    w = [x for x in re.split(licenses.SEPARATORS, low) if x]
    at, k = defaultdict(list), licenses.K
    for i in range(len(w) - k + 1):
        at[tuple(w[i : i + k])].append(i)
    labels, best = set(), 0.0
    for (body, label), phrase in [*((x, True) for x in licenses.PHRASES.items()), *((x, False) for x in STATEMENTS + TEXTS)]:
        t = body.split()
        own = [j for j in range(len(t) - k + 1) if phrase or not set(t[j : j + k]) <= licenses.COMMON]
        diagonals = defaultdict(list)
        for j in own:
            for i in at[tuple(t[j : j + k])]:
                diagonals[i - j].append(i)
        runs, before = [], None
        for d in sorted(diagonals):
            lo, hi = min(diagonals[d]), max(diagonals[d])
            if not phrase and before and d - before[0] <= licenses.SLACK and lo - before[1] <= licenses.NEAR:
                runs[-1] += len(diagonals[d])
            else:
                runs.append(len(diagonals[d]))
            before = d, hi
        for n in runs:
            share = min(1.0, n / len(own))
            if share >= (1.0 if phrase else licenses.ENOUGH):
                labels.add(label)
                best = max(best, share)
    return ",".join(sorted(labels)), best


def test_licence_labels_and_scores_equal_a_plain_count(spark, sf_dir, docs):
    rng = random.Random(4)
    rows = [(i, t) for i, t, _ in docs] + awkward()
    for i, (body, _) in enumerate(STATEMENTS + TEXTS):
        w = body.split()
        torn = [x for x in w if rng.random() > 0.04]
        mixed = [y for x in w for y in ([x, "zz"] if rng.random() < 0.03 else [x])]
        half = w[: len(w) * 3 // 4]
        rows += [(9000 + 10 * i + j, f"{words(rng, 5)} {' '.join(x)} {words(rng, 5)}") for j, x in enumerate((w, torn, mixed, half))]
    got = licenses.report(frame(spark, rows)).collect()
    mine = sorted(((r.doc_id, r.labels, round(r.score, 9)) for r in got), key=repr)
    assert mine == sorted(((i, plain_scan(t)[0], round(plain_scan(t)[1], 9)) for i, t in rows), key=repr)
    by = {r.doc_id: r.labels for r in got}
    assert all(label in by[9000 + 10 * i].split(",") for i, (_, label) in enumerate(STATEMENTS + TEXTS))


def test_licence_query(spark, sf_dir, docs):
    want = {i: (*plain_license(t), *plain_scan(t)) for i, t, _ in docs}
    for r in queries.op7_licenses(spark, sf_dir).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[r.doc_id][:6] and np.isclose(r.score, want[r.doc_id][6])


# Decontamination, tokens, languages


def test_decontamination_query(spark, sf_dir, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = plain_hits([(i, t) for i, t, _ in docs], items)
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in queries.op6_decontamination(spark, sf_dir).collect()}
    assert got == {(docs[d][0], item): score for (d, item), score in want.items()} and len(got) >= 3


def test_bpe_query(spark, sf_dir, docs):
    tiktoken = pytest.importorskip("tiktoken")
    with open(P.path(queries.RANKS), "rb") as f:
        library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    text = {i: t or "" for i, t, _ in docs}
    for r in queries.op8_byte_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())


def plain_grams(text):
    low = " " + (text or "").lower() + " "
    low = "".join(c if c.isalpha() else " " for c in low)
    return [g for g in (low[i : i + 3] for i in range(len(low) - 2)) if sum(c != " " for c in g) >= 2]


def plain_languages(learned):
    """Exact sets of trigrams by language."""
    count = defaultdict(Counter)
    for text, lang in learned:
        if text is not None and lang is not None:
            count[lang].update(plain_grams(text))
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in count.items() if c}
    most = Counter()
    for c in rate.values():
        for g, x in c.items():
            most[g] = max(most[g], x)
    return {k: {g for g, x in c.items() if x >= langid.SHARE * most[g] and x >= langid.RARE} for k, c in rate.items()}


def test_language_query_equals_exact_sets_but_for_false_positives(spark, sf_dir, docs):
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in docs}
    sets = plain_languages([(t, k) for i, t, k in docs if not held[i]])
    text = {i: t for i, t, _ in docs}
    for r in queries.op10_language(spark, sf_dir).collect():
        assert r.held_out == held[r.doc_id]
        grams = plain_grams(text[r.doc_id])
        if not grams:
            continue
        share = {k: sum(g in s for g in grams) / len(grams) for k, s in sets.items()}
        order = sorted(share, key=lambda k: (-share[k], k))
        assert r.lang_pred == order[0] or share[order[0]] - share[r.lang_pred] < 0.02
        assert abs(r.score - share[r.lang_pred] / sum(share.values())) < 0.05


def test_small_languages_keep_their_trigrams(spark):
    """Six short texts of one language beside thousands of another; ties go to the language that sorts first."""
    said = lambda k, n: " ".join(random.Random(k).choices(["zirp", "quolb", "vamtu"] if k == "zz" else ["hello", "there", "world"], k=n))
    rows = [(said("en", 40), "en")] * 3000 + [(said("zz", 6), "zz")] * 6 + [("abab", "aa"), ("abab", "ab")]
    filters = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert filters.predict(["zirp quolb", "hello world", "abab"])[0] == ["zz", "en", "aa"]
