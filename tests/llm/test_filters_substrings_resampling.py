"""Filter interactions, substring dedup and importance resampling against plain versions, on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from fixtures import awkward, frame, words

from orbitflow.llm import filter_audit, resample, substring_dedup

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(resample._UPPER, resample._LOWER)


def sources(spark, rows):
    full = [(i, t, None if k % 3 == 0 else f"s{k % 2}", 0.5, 1) for k, (i, t) in enumerate(rows)]
    return full, spark.createDataFrame(full, "doc_id long, text string, source string, mask double, n int")


def audited(rows, labels):
    """The 600 rows of each part, document by document."""
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, s, *_ in rows:
        t = t or ""
        w = SPACES.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        good, toxic = (i is not None and any(x == i and y[k] == 1 for x, *y in labels) for k in (0, 1))
        docs.append((s or "", {f for f, bad in fails.items() if bad}, good, toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [bool(d[1] & set(order[:k])) for d in own]
                hit = [d for d, g in zip(own, gone) if not g and f in d[1]]
                out[part, "".join(order), k + 1] = [sum(not d[1] & set(order[: k + 1]) for d in own), len(hit), sum(g and f in d[1] for d, g in zip(own, gone)), sum(d[1] == {f} for d in own), sum(d[2] for d in hit), sum(d[3] for d in hit)]
                shapley[part, f] += len(hit)
    return {(*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_filter_audit_equals_counting_documents(spark):
    rows = [*awkward(), (300, "Lots OF CAPITALS here " * 20), (301, "a | b # c"), (302, "x " * 60), (303, "x " * 60), (304, None), (2**60 + 3, "one"), (None, "one"), (4, "one")]
    full, docs = sources(spark, rows)
    labels = [(4, 1, 0), (4, 0, 1), (302, 1, 1), (303, 1, None), (999, 1, 1), (None, 1, 1)]
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    assert {tuple(r) for r in got.collect()} == audited(full, labels) and got.count() == 600 * 3
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, none).agg({"good_lost": "sum"}).first()[0] == 0 and filter_audit.audit(docs.limit(0), none).count() == 0


def without_repeats(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            w = SPACES.findall(t or "")
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = SPACES.findall(t or "")
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def passages():
    rng = random.Random(8)
    shared = [words(rng, n) for n in (12, 13, 14, 40, 90)]
    rows = [(400 + i, " ".join(rng.choice([words(rng, rng.randint(1, 30)), rng.choice(shared)]) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    common = "this very phrase stands in all of these texts and nothing else does so"  # 14 words amid different ones
    rows += [(600 + i, f"{words(rng, 9)} {common} {words(rng, 9)}") for i in range(60)]
    return rows + [(401, shared[3]), (700, shared[4]), (700, shared[4] + " x"), (None, shared[4]), (701, "é ü " * 20), (702, "é ü " * 20), (703, "w" * 5000 + " " + shared[3]), (704, "\x0b".join(shared[2].split()))]


@pytest.mark.parametrize("shard, load, piece", [(1 << 16, 1 << 20, 1 << 20), (20, 30, 500)])
def test_substring_dedup_equals_counting_runs(spark, monkeypatch, shard, load, piece):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    monkeypatch.setattr(substring_dedup, "LOAD", load)
    rows = [*awkward(), *passages()]
    got = substring_dedup.remove_repeats(frame(spark, rows))
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()], key=repr) == without_repeats(rows)
    assert substring_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_automaton_gives_matching_statistics_and_owners():
    rng = random.Random(2)
    for _ in range(60):
        texts = [([rng.choice("ab") for _ in range(rng.randint(0, 12))], rng.randint(1, 9)) for _ in range(rng.randint(1, 4))]
        a = substring_dedup.Automaton()
        for w, owner in texts:
            a.add(w, owner)
        line, most = [rng.choice("abc") for _ in range(30)], rng.randint(1, 5)

        def owners(piece, texts=texts):
            return [o for w, o in texts if any(w[k : k + len(piece)] == piece for k in range(len(w) - len(piece) + 1))]

        for end, (n, owner) in enumerate(a.matches(line, most), 1):
            want = max(k for k in range(min(most, end) + 1) if k == 0 or owners(line[end - k : end]))
            assert n == want and (n < most or owner == min(owners(line[end - n : end])))


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(3)
    raw = b" ".join([words(rng, 400).encode(), b"y" * 3000, words(rng, 100).encode(), "é ü".encode(), b"y" * 3000])
    starts, hashes = substring_dedup.word_hashes(raw)
    assert [raw[s:].split()[0] for s in starts.tolist()] == raw.split() and len(set(hashes.tolist())) == len(set(raw.split()))
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    again = substring_dedup.word_hashes(raw)
    assert starts.tolist() == again[0].tolist() and hashes.tolist() == again[1].tolist()


def drawn(rows, target):
    def feats(t):
        w = ALNUM.findall((t or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    docs, aims = [(i, *feats(t)) for i, t in rows], Counter(b for t in target for b in feats(t)[1])
    s = Counter(b for _, _, f in docs for b in f)
    ns, nt = sum(s.values()), sum(aims.values())
    gain = [math.floor(1000 * math.log((aims[b] + 1.0) * (ns + 10000.0) / ((s[b] + 1.0) * (nt + 10000.0)))) for b in range(10000)]
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = k + 1
    return sorted([(r[0], *r[2:]) for r in out], key=repr)


def test_resampling_equals_counting_features(spark):
    rng = random.Random(6)
    rows = [*awkward(), *((1000 + i, words(rng, rng.randint(15, 60))) for i in range(150)), (1000, "ÄB c-D_e 12" * 30), (None, words(rng, 40))]
    target = [words(rng, 300), None, "", "One two three"]
    aims = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(frame(spark, rows), aims)
    want = drawn(rows, target)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want and sum(r[-1] is not None for r in want) > 5
    alone = resample.resample(frame(spark, rows), aims.limit(0)).where("doc_id >= 1000 AND doc_id < 1150")
    assert sorted(map(tuple, alone.collect())) == [r for r in drawn(rows, []) if r[0] is not None and 1000 <= r[0] < 1150]
    assert resample.resample(frame(spark, rows).limit(0), aims).count() == 0
