"""Small inputs with every awkward row, and plain versions of what the operators compute."""

import random
from collections import Counter, defaultdict

BIG = 2**60 + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, h long, base string, spans string, label int, id long"


def words(rng, n, vocabulary="abcdefgh"):
    return " ".join("".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text): nulls, blanks, repeated rows and ids, ties, copies, a long text."""
    rng = random.Random(5)
    long_one = words(rng, 4000)
    prose = words(rng, 200)
    rows = [(1, None), (2, ""), (3, "  \t\n"), (4, "one"), (5, "One TWO three four"), (6, "one two three four"), (None, "no id here at all my friend"), (None, None), (BIG, "a large id in the same batch as nulls"), (7, long_one), (8, long_one), (9, long_one), (9, long_one), (10, prose), (10, prose + " and another text"), (11, prose.upper()), (12, prose + " tail")]
    rows += [(100 + i, words(rng, rng.randint(1, 60))) for i in range(40)]
    near = prose.split()
    for i in range(25):  # a group of near copies of varying distance
        own = list(near)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] = "x" + str(rng.randrange(99))
        rows.append((200 + i, " ".join(own)))
    return rows


def frame(spark, rows):
    """``documents`` with extra columns whose names clash with those that operators use inside."""
    full = [(i, t, None if i is None or i % 7 == 0 else "en", None if i == 4 else "web", None if t is None else len(t), 0.5, "k", 1, "b", "s", 1, 9) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def reachable(nodes, links):
    """Smallest node reachable from each."""
    out = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(out[a], out[b])
            if out[a] != low or out[b] != low:
                out[a] = out[b] = low
                changed = True
    return out


def shingle_set(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def plain_near(rows, least=85):
    """Sorted (doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    known = [(i, s) for i, s in sets if i is not None]
    links = [(a, b) for x, (a, s) in enumerate(known) for b, t in known[x + 1 :] if s and t and 100 * len(s & t) >= least * len(s | t)]
    to = reachable({i for i, _ in known}, links)
    return sorted([(i, len(s), to.get(i), i is None or to[i] == i) for i, s in sets], key=repr)


def plain_repeats(rows, length=400):
    """(doc_id, kept bytes, spans) by counting every window."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(r[s : s + length] for _, r in raws for s in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - length + 1):
            if count[r[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans, kept = 0, bytearray()
        for k, g in enumerate(gone):
            spans += g and (k == 0 or not gone[k - 1])
            if not g:
                kept.append(r[k])
        out.append((i, len(r), sum(gone), spans, bytes(kept)))
    return out


def grouped(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out
