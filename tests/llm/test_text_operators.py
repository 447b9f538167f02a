import hashlib
import random
import re
import struct

import pytest
from conftest import rows_of
from fixtures import SCHEMA, awkward, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbitflow.llm import bpe, langid, licenses, pii, queries
from orbitflow.llm.license_texts import STATEMENTS, TEXTS

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def coder():
    with open(P.path(queries.RANKS), "rb") as f:
        return bpe.Coder(bpe.read_ranks(f.read()), bpe.class_table())


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


ODD = ["", " ", "  a  b ", "it's I'll we've they're I'd 'S 's''s '", "\n\n x\r\n\ty   z", "日本語 １２３ٍ٣", "é ​‍👩‍👩‍👧", "a" * 300, "1" * 70 + " " + "!" * 90, "<|endoftext|> <|x|>", "  a 　b", "ß" * 60, " " * 500 + "x", "\x00\x1f\x85y"]


def test_encoding_equals_the_library(coder, library):
    texts = [t or "" for _, t in awkward()] + ODD
    for text, packed in zip(texts, coder.encode(texts)):
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode_ordinary(text)
        assert coder.decode(packed) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_texts(coder, library, texts):
    for text, packed in zip(texts, coder.encode(texts)):
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode_ordinary(text)


def test_chunks_and_batches_do_not_matter(coder, monkeypatch):
    import numpy as np

    rng = random.Random(1)
    text = "".join(rng.choice(["a", " ", "'", "s", "1", "!", "\n", "ll"]) for _ in range(3000))
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    whole = bpe.token_starts(points, np.array([0]), coder.table)
    for chunk in (1, 2, 7, 128, 1000):
        assert (bpe.token_starts(points, np.array([0]), coder.table, chunk) == whole).all()


def test_bpe_in_spark(spark, library):
    v = bpe.Vocabulary(spark, P.path(queries.RANKS))
    df = frame(spark, [(i, t) for i, t in awkward()] + [(700 + i, t) for i, t in enumerate(ODD)])
    for r in bpe.digests(df, v).collect():
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, v), v)
    assert back.where(F.expr("decoded <> cast(coalesce(text, '') AS binary)")).count() == 0 and back.count() == df.count()
    row = bpe.encode(df.where("doc_id = 4"), v).first()
    assert row.offsets[0] == 0 and row.key == "k"
    assert bpe.digests(spark.createDataFrame([], SCHEMA), v).count() == 0


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PERSONAL = [
    "mail bob.smith+x@mail.example.co.uk or a@b.c.", "é@x.y a@b a@b.c@d.e.f %%@-.-", "ip 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 0001.002.3.255", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111 5500 0000 0000 0004 340000000000009", "call +1 (555) 123-4567 or +49 30 901820 or +1 2 3 or +33.1.23.45.67.89",
    "call me at (555) 123-4567 or mail joe (at) example (dot) com", "address 2001:0db8:85a3:0000:0000:8a2e:0370:7334 of the host", "日本 x@y.zz 👍 +12 345 678 901", "1" * 5000, "a" * 5000 + "@", "1." * 3000, "+1" * 2000, "a@b." * 900, "9 " * 3000, "+1 " + "2 " * 2000, "4111 1111 1111 1111 " * 300,
]


def test_base_spans_equal_the_patterns(spark):
    rows = awkward() + [(600 + i, t) for i, t in enumerate(PERSONAL)]
    got = pii.find(frame(spark, rows)).select("doc_id", "text", pii.listed("base").alias("b"), pii.listed("spans").alias("s"), pii.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.b == ",".join(plain_base(r.text)), r.text[:80]
        assert set(filter(None, r.b.split(","))) <= set(filter(None, r.s.split(",")))
        assert r.text is not None or r.clean is None
    by = {r.doc_id: r for r in got}
    assert "bob.smith" not in by[600].clean and "<email>" in by[600].clean and "2001:0db8" not in by[606].clean
    assert by[4].clean == "one"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="a1+@. -()9", max_size=60), min_size=1, max_size=80))
def test_base_spans_of_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = pii.candidates(df).select("doc_id", pii.listed("base").alias("b")).collect()
    assert {r.doc_id: r.b for r in got} == {i: ",".join(plain_base(t)) for i, t in enumerate(texts)}


def test_nothing_to_learn_from(spark):
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0


# Licences


def plain_license(text):
    low = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    w = [x for x in re.split(licenses.SEPARATORS, low) if x]
    hits = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(spark):
    texts = ["MIT License and the Apache license, CC-BY 4.0; the GNU General Public License", "cc by cc by cc by", "mit licenses mit  license", "émit license", "apache", "gnu general public gnu general public license", "", None, "mit license " * 3000, STATEMENTS[0][0], " ".join("great " + x if x == "software" else x for x in TEXTS[0][0].split())]
    rows = awkward() + [(800 + i, t) for i, t in enumerate(texts)]
    got = licenses.report(frame(spark, rows)).collect()
    want = sorted([(i, *plain_license(t)) for i, t in rows], key=repr)
    assert sorted([tuple(r)[:6] for r in got], key=repr) == want
    by = {r.doc_id: r for r in got}
    assert by[810].labels == "mit" and by[810].n_base == 0 and 0.75 <= by[810].score <= 1 and by[809].score == 1.0
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)
    assert licenses.report(spark.createDataFrame([], SCHEMA)).count() == 0


# Languages


def test_languages(spark):
    speech = {"en": "the quick brown fox jumps over the lazy dog while it was raining in the town and they went home", "de": "der schnelle braune fuchs springt über den faulen hund und es regnete in der stadt als sie nach hause gingen", "fr": "le rapide renard brun saute par dessus le chien paresseux pendant que il pleuvait dans la ville"}
    rng = random.Random(2)
    said = lambda k: " ".join(rng.choice(speech[k].split()) for _ in range(25))
    train = spark.createDataFrame([(said(k), k) for k in speech for _ in range(30)] + [(None, "en"), ("x", None), ("", "de")], "text string, lang string")
    f = langid.train(train)
    assert f.languages == ["de", "en", "fr"]
    rows = [(i, said(k), k) for i, k in enumerate(list(speech) * 20)] + [(900, None, None), (901, "123 !?", None), (None, said("fr"), "fr"), (902, "ßß", None), (2**60 + 1, "the dog " * 20000, "en")]
    df = spark.createDataFrame([(i, t, k, "clash", 3) for i, t, k in rows], "doc_id long, text string, want string, lang_pred string, score int")
    got = langid.predict(df, f).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.want for r in got if r.want) and all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert und[900] == und[901] == ("und", 0.0) and und[902][0] in f.languages
    assert {r.lang_pred for r in langid.predict(df, langid.train(train.limit(0))).collect()} == {"und"}
    assert langid.predict(df.limit(0), f).count() == 0


def test_language_query_is_accurate_on_held_out(spark, sf_dir):
    got = queries.op10_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    n = got.count()
    assert n > 10 and got.where("lang = lang_pred").count() >= 0.9 * n
    assert rows_of(queries.op10_language(spark, sf_dir).groupBy("held_out").count())[0][1] > 0
