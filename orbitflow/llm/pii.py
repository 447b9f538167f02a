"""Personal data by weak supervision, in DataFrame functions only.

Regex labelers give spans of four kinds exactly (the base), and looser patterns give further candidates: spelled-out
addresses, local phone numbers and those with 00 for the plus, IPv6, cards with other separators. Every candidate gets votes of +1, 0 or -1 from four labelers (pattern, gazetteer,
context words, shape), which may contradict each other. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is. A logistic
span classifier is fitted to the posteriors on what the labelers saw and on features that they don't look at (length, separators, what stands on both sides). It is applied as a
column expression: base spans always stay, other candidates stay if the classifier says so and no base span overlaps.

Texts are searched once: candidates are kept in the shared folder, then counted, then judged. The only shuffle is that of the counts, which are few whatever the
input (``3 ** 4`` vote patterns and ``prod(SIZES)`` features for each kind at most). No pattern can take more than linear time
on a run of its characters, and long repetitions do not recurse.

Defined results: a null text is the empty text and has no spans; every row gives one row, also when rows repeat or doc_id
is null; other columns pass through unless they are named like a result. A candidate with a score of exactly 0 stays. Without candidates nothing is learned and
nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitflow.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, written so that they match the same spans in linear time. A match can only begin
# where a run begins or where the match before ended; possessive repetition never gives back characters that nothing else takes.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[]dot[)\]]\x20?[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_])",
    "phone": r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]*[0-9])",
}
# What must be in a text for the loose pattern to match, as a cheap test.
LOOSE_NEEDS = {"email": r"[(\[]dot[)\]]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{4}[./_][0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
# Gazetteers. Top-level domains, calling codes (ITU-T E.164), issuers' leading digits (ISO/IEC 7812), address blocks for special use (RFC 6890).
DOMAINS = "com org net edu gov mil int info biz io dev app me tv ai co eu uk ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg hr si rs ua ru tr se no dk fi is ee lv lt us ca mx br ar cl pe au nz jp kr cn tw hk sg my th vn id ph in pk za ng ke eg ma il ae sa".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 221 225 233 234 254 255 256 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 380 381 385 386 387 389 420 421 423 852 853 855 880 886 960 961 962 963 964 965 966 971 972 973 974 994 995 998".split()
ISSUERS = "4 51 52 53 54 55 2221 223 224 225 226 23 24 25 26 271 2720 34 37 300 301 302 303 304 305 36 38 39 6011 644 645 646 647 648 649 65 352 353 354 355 356 357 358 50 56 57 58 62".split()
SPECIAL = r"^(0+\.|10\.|127\.|169\.254\.|192\.0\.[02]\.|198\.51\.100\.|203\.0\.113\.|2[4-9][0-9]\.|[0:]+$)"
GAZETTEER = {
    "email": rf"(?i)\b({'|'.join(DOMAINS)})$",
    "ip": rf"^(?!{SPECIAL[1:]})",
    "card": rf"^({'|'.join(ISSUERS)})",
    "phone": rf"^(\+|00)({'|'.join(CALLING)})|^\(?[2-9][0-9]{{2}}",
}
# Words near a span that speak for its kind, or against it.
FOR_IT = {
    "email": r"(?i)\b(mail|e-mail|email|contact|write|reach|address|inbox|correo|courriel|adresse|kontakt)\b",
    "ip": r"(?i)\b(ip|ipv4|ipv6|host|server|client|from|login|ping|router|dns|gateway|subnet|peer)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment|pay|cvv|cvc|expiry|expires|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|fax|contact|cell|dial|ring|sms|whatsapp|telefon|handy|teléfono|téléphone)\b",
}
AGAINST_IT = r"(?i)\b(version|release|build|isbn|issn|doi|order|invoice|page|pages|figure|table|section|chapter|serial|sku|ratio|score|part|article|hash|mac|time|lot|batch)\b"
BEFORE, AFTER = 40, 12
LABELERS = 4
#: Values of each feature: length, separators, the side before, the side after, a word for the kind, a word against it, whether the base pattern matched.
SIZES = (4, 5, 5, 3, 2, 2, 2)
BLOCK = 256


def _running(values: Column, base: Column) -> Column:
    """Exclusive running sums of a short array."""
    start = F.struct(base.cast("long").alias("t"), F.array().cast("array<long>").alias("a"))
    return F.aggregate(values, start, lambda s, v: F.struct((s["t"] + v).cast("long").alias("t"), F.concat(s["a"], F.array(s["t"])).alias("a")))["a"]


def _prefix_sums(values: Column) -> Column:
    """Exclusive running sums in blocks: appending to one long array would copy it each time."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v))
    made = F.flatten(F.zip_with(blocks, _running(sums, F.lit(0)), _running))
    return F.when(F.size(values) > 0, made).otherwise(F.array().cast("array<long>"))


def _matches(text: Column, pattern: str, needs: Column) -> Column:
    """array<struct<start, end, hit, before, after>> of the leftmost non-overlapping matches, in code points; ``needs`` guards the work."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: (F.char_length(p) + F.char_length(h)).cast("long"))
    ends = F.zip_with(_prefix_sums(steps), steps, lambda a, b: a + b)
    found = F.transform(
        F.arrays_zip(ends.alias("e"), hits.alias("h"), F.slice(pieces, 1, F.size(hits)).alias("p"), F.slice(pieces, 2, F.size(hits)).alias("q")),
        lambda x: F.struct((x["e"] - F.char_length(x["h"])).cast("long").alias("start"), x["e"].alias("end"), x["h"].alias("hit"), F.right(x["p"], F.lit(BEFORE)).alias("before"), F.left(x["q"], F.lit(AFTER)).alias("after")),
    )
    return F.when(needs, found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>"))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(r"^(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.(?!$)|$)){4}$")
    n = F.char_length(_digits(hit))
    if kind == "card":
        return F.when(n.between(13, 19), F.call_function("luhn_check", _digits(hit))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _is_valid(kind: str):
    return lambda x: _valid(kind, x["hit"])


def of_kind(spans: str, kind: str) -> Column:
    """The spans of one kind."""
    return F.filter(spans, lambda x: x["kind"] == kind)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, x: Column, strict: bool) -> Column:
    """Votes of the labelers as one number: base 3, pattern first."""
    hit, before, digits = x["hit"], x["before"], _digits(x["hit"])
    shape = {"email": _vote(hit.rlike("[A-Za-z]"), ~hit.rlike("[A-Za-z]")), "ip": _vote(hit.rlike("[1-9A-Fa-f]"), ~hit.rlike("[1-9A-Fa-f]"))}.get(kind, _vote(~digits.rlike(r"^(.)\1+$"), digits.rlike(r"^(.)\1+$")))
    votes = [F.lit(1 if strict else 0), _vote(hit.rlike(GAZETTEER[kind]), F.lit(kind in ("card", "ip")) & ~hit.rlike(GAZETTEER[kind])), _vote(before.rlike(FOR_IT[kind]), before.rlike(AGAINST_IT)), shape]
    total = F.lit(0)
    for v in votes:
        total = total * 3 + v + 1
    return total.cast("int")


def _first_of(value: Column, *patterns: str) -> Column:
    """The place of the first pattern that is found in ``value``, from 1; else 0."""
    out = F.lit(0)
    for i in range(len(patterns), 0, -1):
        out = F.when(value.rlike(patterns[i - 1]), i).otherwise(out)
    return out


def _seen(kind: str, x: Column, strict: bool) -> Column:
    """Values of the features as one number."""
    n, near = F.char_length(x["hit"]), F.concat(x["before"], F.lit(" "), x["after"])
    values = [
        F.when(n < 10, 0).when(n < 16, 1).when(n < 24, 2).otherwise(3),
        _first_of(x["hit"], r"\x20", "-", r"\.", "[^0-9A-Za-z]"),
        _first_of(x["before"], r"\s$", "[A-Za-z]$", "[0-9]$", ".$"),
        _first_of(x["after"], r"^[\s.,;:!?)]", "."),
        near.rlike(FOR_IT[kind]).cast("int"),
        near.rlike(AGAINST_IT).cast("int"),
        F.lit(int(strict)),
    ]
    total = F.lit(0)
    for size, v in zip(SIZES, values):
        total = total * size + v
    return total.cast("int")


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``base`` and ``more``: arrays of struct<kind, k, start, end, votes, seen>, k the kind's place in KINDS."""
    t = F.coalesce(F.col(text), F.lit(""))
    digit, kinds = t.rlike("[0-9]"), list(KINDS)
    needs = {"email": t.contains("@"), "ip": digit & t.rlike(r"[0-9]\.[0-9]"), "card": digit, "phone": digit & t.contains("+")}

    def marked(kind: str, found: Column, strict: bool) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(kinds.index(kind)).alias("k"), x["start"].alias("start"), x["end"].alias("end"), _votes(kind, x, strict).alias("votes"), _seen(kind, x, strict).alias("seen")))

    base = [marked(k, F.filter(_matches(t, BASE[k], needs[k]), _is_valid(k)), True) for k in kinds]
    more = [marked(k, _matches(t, LOOSE[k], t.rlike(LOOSE_NEEDS[k])), False) for k in LOOSE]
    out = df.select(*[c for c in df.columns if c not in ("base", "more")], F.concat(*base).alias("base"), F.concat(*more).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return out.withColumn("more", apart)


def _unpack(number: int, sizes: tuple[int, ...]) -> list[int]:
    out = []
    for size in reversed(sizes):
        out.append(number % size)
        number //= size
    return out[::-1]


VOTES = (3,) * LABELERS
#: What each labeler is taken to say of true and of false spans before anything is seen (against, nothing, for), and how many spans that belief weighs.
YES, NO, PRIOR = (0.1, 0.3, 0.6), (0.5, 0.4, 0.1), 10


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 25) -> tuple[float, list, list]:
    """Share of true spans, and what each labeler says of true and of false ones, by expectation-maximisation over ``counts`` of vote patterns."""
    share, is_yes, is_no = 0.7, [list(YES) for _ in VOTES], [list(NO) for _ in VOTES]
    for _ in range(rounds if counts else 0):
        post = {v: posterior(v, share, is_yes, is_no) for v in counts}
        yes = sum(n * post[v] for v, n in counts.items())
        total = sum(counts.values())
        share = min(0.98, max(0.02, (yes + 1) / (total + 2)))
        is_yes = [[(sum(n * post[v] for v, n in counts.items() if v[j] == c) + PRIOR * YES[c]) / (yes + PRIOR) for c in range(3)] for j in range(LABELERS)]
        is_no = [[(sum(n * (1 - post[v]) for v, n in counts.items() if v[j] == c) + PRIOR * NO[c]) / (total - yes + PRIOR) for c in range(3)] for j in range(LABELERS)]
    return share, is_yes, is_no


def posterior(votes: tuple[int, ...], share: float, is_yes: list, is_no: list) -> float:
    """Probability that a span with these votes is a true one."""
    a, b = share, 1 - share
    for j, v in enumerate(votes):
        a, b = a * is_yes[j][v], b * is_no[j][v]
    return a / (a + b)


def fit(found: DataFrame) -> dict[str, list[list[float]]]:
    """Weights by kind: a list for each labeler's votes, then for each feature's values, then the bias."""
    spans = found.select(F.explode(F.concat("base", "more")).alias("x"))
    counted = spans.groupBy("x.kind", "x.votes", "x.seen").count().collect()  # len(KINDS) * 3 ** LABELERS * prod(SIZES) rows at most
    sizes, weights = (*VOTES, *SIZES), {}
    for kind in KINDS:
        rows = sorted((r["votes"], r["seen"], r["count"]) for r in counted if r["kind"] == kind)
        rows = [(tuple(_unpack(v, VOTES)), _unpack(s, SIZES), n) for v, s, n in rows]
        counts: dict = {}
        for v, _, n in rows:
            counts[v] = counts.get(v, 0) + n
        share, is_yes, is_no = reliabilities(counts)
        # The generative weights are where the classifier begins.
        w = [*([math.log(is_yes[j][c] / is_no[j][c]) for c in range(3)] for j in range(LABELERS)), *([0.0] * n for n in SIZES), [math.log(share / (1 - share))]]
        goal = [posterior(v, share, is_yes, is_no) for v, _, _ in rows]
        total = sum(n for *_, n in rows) or 1
        for _ in range(200 if rows else 0):
            step = [[0.0] * n for n in (*sizes, 1)]
            for (v, s, n), p in zip(rows, goal):
                at = (*v, *s, 0)
                miss = n / total * (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i][c] for i, c in enumerate(at)))))))
                for i, c in enumerate(at):
                    step[i][c] += miss
            w = [[a + 0.3 * (b - 1e-3 * a) for a, b in zip(x, y)] for x, y in zip(w, step)]
        weights[kind] = w
    return weights


def _says_yes(x: Column, weights: dict[str, list[list[float]]]) -> Column:
    score = F.lit(0.0)
    for kind, w in weights.items():
        total = F.lit(w[-1][0])
        for number, sizes, some in ((x["votes"], VOTES, w[:LABELERS]), (x["seen"], SIZES, w[LABELERS:-1])):
            below = math.prod(sizes)
            for size, values in zip(sizes, some):
                below //= size
                total = total + F.get(F.array(*map(F.lit, values)), F.floor(number / below).cast("int") % size)
        score = F.when(x["kind"] == kind, total).otherwise(score)
    return score >= 0


def find(df: DataFrame, text: str = "text", keep_text: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """``df`` (without its text unless ``keep_text``) with ``base`` and ``spans``: arrays of struct<kind, k, start, end, votes, seen> in the order of kind and start."""
    all_ = candidates(df.drop("spans"), text)
    found = (scratch or Scratch(df.sparkSession, "pii")).keep(all_ if keep_text else all_.drop(text), "candidates")
    weights = fit(found)
    ordered = F.array_sort(F.concat("base", F.filter("more", lambda m: _says_yes(m, weights))), lambda a, b: F.when(a["k"] != b["k"], a["k"] - b["k"]).otherwise(F.signum(a["start"] - b["start"]).cast("int")))
    return found.withColumn("spans", ordered).drop("more")


def listed(spans: str | Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each stretch that spans cover replaced by the first span's kind in angle brackets."""
    by_start = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(a["k"] - b["k"]))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def take(s: Column, x: Column) -> Column:
        grown = F.concat(s["out"], F.array(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.concat(F.lit("<"), x["kind"], F.lit(">"))))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], grown).otherwise(s["out"]).alias("out"))

    done = F.aggregate(by_start, zero, take, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
