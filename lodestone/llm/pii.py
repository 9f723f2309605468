"""Personal data in texts by weak supervision, in DataFrame functions only.

Fixed patterns give base spans. Loose patterns add candidates. On every span three labelers vote yes, no or nothing: the
strict pattern, a gazetteer (top-level domains, calling codes, card issuers, address blocks) and words in the context before it.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for each kind, without labels;
its posteriors train a logistic span classifier over votes and shape, which accepts or refuses the loose candidates.

Texts are scanned once, where they are read; spans (not texts) are checkpointed. The driver sees one aggregated table whose
size is bounded by the number of vote and shape classes, whatever the input. Nothing else is shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 40

#: Base patterns: as their contract states them, but possessive where that can't change a match, and starting only where a
#: run of a match's first characters starts or the last match ended, so that long runs take linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold, cheaply tested, to have a base match that counts.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": "+"}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\s?[(\[{]at[)\]}]\s?[A-Za-z0-9-]++(?:\s?(?:[(\[{]dot[)\]}]|\.)\s?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}([\x20./_-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+A-Za-z.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
LOOSE_HINT = {"email": r"[(\[{]at[)\]}]", "ip": r"\[\.\]", "card": r"[0-9]{4}[\x20./_-]?[0-9]{4}[\x20./_-]?[0-9]{4}[\x20./_-]?[0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}

# Gazetteers: well-known values, fixed.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ca|ch|at|nl|be|pl|se|jp|cn|br|ru|au"
CALLING = r"^\+?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WORDS_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
}
WORDS_AGAINST = r"(?i)\b(?:isbn|version|order|invoice|page|serial|build|ticket|nr|no)\b"


#: Sums along an array are made in blocks of so many entries, so that many matches in a text don't take quadratic time.
BLOCK = 64


def running(n: Column) -> Column:
    """The sums of array<int> n up to each entry."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda b: F.slice(n, b * BLOCK + 1, BLOCK))
    add = lambda a, x: a + x
    total = lambda x: F.aggregate(x, F.lit(0), add)
    before = lambda t: F.aggregate(t, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + total(x)))
    told = F.transform(F.array(F.struct(blocks.alias("x"), before(blocks).alias("s"))), lambda t: F.transform(t["x"], lambda x, i: F.struct(x.alias("x"), t["s"][i].alias("s"))))[0]
    return F.flatten(F.transform(told, lambda t: F.transform(t["x"], lambda _, i: t["s"] + total(F.slice(t["x"], F.lit(1), i + 1)))))


def found(text: Column, pattern: str, kind: str, hint: Column) -> Column:
    """array<struct<kind, start, end, body, before>> of a pattern's leftmost matches; places count code points."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("part"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    pairs = F.filter(pairs, lambda x: x["hit"].isNotNull())

    def spans(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.char_length(x["part"]) + F.char_length(x["hit"])))
        return F.transform(F.arrays_zip(p.alias("p"), ends.alias("end")), span)

    def span(x: Column) -> Column:
        start = x["end"] - F.char_length(x["p"]["hit"])
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), x["end"].alias("end"), x["p"]["hit"].alias("body"), F.substring(x["p"]["part"], -CONTEXT, CONTEXT).alias("before"))

    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,body:string,before:string>>)")
    once = F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, spans(p)).otherwise(empty))[0]  # the matches are looked for once
    return F.when(hint, once).otherwise(empty)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of 1 to 19 digits passes the Luhn test."""
    n = F.char_length(number)

    def value(i: Column) -> Column:
        d = F.ascii(F.substring(number, i, F.lit(1))) - 48
        return F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def holds(span: Column, kind: str) -> Column:
    """Whether a base match counts."""
    body = span["body"]
    if kind == "ip":
        return body.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "email":
        return F.lit(True)
    n = F.char_length(digits(body))
    if kind == "phone":
        return n.between(8, 15)
    return F.when(n.between(16, 19), luhn(digits(body))).otherwise(F.lit(False))


def by_kind(kind: Column, of: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, x in of.items():
        out = F.when(kind == k, x).otherwise(out)
    return out


def votes(span: Column, strict: bool) -> dict[str, Column]:
    """1, -1 or 0 from each labeler. A strict span has passed its base pattern."""
    body, kind, number = span["body"], span["kind"], digits(span["body"])
    sign = lambda yes: F.when(yes, 1).otherwise(-1)
    wrong = {"card": F.when(F.char_length(number).between(16, 19), F.when(luhn(number), 0).otherwise(-1)).otherwise(-1), "ip": sign(F.regexp_replace(body, r"[\[\]]", "").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))}
    listed = {
        "email": sign(F.lower(body).rlike(rf"[^a-z](?:{DOMAINS})$")),
        "ip": sign(~body.rlike(r"^0*(?:0|2[3-5][0-9]|22[4-9])[.\[]")),
        "card": sign(number.rlike(ISSUERS)),
        "phone": sign(number.rlike(CALLING)) if strict else F.lit(0),
    }
    near = span["before"]
    told = by_kind(kind, {k: F.when(near.rlike(p), 1).otherwise(0) for k, p in WORDS_FOR.items()})
    context = F.when(told == 1, 1).when(near.rlike(WORDS_AGAINST), -1).otherwise(0)
    return {"pattern": F.lit(1) if strict else by_kind(kind, wrong), "gazetteer": by_kind(kind, listed), "context": context}


def shape(span: Column) -> dict[str, Column]:
    n = F.char_length(digits(span["body"]))
    return {"n_digits": F.least(n, F.lit(20)), "n_separators": F.least(F.char_length(F.regexp_replace(span["body"], "[A-Za-z0-9]", "")), F.lit(6))}


LABELERS = ("pattern", "gazetteer", "context")


def reliabilities(counts: dict[tuple[str, int, int, int], int], rounds: int = 60) -> dict[tuple[str, int, int, int], float]:
    """The posterior that a span of each kind and vote pattern is personal data, by expectation-maximisation.

    A span's votes are taken as independent given its truth; each labeler has a distribution over its three votes for
    true and one for false spans, started so that it is right in 8 of 10 votes."""
    out = {}
    for kind in {k[0] for k in counts}:
        rows = [(k[1:], n) for k, n in counts.items() if k[0] == kind]
        prior = 0.5
        p = [[{1: 0.8, 0: 1.0, -1: 0.2}, {1: 0.2, 0: 1.0, -1: 0.8}] for _ in LABELERS]
        post: list[float] = []
        for _ in range(rounds):
            post = []
            for v, _n in rows:
                yes = math.log(prior) + sum(math.log(p[j][0][x]) for j, x in enumerate(v))
                no = math.log(1 - prior) + sum(math.log(p[j][1][x]) for j, x in enumerate(v))
                post.append(1 / (1 + math.exp(max(-60.0, min(60.0, no - yes)))))
            total = sum(n for _, n in rows)
            prior = min(0.99, max(0.01, (sum(q * n for q, (_, n) in zip(post, rows, strict=True)) + 1) / (total + 2)))
            for j in range(len(LABELERS)):
                for side in (0, 1):
                    w = {x: 2.0 * (0.8 if (x == 1) == (side == 0) else 0.2) if x else 1.0 for x in (1, 0, -1)}
                    for (v, n), q in zip(rows, post, strict=True):
                        w[v[j]] += n * (q if side == 0 else 1 - q)
                    p[j][side] = {x: y / sum(w.values()) for x, y in w.items()}
        out |= {(kind, *v): q for (v, _), q in zip(rows, post, strict=True)}
    return out


def features(kind: str, v: tuple[int, ...], n_digits: int, n_separators: int) -> list[float]:
    return [1.0, *(float(kind == k) for k in KINDS), *(float(x == y) for x in v for y in (1, -1)), n_digits / 20, n_separators / 6]


def train_classifier(rows: list[tuple[list[float], float, float]], steps: int = 400) -> list[float]:
    """Weights of a logistic regression on (features, soft label, count), by gradient steps with a small penalty."""
    size = len(features(KINDS[0], (0, 0, 0), 0, 0))
    w, total = [0.0] * size, sum(n for _, _, n in rows) or 1.0
    for _ in range(steps):
        g = [1e-3 * x for x in w]
        for x, y, n in rows:
            d = (1 / (1 + math.exp(-max(-40.0, min(40.0, sum(a * b for a, b in zip(w, x, strict=True)))))) - y) * n / total
            for k, a in enumerate(x):
                g[k] += d * a
        w = [a - 2.0 * b for a, b in zip(w, g, strict=True)]
    return w


def accepted(span: Column, w: list[float]) -> Column:
    v = votes(span, strict=False)
    s = shape(span)
    at = 1 + len(KINDS)
    score = F.lit(w[0]) + reduce(lambda a, b: a + b, [F.when(span["kind"] == k, F.lit(w[1 + i])).otherwise(0.0) for i, k in enumerate(KINDS)])
    for j, name in enumerate(LABELERS):
        score += F.when(v[name] == 1, F.lit(w[at + 2 * j])).when(v[name] == -1, F.lit(w[at + 2 * j + 1])).otherwise(0.0)
    return score + s["n_digits"] / 20 * w[-2] + s["n_separators"] / 6 * w[-1] > 0


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, and the arrays base and loose (of the latter those that no base span of their kind overlaps)."""
    text = F.col("text")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hint = {k: text.contains(h) if k in ("email", "phone") else text.rlike(h) for k, h in HINT.items()}
    docs = docs.select(
        "doc_id",
        *(found(text, BASE[k], k, hint[k]).alias(f"base_{k}") for k in KINDS),
        *(found(text, LOOSE[k], k, text.rlike(LOOSE_HINT[k])).alias(f"loose_{k}") for k in KINDS),
    )
    kept = lambda k: F.filter(f"base_{k}", lambda x: holds(x, k))
    base = F.concat(*map(kept, KINDS))
    docs = docs.select("doc_id", base.alias("base"), F.concat(*(F.col(f"loose_{k}") for k in KINDS)).alias("loose"))
    apart = lambda x: ~F.exists("base", lambda b: (b["kind"] == x["kind"]) & (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return docs.select("doc_id", "base", F.filter("loose", apart).alias("loose"))


def fit(spans: DataFrame) -> list[float]:
    """The span classifier's weights, from the counts of vote and shape classes (their number is bounded)."""
    keys = ["kind", *LABELERS, "n_digits", "n_separators"]
    some = spans.where((F.size("base") > 0) | (F.size("loose") > 0))
    tables = []
    for name in ("base", "loose"):
        x = some.select(F.explode(name).alias("x"))
        v, s = votes(F.col("x"), name == "base"), shape(F.col("x"))
        tables.append(x.select(F.col("x.kind").alias("kind"), *(c.alias(k) for k, c in (v | s).items())))
    rows = tables[0].unionByName(tables[1]).groupBy(*keys).count().collect()
    counts: dict[tuple[str, int, int, int], int] = {}
    for r in rows:
        k = (r.kind, r.pattern, r.gazetteer, r.context)
        counts[k] = counts.get(k, 0) + r["count"]
    truth = reliabilities(counts)
    data = []
    for r in sorted(rows, key=str):
        v = (r.pattern, r.gazetteer, r.context)
        data.append((features(r.kind, v, r.n_digits, r.n_separators), truth[r.kind, *v], float(r["count"])))
    return train_classifier(data)


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, the number of base spans of each kind, base_sha256 and spans.

    Spans are kind:start:end, in code points with the end exclusive, ordered by kind as in KINDS, then start, and joined by
    commas; base_sha256 is of the base spans alone. Null and empty texts have none (the hash of the empty text, and
    an empty string). Whole texts are read. Rows that repeat repeat; other columns are ignored; an empty table gives no rows.
    """
    spans = checkpoint(candidates(docs))
    w = fit(spans)
    rank = F.array(*(F.lit(k) for k in KINDS))

    def joined(x: Column) -> Column:
        keyed = F.transform(x, lambda s: F.struct(F.array_position(rank, s["kind"]).alias("r"), s["start"].alias("a"), s["end"].alias("z"), s["kind"].alias("k")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["z"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    more = F.when(F.size("loose") > 0, F.filter("loose", lambda x: accepted(x, w))).otherwise(F.col("loose"))
    return spans.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat(F.col("base"), more)).alias("spans")
    )
