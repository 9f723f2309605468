import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from lodestone.llm import order_minhash, pii

WORDS = "of the and to in Being thé été über 12 7.5 x".split()


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{z}" for k, a, z in sorted(out))


def texts(rng):
    parts = ["a.b@c.org", "x@y", "a@b.com_x@y.com", "..@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111111111111112",
             "4111-1111-1111-1111-1", "+1 (988) 555-2485", "+12", "+49 (0) 30 1234567 8901 234", "+1--5", "(212) 555-0199", "joe [at] example [dot] com", "10[.]0[.]0[.]1",
             "12345678901234567890123", "\U0001f600", "é", "tel", "version", "card", "5500 0000 0000 0004", "\n"]
    out = [None, "", "x" * 200_000 + " (at) ", "joe (at) a.b " * 3000, "a.b@c.org " * 5000, "a" * 30000 + "@b.co", "1" * 20000, "a.b@c" + ".d" * 9000, "+" + "1 " * 9000, "1.1" * 8000]
    for _ in range(150):
        out.append(rng.choice(["", " "]).join(rng.choice(parts + WORDS) for _ in range(rng.randint(1, 14))))
    return out


def test_base_spans_are_those_of_the_patterns(spark):
    given = texts(random.Random(1))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(given)], "doc_id long, text string, spans string, kind string")
    for r in pii.personal_data(docs).collect():
        t = given[r.doc_id] or ""
        want = base_spans(t)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t[:60], r.spans, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in pii.KINDS]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert pii.personal_data(docs.limit(0)).count() == 0


def plain_votes(kind, body, before, strict):
    number = re.sub("[^0-9]", "", body)
    address = re.fullmatch(rf"{pii.OCTET}(?:\.{pii.OCTET}){{3}}", re.sub(r"[\[\]]", "", body))
    pattern = 1 if strict else {"card": 0 if 16 <= len(number) <= 19 and luhn(number) else -1, "ip": 1 if address else -1}.get(kind, 0)
    listed = {
        "email": bool(re.search(rf"[^a-z](?:{pii.DOMAINS})$", body.lower())),
        "ip": not re.search(r"^0*(?:0|2[3-5][0-9]|22[4-9])[.\[]", body),
        "card": bool(re.search(pii.ISSUERS, number)),
        "phone": bool(re.search(pii.CALLING, number)),
    }[kind]
    listed = 0 if kind == "phone" and not strict else 1 if listed else -1
    context = 1 if re.search(pii.WORDS_FOR[kind], before, re.ASCII) else -1 if re.search(pii.WORDS_AGAINST, before, re.ASCII) else 0
    return (pattern, listed, context), (min(len(number), 20), min(len(re.sub("[A-Za-z0-9]", "", body)), 6))


def plain_spans(given):
    """All spans of each text by loops: votes of every candidate, the estimated reliabilities, the classifier."""
    base, loose, counts = [], [], {}
    for t in given:
        t = t or ""
        base.append([(pii.KINDS.index(k), int(a), int(z)) for k, a, z in (x.split(":") for x in base_spans(t).split(",") if x)])
        loose.append([])
        found = {}
        for k, kind in enumerate(pii.KINDS):
            pattern = pii.LOOSE[kind].removeprefix("(?:\\G|(?<![A-Za-z0-9._%+-]))").replace("++", "+")
            at = 0
            for m in re.finditer(pattern, t, re.ASCII):
                if not any(b == k and x < m.end() and m.start() < z for b, x, z in base[-1]):
                    loose[-1].append((k, *m.span(), t[max(at, m.start() - pii.CONTEXT) : m.start()]))
                at = m.end()
            ends = {0: 0}
            strict = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}[kind]
            at = 0
            for m in re.finditer(strict, t):
                ends[m.start()], at = at, m.end()
            found[k] = ends
        rows = [(k, x, z, t[max(found[k][x], x - pii.CONTEXT) : x], True) for k, x, z in base[-1]] + [(*r, False) for r in loose[-1]]
        for k, x, z, before, strict in rows:
            key = (pii.KINDS[k], *plain_votes(pii.KINDS[k], t[x:z], before, strict))
            counts[key] = counts.get(key, 0) + 1
    by: dict = {}
    for (kind, v, _), n in counts.items():
        by[kind, *v] = by.get((kind, *v), 0) + n
    truth = pii.reliabilities(by)
    w = pii.train_classifier([(pii.features(kind, v, *s), truth[kind, *v], n) for (kind, v, s), n in counts.items()])
    out = []
    for t, b, more in zip(given, base, loose, strict=True):
        kept = [(k, x, z) for k, x, z, before in more if sum(p * q for p, q in zip(w, pii.features(pii.KINDS[k], *(lambda v, s: (v, *s))(*plain_votes(pii.KINDS[k], t[x:z], before, False))), strict=True)) > 0]
        out.append(",".join(f"{pii.KINDS[k]}:{x}:{z}" for k, x, z in sorted(b + kept)))
    return out


def test_added_spans_are_those_of_a_plain_version(spark):
    given = [t for t in texts(random.Random(6)) if len(t or "") < 2000]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    want = plain_spans(given)
    assert [got[i] for i in range(len(given))] == want
    assert sum(len(x.split(",")) for x in want if x) > sum(len(base_spans(t or "").split(",")) for t in given if base_spans(t or ""))


def test_estimation_finds_the_reliable_labelers():
    counts = {("card", 1, 1, 1): 500, ("card", 1, 1, 0): 2000, ("card", -1, -1, 0): 900, ("card", -1, 1, 0): 60, ("card", -1, -1, -1): 200, ("card", 1, -1, 0): 40}
    q = pii.reliabilities(counts)
    assert q["card", 1, 1, 1] > 0.9 and q["card", -1, -1, -1] < 0.1 and q["card", 1, 1, 0] > 0.9
    w = pii.train_classifier([(pii.features("card", k[1:], 16, 0), p, counts[k]) for k, p in q.items()])
    score = lambda v: sum(a * b for a, b in zip(w, pii.features("card", v, 16, 0), strict=True))
    assert score((1, 1, 1)) > 0 > score((-1, -1, -1))


def plain_signature(text):
    w = re.split(r"[ \t-\r]+", text.strip(" \t\n\x0b\f\r")) if text.strip(" \t\n\x0b\f\r") else []
    x = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    long = lambda v: (v & (2**64 - 1)).to_bytes(8, "little")
    seen, rows = {}, []
    kmers = [x((w[i + 1] if i + 1 < len(w) else "").encode(), x(a.encode(), 42)) & (2**33 - 1) for i, a in enumerate(w)]
    for i, h in enumerate(kmers):
        n = seen[h] = seen.get(h, -1) + 1
        v = x(n.to_bytes(4, "little"), x(long(h), 42)) & (2**33 - 1) if n else h
        rows.append((v >> 27, v, i))
    out, least = [], []
    for b in sorted({r[0] for r in rows}):
        least += sorted(r for r in rows if r[0] == b)[:2]
    for j in range(64 if rows else 0):
        turn = lambda r: 0 if r[0] == j else 1 + (x(long(r[0]), x(long(j), 42)) & (2**40 - 1))  # noqa: B023, E731
        h = 42
        for _, v, _ in sorted(sorted(least, key=lambda r: (turn(r), r))[:2], key=lambda r: r[2]):
            h = x(long(v), h)
        out.append((j << 32) | (h & (2**32 - 1)))
    return "".join(f"{s:010x}" for s in out)


def plain_likeness(a, b):
    a, b = ([s[i : i + 10] for i in range(0, len(s), 10)] for s in (a, b))
    return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b)) if a or b else 1.0


def test_fingerprints_equal_plain_order_minhash(spark):
    rng = random.Random(2)
    given = [None, "", " \n", "one", "a a a a a a a a", "lone" * 9000, "yes no " * 5000, "\U0001f600 é x"]
    given += [" ".join(rng.choice(WORDS + ["".join(rng.choices("abc", k=4))]) for _ in range(rng.randint(2, 300))) for _ in range(40)]
    ids = [i * 97 - 900 for i in range(len(given))]
    rows = [(i, t, "x") for i, t in zip(ids, given, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in order_minhash.fingerprints(docs).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, t, _), (_, nxt, _) in zip(order, [*order[1:], order[0]], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == plain_signature(t), t[:40]
        assert got[i].edited_fingerprint == plain_signature(edited)
        assert got[i].near_edited == plain_likeness(plain_signature(t), plain_signature(edited))
        assert got[i].near_next == plain_likeness(plain_signature(t), plain_signature(nxt))


def test_likeness_follows_the_order_in_short_and_long_texts(spark):
    rng = random.Random(3)
    for n in (40, 400):
        w = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
        blocks = [w[i : i + 5] for i in range(0, n, 5)]
        turned = [x for b in reversed(blocks) for x in b]
        swapped = w[: n // 2] + ["other"] + w[n // 2 + 1 :]
        docs = spark.createDataFrame([(3, " ".join(w)), (2, " ".join(turned)), (1, " ".join(w)), (0, " ".join(swapped))], "doc_id long, text string")
        got = {r.doc_id: r.near_next for r in order_minhash.fingerprints(docs).collect()}
        assert got[3] == got[2] < 0.2 and got[1] > 0.6, (n, got)  # 64 bins, which short texts fill from few k-mers


def test_successors_of_sparse_null_and_repeated_ids(spark):
    rng = random.Random(4)
    ids = [None] * 600 + [7] * 5 + [rng.randrange(-(2**63), 2**63) for _ in range(1500)] + list(range(100))
    rows = [(i, f"t{k} {k % 7}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("signature", F.array(F.xxhash64("text")))
    got = order_minhash.with_next(docs).collect()
    text_hash = {r.text: r.signature[0] for r in got}
    order = sorted((i is None, 0 if i is None else -i, text_hash[t] if i is None else 0, t) for i, t in rows)
    order = [x[3] for x in order]
    assert {(r.text, r.next_text) for r in got} == set(zip(order, [*order[1:], order[0]], strict=True)) and len(got) == len(rows)


def test_fingerprints_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (5, "c d", 2), (5, "c d", 2), (2**62, None, 3)], "doc_id long, text string, n_chars int")
    assert order_minhash.fingerprints(docs).count() == 4
    assert order_minhash.fingerprints(docs.limit(1)).first().near_next == 1
    assert order_minhash.fingerprints(docs.limit(0)).count() == 0
