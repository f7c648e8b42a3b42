import hashlib
import re

from stringloom.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


ODD = [
    None, "", "a@b.c_d@e.f a@b.c..x@y.z a@b a@b.c. @b.c a@-.- x%+@q.r", "1.2.3.4.5 256.1.1.1 001.2.3.255 1.2.3 00000000255.1.1.1 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 x 4111-1111-1111-1111-2 4111  1111 1111 1111 12345678901234 378282246310005 6 4222222222222", "+1 (209) 555-1594. +12 +1 2 3 4 5 6 7 8 9 0 ++12345678901 +1-2-3(", "é" * 50 + " x@y.zz 日本 1.2.3.4 😀 q@r.st",
    "1 " * 3000, "a." * 3000 + "@b" + ".c" * 3000, "1" * 4000, "x" * 50_000, "+" * 300 + "+1" + "(" * 900 + "5", "1.1.1.1 4242 4242 4242 4242 me@x.yz +12345678901",
]


def test_base_spans(spark):
    rows = list(enumerate(ODD)) + [(3, "q@w.er twice"), (3, "q@w.er twice")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")
    got = sorted((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.digest(pii.find(df)).collect())
    want = sorted((i, hashlib.sha256(base(t).encode()).hexdigest(), *(len(re.findall(f"{k}:", base(t))) for k in pii.KINDS)) for i, t in rows)
    assert got == want
    assert pii.digest(pii.find(df.limit(0))).count() == 0


def test_contexts_lead_to_unseen_identifiers(spark):
    rows = [(i, f"please write mail to user{i}@x.org today") for i in range(8)] + [(i + 20, f"reach us: call home +1 209 555 1{i:03} now") for i in range(6)]
    rows += [(50, "please write mail to kx77-aa91 today"), (51, "the total was 1234 items"), (52, "again kx77-aa91 here")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[50] == "other:21:30" and got[52] == "other:6:15" and got[51] == "" and got[0] == "email:21:32"


def test_context_at_the_start_of_a_text_and_after(spark):
    rows = [(300 + i, f"mail user{i}@x.org") for i in range(30)] + [(50, "mail kx77-aa91"), (51, "total kx78-aa91")]
    rows += [(100 + i, f"so 10.0.0.{i}, our gateway") for i in range(10)] + [(150, "at ab-17-cd, our gateway"), (151, "at ab-18-cd, your door")]
    rows += [(200 + i, f'then token = "{i:040x}abcdef" was') for i in range(12)] + [(250, 'or token = "plain-123" was'), (251, "the hash " + "0a" * 20)]
    got = {r["doc_id"]: r for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[50]["spans"] == "other:5:14" and got[51]["spans"] == "" and got[150]["spans"] == "other:3:11" and got[151]["spans"] == ""
    assert got[250]["spans"] == "other:12:21" and got[203]["spans"] == "other:14:60" and got[251]["spans"] == "" and got[203]["n_other"] == got[203]["n_spans"] == 1


def test_discoveries_are_the_planted_ones(spark):
    """Identifiers of no base form, planted where known ones stand, among as many other numbers: found, and nothing else."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    some = lambda n: " ".join(word() for _ in range(n))
    known = ["write to {} soon", "from host {} came", "call {} today", "card no {} paid"]
    make = [lambda: f"{word()}@x{rng.randrange(99)}.org", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: f"+1 209 555 {rng.randrange(1000, 9999)}", lambda: "4242424242424242"]
    rows, planted = [], set()
    for i in range(300):
        k = rng.randrange(3)
        if i % 10 == 0:
            name = f"{word()}-{rng.randrange(100, 999)}"
            planted.add(name)
            body = known[k].format(name)
        elif i % 10 < 3:
            body = f"{word()} {rng.randrange(1000, 99999)} {word()}"
        else:
            body = known[k].format(make[k]())
        rows.append((i, f"{some(4)} {body} {some(4)}"))
    text = dict(rows)
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    found = {text[i][int(a) : int(b)] for i, x in spans.items() for kind, a, b in (y.split(":") for y in x.split(",") if y) if kind == "other"}
    assert len(found & planted) >= 0.95 * len(planted) and len(found - planted) <= 0.05 * len(planted)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é me@x.yz, call +12345678901!", 3, "s"), (2, "clean", 5, "s"), (3, None, None, "s")], "doc_id long, text string, n_chars long, key string")
    got = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert got[1]["text"] == "é <EMAIL>, call <PHONE>!" and got[1]["n_chars"] == 24 and got[2]["text"] == "clean" and got[3]["text"] is None
    assert pii.redact(df).columns == df.columns
    odd = spark.createDataFrame([(1, "to me@x.yz", 7, 8, 9)], "doc_id long, text string, _hits int, _key int, `a.b` int")
    assert [tuple(r) for r in pii.redact(odd).collect()] == [(1, "to <EMAIL>", 7, 8, 9)] and pii.redact(odd).columns == odd.columns


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op1_pii(spark, sf).collect():
        assert r["base_sha256"] == hashlib.sha256(base(docs[r["doc_id"]]).encode()).hexdigest()
        assert set(filter(None, base(docs[r["doc_id"]]).split(","))) <= set(r["spans"].split(","))
