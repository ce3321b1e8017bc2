"""Distinctness and coreference of surrogates where shapes run out, against plain sets."""

import itertools
import re
import string

from riskweave.llm import pii


def test_domains_stay_apart(spark):
    """Every two-letter domain is in use: surrogates need longer ones, no two meet and none is a real one."""
    names = ["".join(x) + ".com" for x in itertools.product(string.ascii_lowercase, repeat=2)]
    df = spark.createDataFrame([(i, f"{who}@{d}" + (f" {who.upper()}@{d.upper()}" if i % 50 == 0 else "")) for i, d in enumerate(names) for who in ("anna", "bob")], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in pii.replaced(df).collect()]
    made = {}
    for i, text in got:
        first, *more = text.split(" ")
        made.setdefault(i, set()).add(first.split("@")[1])
        assert all(m == first.upper() for m in more)
    assert all(len(x) == 1 for x in made.values())  # people of one domain stay together
    hosts = [next(iter(x)) for x in made.values()]
    assert len(set(hosts)) == len(names) == 676 and not set(hosts) & set(names) and all(h.endswith(".com") for h in hosts)
    assert len({t.split(" ")[0] for _, t in got}) == 2 * 676


def test_full_mailboxes_end(spark):
    """All one-letter mailboxes of a domain, repeated rows too."""
    df = spark.createDataFrame([(i, f"to {c}@firm.org, {c}@firm.org") for i, c in enumerate(string.ascii_lowercase * 2)], "doc_id long, text string")
    texts = [r.text for r in pii.replaced(df).orderBy("doc_id").collect()]
    made = [re.findall(r"[\w]+@[\w.]+", t) for t in texts]
    assert all(len(m) == 2 and m[0] == m[1] for m in made) and texts[:26] == texts[26:]
    assert len({m[0] for m in made}) == 26 and len({m[0].split("@")[1] for m in made}) == 1


def test_phones_with_and_without_country_code(spark):
    df = spark.createDataFrame([(0, "212-555-0199"), (1, "+1 (212) 555-0199"), (2, "+1 212 555 0199"), (3, "+44 20 7946 0958"), (4, "(212) 555-0198")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replaced(df).collect()}
    digits = {i: re.sub("[^0-9]", "", t) for i, t in got.items()}
    assert "1" + digits[0] == digits[1] == digits[2] and digits[0] != "2125550199" and digits[4] != digits[0]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1]) and re.fullmatch(r"\d{3}-\d{3}-\d{4}", got[0]) and re.fullmatch(r"\+4\d \d\d \d{4} \d{4}", got[3])


def test_brute_force(spark):
    """Mentions of one entity become one surrogate, of two entities two, over all types; what stands around them stays."""
    lower = lambda x: x.lower()
    kinds = {
        "email": (lower, [f"{a}{b}@{h}.net" for a in "ab" for b in "xy" for h in ("k", "l")] + ["AX@K.NET"]), "ip": (str, [f"10.0.0.{i}" for i in range(1, 6)]),
        "ssn": (lambda x: x, [f"123-45-678{i}" for i in range(5)]), "card": (lambda x: re.sub("[^0-9]", "", x), ["4111 1111 1111 1111", "4111111111111111", "5500 0000 0000 0004"]),
        "name": (lambda x: x.split(" ", 1)[1].lower(), ["Mr. John Smith", "Mister John Smith", "Mr. Jim Smith", "Mrs. Ann Smith"]),
    }
    rows, want = [], []
    for kind, (norm, values) in kinds.items():
        for v in values:
            rows.append((len(rows), f"<< {v} >>"))
            want.append((kind, norm(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [r.text for r in pii.replaced(df).orderBy("doc_id").collect()]
    assert all(t.startswith("<< ") and t.endswith(" >>") and t != o for t, (_, o) in zip(texts, rows, strict=True))
    made = [(k, kinds[k][0](t[3:-3])) for t, (k, _) in zip(texts, want, strict=True)]
    assert all((a == b) == (x == y) for (a, x), (b, y) in itertools.combinations(list(zip(want, made, strict=True)), 2))
