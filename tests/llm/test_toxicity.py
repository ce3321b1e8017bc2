"""Toxicity: the choice of prefixes against brute force, unseen word forms, copies, and columns with clashing names."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskweave.llm import toxicity


def brute_telling(rows, nt, nc):
    """Over all words of every prefix, from whole words down to the shortest prefixes."""
    found, taken, branches = {}, {}, {}
    need = toxicity.LEAST_ROOT**2

    def lean(t, c, nt, nc):
        return 2 * sum(x * math.log(x / ((t + c) * of / (nt + nc))) for x, of in ((t, nt), (c, nc)) if x)

    for k in (0, *toxicity.PREFIXES):
        for n in {w + toxicity.END if not k else w[:k] for w, _, _ in rows if not k or len(w) > k}:
            own = [r for r in rows if (r[0] + toxicity.END == n if not k else len(r[0]) > k and r[0].startswith(n))]
            rest = [r for r in own if r[0] not in taken]
            total, left = (tuple(sum(r[i] for r in x) for i in (1, 2)) for x in (own, rest))
            uses, gone = left, (total[0] - left[0], total[1] - left[1])
            if branches.get(n, 0) > 1 and lean(*left, *total) + lean(*gone, *total) < need:
                uses = total
            count = branches.get(n, 0)
            if sum(uses) and lean(*uses, nt, nc) >= need:
                found[n], count = uses, 1
                taken |= {r[0]: n for r in rest}
            up = next((n.removesuffix(toxicity.END)[:j] for j in toxicity.PREFIXES if j < len(n.removesuffix(toxicity.END))), None)
            if up:
                branches[up] = branches.get(up, 0) + count
    return found


def test_telling_prefixes(spark):
    rng = random.Random(3)
    rows = {}
    for _ in range(400):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 11)))
        bad = w.startswith(("abca", "cc"))
        rows[w] = (float(rng.randrange(0, 9 if bad else 2)), float(rng.randrange(0, 2 if bad else 9)))
    rows = [(w, t, c) for w, (t, c) in rows.items()]
    nt, nc = sum(r[1] for r in rows), sum(r[2] for r in rows)
    got = toxicity.telling(spark.createDataFrame(rows, "word string, t double, c double"), nt, nc)
    want = brute_telling(rows, nt, nc)
    assert len(want) > 10 and any(not n.endswith(toxicity.END) for n in want)
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n]) for n in got)


def forms(spark, n=300):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(60)] = f"vilen{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    # one clean-looking text, toxic by label, copied many times
    copied = " ".join(f"c{j}" for j in range(60))
    for i in range(n, n + 40):
        rows.append((i, copied))
        labels.append((i, 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_forms_that_no_label_has_seen_and_copies(spark):
    docs, labels = forms(spark)
    m = toxicity.fit(docs, labels)
    fresh = spark.createDataFrame([(1, "w1 w2 vilenXYZ w3 vilenABC w5 vilenQ w7"), (2, "w1 w2 w3 w5 w7 w8 w9"), (3, "c1 w2 c3 w5")], "doc_id long, text string")
    got = {r.doc_id: r.toxic_score for r in toxicity.scored(fresh, m).collect()}
    assert got[1] >= 0.3 > got[2] and got[3] < 0.3


def test_clashing_columns(spark, docs, labels):
    odd = docs.withColumns({"toxic_score": F.lit("mine"), "toxic_passages": F.lit(7), "y": F.lit(1), "n": F.lit(2)})
    kept = toxicity.keep_clean(odd, labels)
    assert kept.columns == odd.columns and all(r.toxic_score == "mine" and r.toxic_passages == 7 for r in kept.collect())
    got = toxicity.scored(odd, toxicity.fit(odd, labels))
    assert got.columns[-2:] == ["toxic_score", "toxic_passages"] and got.count() == docs.count() and dict(got.dtypes)["toxic_score"] == "double"
