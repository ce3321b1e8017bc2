import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    """Planted cases against what each stage must do: toxic documents and copies go, clean ones stay, secrets are replaced, ids decode."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        t = text(120)
        if i % 5 == 0:
            t = " ".join("vilest" if j % 20 == 7 else w for j, w in enumerate(t.split()))
        rows.append([i, t, "en", f"s{i % 4}", len(t)])
        labels.append((i, 1, int(i % 5 == 0)))
    for i in range(300, 310):  # exact and near copies of clean documents
        w = rows[i - 299][1].split() if (i - 299) % 5 else rows[i - 298][1].split()
        if i % 2:
            w[60] = "changed"
        rows.append([i, " ".join(w), "en", "s1", 0])
    rows[7][1] += " mail x.y@mail.example.com"
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
    names = list(seen)
    ids = [{r.doc_id for r in seen[n]} for n in names]
    assert ids[0] == {r[0] for r in rows if r[0] >= 300 or r[0] % 5}
    assert ids[1] == {i for i in ids[0] if i < 300} and ids[2] == ids[1]
    assert not any("x.y@mail" in r.text for r in seen[names[2]]) and all(r.n_chars == len(r.text) for r in seen[names[2]])
    assert ids[3] <= ids[2] and all(r.exact and r.n_tokens > 0 for r in seen[names[4]])
    assert pipeline.run(spark, str(tmp_path)).count() == len(seen[names[4]])
