import numpy as np

from kinfold.llm import toxicity


def naive_grams(text):
    t = f" {text.lower()} "
    return {t[i : i + n] for n in toxicity.SIZES for i in range(len(t) - n + 1)}


def test_grams_cover_the_whole_text(monkeypatch):
    text = "Añ ß日本 \U0001f600 abc def ghi jkl"
    whole = {int(x) for g in toxicity.grams(text) for x in g}
    assert len(whole) == len(naive_grams(text))
    monkeypatch.setattr(toxicity, "PART", 7)
    assert {int(x) for g in toxicity.grams(text) for x in g} == whole
    assert not [g for g in toxicity.grams("") if len(g)]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.op9_query(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 80 and held.score.between(0, 1).all()
    assert (held.predicted == held.toxic).mean() > 0.93
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()
    again = toxicity.op9_query(docs, labels).join(labels, "doc_id").toPandas()
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score)


def test_odd_rows(spark):
    words = ["kind", "calm", "field", "river", "stone", "light"]
    rows = [(i, " ".join(words[(i * j) % 6] for j in range(1, 30)) + (" badword " if i % 4 == 0 else "")) for i in range(300)]
    odd = [(None, "badword"), (900, None), (901, ""), (902, " x"), (902, " x"), (903, "river stone " * 60_000 + "badword")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 as score", "2 as toxic")
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(300)] + [(None, 1), (5, None), (7, 0), (7, 0)], "doc_id long, toxic int")
    got = toxicity.op9_query(docs, labels).collect()
    assert len(got) == 306
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == by[903].predicted == 1
    assert not any(by[k].predicted for k in (900, 901, 902))
    assert by[900].score == by[901].score
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 300)
    assert toxicity.op9_query(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.op9_query(docs, labels.limit(0)).collect()} == {0.5}


def test_counts_and_scores_by_hand(spark):
    """Features, their counts, G statistics, ratios and scores recomputed from sets of substrings."""
    import math
    import random

    r = random.Random(3)
    rows = [(" ".join(r.choice(["bad", "mad", "Calm", "RIVER", "stone", "añ"]) for _ in range(r.randint(0, 12))), r.random() < 0.4) for _ in range(200)]
    rows = [(t + (" idiot" if toxic and r.random() < 0.8 else ""), int(toxic)) for t, toxic in rows]
    df = spark.createDataFrame(rows, "text string, toxic int")
    seen = {}
    for t, toxic in rows:
        for g in naive_grams(t):
            seen.setdefault(g, [0, 0])[1 - toxic] += 1
    of = {}
    for g in seen:  # the bucket of a gram: what a text of it has and its inner part has not
        p = np.frombuffer(g.encode("utf-32-le"), "<u4").astype(np.uint64)
        h = p[:1]
        for x in p[1:]:
            h = h * np.uint64(0x9E3779B97F4A7C15) + x
        of[g] = int((toxicity.mix(h + np.uint64(len(g))) >> np.uint64(64 - toxicity.BITS))[0])
    assert len(set(of.values())) == len(of)
    got = {x.bucket: (x.pos, x.neg) for x in toxicity.count_features(df).collect()}
    assert got == {of[g]: tuple(n) for g, n in seen.items()}
    pos = sum(t for _, t in rows)
    neg = len(rows) - pos

    def g_of(p, q):
        table = [(p, pos), (q, neg)]
        out = 0
        for have, total in table:
            for n, share in ((have, (p + q) / (pos + neg)), (total - have, 1 - (p + q) / (pos + neg))):
                out += 2 * n * math.log(n / (total * share)) if n else 0
        return out

    model = toxicity.fit(df)
    assert set(model.buckets.tolist()) == {of[g] for g, (p, q) in seen.items() if p + q > 1 and g_of(p, q) >= toxicity.MIN_G}
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    for row in toxicity.score(df.withColumn("score", toxicity.F.lit("old")), model).collect():
        z = model.intercept + sum(weight.get(of[g], 0.0) for g in naive_grams(row.text))
        assert math.isclose(row.score, 1 / (1 + math.exp(-z)), abs_tol=1e-9)


def test_one_row_for_each_labelled_document(spark):
    docs = spark.createDataFrame([(i % 2, f"text {i}") for i in range(2_000)] + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (7, 1)], "doc_id long, toxic int")
    got = sorted(((r.text, r.toxic) for r in toxicity.training_rows(docs, labels).collect()), key=str)
    assert got == [("text 0", 1), ("text 1", 0), (None, 1)]
    assert toxicity.training_rows(docs, labels, max_rows=2).count() == 2
