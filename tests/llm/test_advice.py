"""Cases that a review of the corpus operators named."""

import random

import numpy as np

import corpus_pipeline
from granary.llm import mixing, secrets, simhash, toxicity


def test_short_and_broken_secrets(spark):
    hidden = [
        ("set password = hunter2pass in the file", "hunter2pass"),
        ("pwd: Tr0ub4dor&3x", "Tr0ub4dor&3x"),
        ("see user:s3cret@host now", "s3cret"),
        ("postgres://app:k9#mQ2x@db.local/main", "k9#mQ2x"),
        ('{"password": "kL8!vz, 2pQ"}', "kL8!vz, 2pQ"),
        ("é DB_PASSWORD=x7Gh2kQ9;Server=a", "x7Gh2kQ9"),
        ("password = abcdefgh1jklmnop&x7", "abcdefgh1jklmnop&x7"),
    ]
    plain = ["password: required", "password = ${DB_PASSWORD}", "mailto:jane.doe@x.org", "passwd: ********", "tokens: 128", "the secret: he knew"]
    texts = [t for t, _ in hidden] + plain
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.scan(df).collect()
    told = {(r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]]) for r in rows if r["secret"]}
    assert {(i, v) for i, (_, v) in enumerate(hidden)} <= told
    assert all(d < len(hidden) for d, _ in told)
    # Look-alikes are candidates that the forest judges.
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))


def test_rare_insults_enter_the_vocabulary():
    g = random.Random(9)
    spelt = lambda: "".join(g.choice("abcdefgh") for _ in range(7))
    common, insults = [spelt() for _ in range(300)], [spelt() for _ in range(40)]
    rows = []
    for i in range(2000):
        text = [g.choice(common) for _ in range(30)]
        if i % 2:
            text[g.randrange(30)] = insults[(i // 2) % 40]
        rows.append((" ".join(text).encode(), i % 2))
    labels = np.array([y for _, y in rows])
    net = toxicity.fit([t for t, _ in rows[:1600]], labels[:1600])
    # Each insult is in about 1 % of the documents learned from, and in none that is clean.
    assert {w.encode() for w in insults} <= set(net.vocabulary)
    right = (net.probabilities([t for t, _ in rows[1600:]]) >= 0.5) == labels[1600:]
    assert right.mean() > 0.9


def test_passages_lie_whole_in_a_window():
    for n in range(25, 400):
        starts = toxicity.window_starts(n)
        assert all(any(s <= p and p + 25 <= s + toxicity.WINDOW for s in starts) for p in range(n - 24))


def test_one_id_on_two_texts_keeps_both_groups(spark):
    g = random.Random(2)
    a, b, c = (" ".join(g.choice("abcdefghij") * 3 + str(g.randrange(99)) for _ in range(60)) for _ in range(3))
    rows = [(1, a, 0), (1, b, 1), (2, b, 2), (3, a, 3), (None, c, 4), (None, c, 5), (None, a, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b), (0, c)])


def test_realised_weights_show_what_a_long_document_costs(spark):
    rows = [(i, "w " * 10, "large") for i in range(200)] + [(1000, "w " * 900, "small"), (1001, "w " * 5, "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["source"]: r["n"] for r in mixing.mix(df, budget=0.5).groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    told = {r["source"]: r for r in mixing.realised(df, budget=0.5).collect()}
    assert set(told) == {"large", "small"}
    for source, r in told.items():
        assert r["taken"] == taken.get(source, 0) and r["shortfall"] == r["budget"] - r["taken"] >= 0
        assert abs(r["realised"] - r["taken"] / sum(taken.values())) < 1e-12
    assert told["small"]["shortfall"] > 0.9 * told["small"]["budget"] and told["small"]["realised"] < 0.1 * told["small"]["weight"]


def test_run_writes_every_stage(spark, sf, monkeypatch):
    wrote = []
    monkeypatch.setattr(corpus_pipeline, "saved", lambda df, name: wrote.append(name) or df.limit(20))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, lambda spark, docs, sf_dir: docs) for name, _ in corpus_pipeline.STAGES])
    assert corpus_pipeline.run(spark, sf).count() == 20
    assert wrote == ["stage-quality", "stage-simhash", "stage-pii", "stage-mixing"]
