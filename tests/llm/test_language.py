import numpy as np

from figureyard.llm import language as lg


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in lg.new_network(4, 3, 2).items()}
    lg.closed_gate(net)
    x = r.integers(97, 101, (6, 5))
    x[4:, 2] = lg.PAD
    label = np.array([0, 1, 2, 1, 0])
    grad, _ = lg.gradients(net, x, label)
    for k in ("inf", "ref", "outb", "reb", "inb", "bias"):
        for at in [np.unravel_index(i, net[k].shape) for i in r.integers(0, net[k].size, 6)]:
            if k.startswith("in"):
                at = (int(r.integers(97, 101)), at[1])
            old, ends = net[k][at], []
            for step in (1e-3, -1e-3):
                net[k][at] = old + step
                ends.append(lg.gradients(net, x, label)[1])
            net[k][at] = old
            assert abs((ends[0] - ends[1]) / 2e-3 - grad[k][at]) < 2e-4


def test_labelling_runs_the_same_network():
    net = lg.new_network(5, 4, 3)
    lg.closed_gate(net)
    texts = [b"hello there", b"x", bytes(range(256)) * 3, b""]
    got = lg.pooled(lg.halved(net), texts, 4)
    for t, g in zip(texts, got):
        sums = np.zeros(4)
        for s in range(0, len(t), lg.WINDOW):
            x = np.frombuffer(t[s : s + lg.WINDOW], np.uint8).astype(np.int64)[:, None]
            p = lg.probabilities(net, lg.states(net, "f", x)[0], lg.states(net, "b", x)[0])
            sums += p.sum((0, 1))
        assert np.allclose(g, sums / max(1, len(t)), atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lg.predicted(docs, fit=lg.Fit(steps=250)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = lg.predicted(odd_docs, fit=lg.Fit(steps=5)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count()
    assert by[2].lang_pred == by[3].lang_pred == by[5].lang_pred == "und" and by[2].score == 0
    assert by[4].lang_pred in ("en", "de", "fr") and 0 <= by[4].score <= 1
    assert lg.predicted(no_docs).count() == 0
    unknown = lg.predicted(odd_docs.withColumn("lang", odd_docs.lang.substr(9, 1)).where("lang <> ''")).count()
    assert unknown == 0
