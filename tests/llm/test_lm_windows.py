"""op8 learns from every window of all training text."""

import numpy as np
import pyarrow as pa

from tallymark.llm import lm
from tallymark.llm.common import Scratch
from tallymark.llm.queries import MODEL, vocabulary


def test_windows_of_all_text(spark, monkeypatch):
    words = [" ".join(f"w{i * 7919 % 977}" for i in range(n)) for n in (5000, 3000, 3)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    path, seen = vocabulary(MODEL), []
    monkeypatch.setattr(lm, "FEW", 1, raising=False)
    monkeypatch.setattr(lm, "_learn", lambda windows, *rest: seen.append(windows.collect()))
    lm.fit(docs, docs.doc_id >= 0, path, Scratch(spark, "t"), steps=3)
    *_, size = lm._spelled(path, pa.array(words))
    assert len(seen[0]) == sum(-(-int(n) // lm.STRIDE) for n in size)
    rows = np.frombuffer(b"".join(r.w for r in seen[0]), dtype=np.int32).reshape(-1, lm.SPAN + 1)
    assert (rows[:, lm.CONTEXT + 1 :] < lm.codec(path).size).sum() == size.sum()  # every token is a target once


def test_every_window_is_read(monkeypatch):
    net, read = lm.Attention(8, inputs=400), set()
    states = net.states
    net.states = lambda x: read.update(x[:, 0].tolist()) or states(x)
    x = np.repeat(np.arange(400)[:, None], lm.SPAN, axis=1)
    net.train(x, x[:, lm.CONTEXT :] % 8, steps=5, batch=96)
    assert len(read) == 400


def test_places_take_two_short_sums():
    net, r = lm.Attention(191, inputs=300), np.random.default_rng(0)
    x, y = r.integers(0, 301, (6, lm.SPAN)), r.integers(0, 191, (6, lm.STRIDE))
    x[0, :5], y[0, -3:] = net.pad, -1
    assert np.allclose(sum(np.exp(net.log_probs(x, np.full(y.shape, k))) for k in range(191)), 1, atol=1e-4)
    assert max(net.p["U"].shape[1], net.p["W"].shape[2]) <= 2 * 191**0.5 + 1
    slopes, read, of_read = net._slope(x, y)
    slopes["E"] = np.zeros_like(net.p["E"])
    slopes["E"][read] = of_read
    loss = lambda: -net.log_probs(x, np.maximum(y, 0))[y >= 0].astype(float).mean()
    for name, slope in slopes.items():  # against differences
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        was = net.p[name][at]
        net.p[name][at] = was + 0.01
        more = loss()
        net.p[name][at] = was - 0.01
        assert abs((more - loss()) / 0.02 / slope[at] - 1) < 0.05, name
        net.p[name][at] = was
    net.p["Q"] *= 1e4  # far out of range
    assert np.isfinite(net.log_probs(x, np.maximum(y, 0))).all()
