"""The network learns from all learning rows, whatever the size of the first sample."""

import copy

import numpy as np
import pyarrow as pa
import pytest

from rillview.llm import language_model


def test_rows_beyond_the_sample_count(spark):
    """Words and transitions of rows that the first sample leaves out, even if it is all but empty."""
    made = [" ".join(["left", "right", "up", "down"][(i + k) % 4] for k in range(60)) for i in range(400)]
    docs = spark.createDataFrame(enumerate(made), "doc_id long, text string").repartition(2)
    got = language_model.log_likelihoods(docs, sample=1, model_words=64).collect()
    assert np.mean([r["score"] - r["base_score"] for r in got if r["held_out"]]) > 3


def test_every_token_is_read_once():
    net, seen = language_model.Gru(64), []
    net._window = lambda grid, h: (seen.append(grid[:, 1:].copy()), h)[1]
    stream = np.arange(2, 62).repeat(11)
    net.read(stream, lanes=8, steps=16)
    assert np.array_equal(np.hstack(seen).reshape(-1)[: len(stream)], stream)


def small_net():
    net = language_model.Gru(50, hidden=5, per_class=8, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["u"] += 0.5 * np.random.default_rng(2).standard_normal(net.p["u"].shape)
    return net


def by_hand(net, text):
    """log10 probability of a text, one token at a time, by the formulas."""
    p, k, h, was, total = net.p, net.h, np.zeros(net.h), language_model.END, 0.0
    for w in text:
        x, hu = p["x"][was], h @ p["u"]
        r, z = 1 / (1 + np.exp(-(x[:k] + hu[:k]))), 1 / (1 + np.exp(-(x[k : 2 * k] + hu[k : 2 * k])))
        h = (1 - z) * np.tanh(x[2 * k :] + r * hu[2 * k :]) + z * h
        c, i = divmod(w, net.per)
        of_class, of_word = np.exp(h @ p["c"] + p["cb"]), np.exp(h @ p["w"][c] + p["wb"][c])
        total += np.log10(of_class[c] / of_class.sum() * of_word[i] / of_word.sum())
        was = w
    return total


def test_scores_equal_the_formulas():
    net, rng = small_net(), np.random.default_rng(4)
    texts = [np.append(rng.integers(2, 50, n), language_model.END) for n in (0, 1, 31, 32, 33, 200)]
    assert np.allclose(net.score(texts), [by_hand(net, t) for t in texts], rtol=1e-5)


def test_large_logits_do_not_overflow():
    net = language_model.Gru(50)
    net.p["cb"] += np.float32(500)
    net.p["wb"] += np.float32(500)
    assert np.isfinite(net.score([np.array([5, 9, language_model.END])])).all()


def test_gradients_equal_finite_differences():
    net, rng = small_net(), np.random.default_rng(5)
    grid = rng.integers(1, 50, (3, 6))

    def loss():
        h, total = np.zeros((3, net.h)), 0.0
        for t in range(5):
            h = net.step(net.p["x"][grid[:, t]], np.where((grid[:, t] == language_model.END)[:, None], 0, h))[0]
            total -= net.log_probs(h, grid[:, t + 1]).sum()
        return total

    g, words, _ = net.gradients(grid, np.zeros((3, net.h)))
    for key, v in g.items():
        flat = v.reshape(-1)
        for at in rng.choice(len(flat), min(12, len(flat)), replace=False):
            place = np.unravel_index(at, v.shape)
            own = (words[place[0]], *place[1:]) if key == "x" else place
            net.p[key][own] += 1e-5
            up = loss()
            net.p[key][own] -= 2e-5
            down = loss()
            net.p[key][own] += 1e-5
            assert abs((up - down) / 2e-5 - flat[at]) < 1e-4, key


def test_scores_of_many_windows_meet_the_output_layer_together():
    net, rng, sizes = language_model.Gru(5000, per_class=71), np.random.default_rng(6), []
    texts = [np.append(rng.integers(2, 5000, n), language_model.END) for n in [3000, *[400] * 60]]
    plain, net.log_probs = net.log_probs, lambda h, *rest: (sizes.append(len(h)), plain(h, *rest))[1]
    got = net.score(texts)
    assert sum(sizes) == sum(map(len, texts)) and len(sizes) <= 2
    assert np.allclose(got, [by_hand(net, t) for t in texts], rtol=1e-4)


def test_large_logits_leave_gradients_as_they_are():
    net, grid = small_net(), np.random.default_rng(7).integers(1, 50, (3, 6))
    before = net.gradients(grid, np.zeros((3, net.h)))[0]
    net.p["cb"] += 500.0
    net.p["wb"] -= 900.0
    after = net.gradients(grid, np.zeros((3, net.h)))[0]
    assert all(np.allclose(before[k], after[k], atol=1e-9) for k in before)


def deep_net():
    net = language_model.Gru(50, hidden=5, per_class=4, seed=1, per_group=3, width=6)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["u"] += 0.5 * np.random.default_rng(2).standard_normal(net.p["u"].shape)
    return net


def test_words_below_groups_sum_to_one_and_score_by_the_formulas():
    net, rng = deep_net(), np.random.default_rng(8)
    p, k = net.p, net.h

    def plain(h, w):
        c, i = divmod(w, net.per)
        g, j = divmod(c, net.per_group)
        levels = ((h @ p["g"] + p["gb"], g), (h @ p["c"][g] + p["cb"][g], j), (h @ p["w"][c] + p["wb"][c], i))
        return sum(a[at] - np.log(np.exp(a).sum()) for a, at in levels)

    def score(text):
        h, was, total = np.zeros(k), language_model.END, 0.0
        for w in text:
            x, hu = p["x"][was] @ p["v"] + p["b"], h @ p["u"]
            r, z = 1 / (1 + np.exp(-(x[:k] + hu[:k]))), 1 / (1 + np.exp(-(x[k : 2 * k] + hu[k : 2 * k])))
            h = (1 - z) * np.tanh(x[2 * k :] + r * hu[2 * k :]) + z * h
            total += plain(h, w) / np.log(10)
            was = w
        return total

    h = rng.standard_normal((1, k))
    assert abs(sum(np.exp(net.log_probs(h, np.array([w]))[0]) for w in range(50)) - 1) < 1e-6
    texts = [np.append(rng.integers(2, 50, n), language_model.END) for n in (0, 1, 33, 200)]
    assert np.allclose(net.score(texts), [score(t) for t in texts], rtol=1e-5)


def test_gradients_through_groups_and_narrow_words_equal_finite_differences():
    net, rng = deep_net(), np.random.default_rng(5)
    grid = rng.integers(1, 50, (3, 6))

    def loss():
        h, total = np.zeros((3, net.h)), 0.0
        for t in range(5):
            h = net.step(net.inputs(net.p["x"][grid[:, t]]), np.where((grid[:, t] == language_model.END)[:, None], 0, h))[0]
            total -= net.log_probs(h, grid[:, t + 1]).sum()
        return total

    g, words, _ = net.gradients(grid, np.zeros((3, net.h)))
    assert set(g) == set(net.p)
    for key, v in g.items():
        for at in rng.choice(v.size, min(12, v.size), replace=False):
            place = np.unravel_index(at, v.shape)
            own = (words[place[0]], *place[1:]) if key == "x" else place
            net.p[key][own] += 1e-5
            up = loss()
            net.p[key][own] -= 2e-5
            down = loss()
            net.p[key][own] += 1e-5
            assert abs((up - down) / 2e-5 - v[place]) < 1e-4, key


@pytest.mark.parametrize("words", [2, 40, 4096, 35_000])
def test_a_token_costs_few_logits(words):
    """The check's table has 35,000 words, of which a token met 375 logits."""
    model = language_model.Model(pa.array([f"w{i}" for i in range(words)]), 1 << 20)
    assert sum(w.shape[2] for w in model.gru.output()[0]) <= 150


def test_models_stay_few_when_partitions_are_many(spark):
    """One model that reads the rows of eight partitions, none left out, comes to what it reads at once."""
    text = " ".join(f"w{i % 7}" for i in range(50))
    model = language_model.Model(pa.array([f"w{i}" for i in range(7)]), 64)
    want = copy.deepcopy(model.gru)
    want.read(model.stream(pa.array([text] * 8)), 8, language_model.STEPS // 2)
    language_model.learn_all(model, spark.createDataFrame([(text,)] * 8, "text string").repartition(8), 8, 1)
    assert all(np.allclose(model.gru.p[k], v, atol=2e-3) for k, v in want.p.items())


def test_tokens_are_those_of_bytes():
    texts = [None, "", " \t\n", "A B \x0bC\x0cD\r\x1cE\x85F\u2003g \xc4\xd6 \u0130", " lead  trail ", "a\xa0b\x00c", "\U0001f600 Z"]
    want = [(t or "").encode().lower().split() for t in texts]
    for whole, lo in ((texts, 0), ([*texts, "more"], 1)):
        words, edges = language_model.cut(pa.array(whole)[lo : len(texts)])
        got = [w.encode() for w in words.to_pylist()]
        assert [got[a:b] for a, b in zip(edges, edges[1:])] == want[lo:]
    assert language_model.cut(pa.array(["A b"], pa.large_string()))[0].to_pylist() == ["a", "b"]
