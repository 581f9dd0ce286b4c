"""Layers against NumPy on small tensors."""

import numpy as np
import pytest

from zonecast.operators import layers

R = np.random.default_rng(8)


def conv(x, w, b, steps, dilation):
    """x: (T, C); w: [out][in * steps + step]"""
    padded = np.concatenate([np.zeros(((steps - 1) * dilation, x.shape[1])), x])
    w = np.array(w).reshape(len(w), x.shape[1], steps)
    return np.array([[b[o] + sum(w[o, c, s] * padded[t + s * dilation, c] for c in range(x.shape[1]) for s in range(steps)) for o in range(len(w))] for t in range(len(x))])


def gated(x, layer):
    f, s, g = (conv(x, w, b, layer.steps, layer.dilation) for w, b in zip((layer.first, layer.second, layer.gate), layer.biases, strict=True))
    g = 1 / (1 + np.exp(-g))
    return g * f + (1 - g) * s


def made(inputs, outputs, dilation, steps=3):
    m = lambda: R.normal(size=(outputs, inputs * steps)).tolist()
    return layers.Convolution(steps, dilation, m(), m(), m(), tuple(R.normal(size=outputs).tolist() for _ in range(3)))


@pytest.mark.parametrize("widths", [(2, 4, 3), (3, 2, 3)])
def test_stack(spark, widths):
    a, b, c = widths
    parts = [made(a, b, 1), made(b, c, 2)]
    gains, shifts = [R.normal(size=n).tolist() for n in (b, c)], [R.normal(size=n).tolist() for n in (b, c)]
    skip, bias = (R.normal(size=(c, a)).tolist(), R.normal(size=c).tolist()) if a != c else (None, None)
    stack = layers.Stack(parts, gains, shifts, skip, bias)
    data = {i: R.normal(size=(t, a)) for i, t in enumerate((1, 2, 7, 12))}
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in data.items()], "i int, h array<array<double>>")
    for r in stack(rows, "h", "out").collect():
        x = y = data[r.i]
        for layer, g, s in zip(parts, gains, shifts, strict=True):
            y = gated(y, layer)
            y = np.maximum((y - y.mean(1, keepdims=True)) / np.sqrt(y.var(1, keepdims=True) + 1e-5) * g + s, 0)
        assert np.allclose(r.out, y + (x @ np.array(skip).T + bias if skip else x))
    with pytest.raises(ValueError, match="skip"):
        layers.Stack(parts, gains, shifts, None if skip else [[1.0] * a] * c)


def brute(x, pairs, heads, edges=None):
    number, width = heads.number, heads.width
    q, k, v = (x @ np.array(w).T for w in (heads.query, heads.key, heads.value))
    out = np.zeros((len(x), number, width))
    for node in range(len(x)):
        own = [i for i, (recv, _) in enumerate(pairs) if recv == node]
        for h in range(number) if own else ():
            cut = slice(h * width, (h + 1) * width)
            s = np.array([q[node, cut] @ heads.a_query[h] + k[pairs[i][1], cut] @ heads.a_key[h] + ((np.array(heads.edge) @ edges[i])[cut] @ heads.a_edge[h] if edges is not None else 0) for i in own])
            s = np.where(s > 0, s, 0.2 * s)
            e = np.exp(s - s.max())
            out[node, h] = sum(w * v[pairs[i][1], cut] for w, i in zip(e / e.sum(), own, strict=True))
    out = out.reshape(len(x), -1) if heads.concat else out.mean(1)
    return np.where(out > 0, out, np.expm1(out))


@pytest.mark.parametrize("concat", [True, False])
@pytest.mark.parametrize("with_edges", [True, False])
def test_heads_with_a_hub_and_an_isolated_node(spark, concat, with_edges):
    n, number, width, inputs = 60, 3, 2, 4
    m = lambda rows, columns: R.normal(size=(rows, columns)).tolist()
    heads = layers.Heads(width, m(6, inputs), m(6, inputs), m(6, inputs), m(number, width), m(number, width), m(6, 2) if with_edges else None, m(number, width) if with_edges else None, concat)
    x = R.normal(size=(n, inputs)) * 30  # scores far apart: the maximum must be the receiver's own
    pairs = [(0, s) for s in range(n - 1)] + [(int(a), int(b)) for a, b in R.integers(0, n - 1, (100, 2))]
    edges = R.normal(size=(len(pairs), 2))
    nodes = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "node int, x array<double>")
    table = spark.createDataFrame([(*p, e.tolist()) for p, e in zip(pairs, edges, strict=True)], "recv int, send int, e array<double>")
    got = {r.node: r.out for r in layers.attend(nodes, table, heads).collect()}
    want = brute(x, pairs, heads, edges if with_edges else None)
    assert len(got) == n and all(np.allclose(got[i], want[i]) for i in range(n)) and not any(got[n - 1])


def test_heads_by_step(spark):
    heads = layers.Heads(1, [[1.0, 0.0], [0.0, 1.0]], [[0.5, 0.1], [0.2, 0.3]], [[1.0, 1.0], [2.0, 0.0]], [[1.0], [1.0]], [[1.0], [0.5]], [[0.1, 0.2], [0.3, 0.1]], [[1.0], [2.0]])
    x, speed = R.normal(size=(3, 4, 2)), R.normal(size=(3, 5))
    pairs = [(0, 1), (1, 2), (2, 0), (2, 2), (0, 2)]
    nodes = spark.createDataFrame([(t, i, x[t, i].tolist()) for t in range(3) for i in range(4)], "t int, node int, x array<double>")
    table = spark.createDataFrame([(t, *p, [1.5, float(speed[t, i])]) for t in range(3) for i, p in enumerate(pairs)], "t int, recv int, send int, e array<double>")
    got = {(r.t, r.node): r.out for r in layers.attend(nodes, table, heads, ("t",)).collect()}
    for t in range(3):
        want = brute(x[t], pairs, heads, np.stack([np.full(5, 1.5), speed[t]], 1))
        assert all(np.allclose(got[t, i], want[i]) for i in range(4))


def test_fusion(spark):
    a, b = R.normal(size=(2, 5, 3))
    w = [(R.normal(size=(3, 3)), R.normal(size=3)) for _ in range(3)]
    rows = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(5)], "i int, a array<double>, b array<double>")
    got = {r.i: r.out for r in layers.fused(rows, "a", "b", "out", *[(x.tolist(), y.tolist()) for x, y in w]).collect()}
    g = 1 / (1 + np.exp(-((a + b) @ w[0][0].T + w[0][1])))
    want = np.tanh(g * (a @ w[1][0].T + w[1][1]) + (1 - g) * (b @ w[2][0].T + w[2][1]))
    assert all(np.allclose(got[i], want[i]) for i in range(5))
