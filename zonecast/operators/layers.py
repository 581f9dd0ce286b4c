"""Layers of the forecaster as column expressions and joins: no Python in any task.

Vectors are arrays of doubles and weights are Python lists: a matrix is a list of rows, one an output. Matrices are
literals of the plan, of the model's size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .attention import LEAST_SUM, SALTS, elu, leaky, sigmoid

Matrix = list[list[float]]
EPSILON = 1e-5


def literal(values: list) -> Column:
    """A vector or matrix as a column."""
    return F.array(*[literal(x) if isinstance(x, list) else F.lit(float(x)) for x in values]) if values else F.expr("CAST(array() AS array<double>)")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear(x: Column, weights: Matrix, bias: list[float] | None = None) -> Column:
    """weights times x, plus bias."""
    out = F.transform(literal(weights), lambda row: dot(row, x))
    return out if bias is None else F.zip_with(out, literal(bias), lambda a, b: a + b)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def layer_norm(x: Column, gain: list[float], shift: list[float]) -> Column:
    """x less its mean over its deviation, with the variance of the whole population, times gain plus shift."""
    n = F.size(x)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / n
    # the mean is bound to a variable of a one-element array, so that it is found once a vector
    centred = F.get(F.transform(F.array(mean(x)), lambda m: F.transform(x, lambda y: y - m)), 0)
    scaled = lambda c: F.get(F.transform(F.array(F.sqrt(mean(F.transform(c, lambda y: y * y)) + EPSILON)), lambda d: F.transform(c, lambda y: y / d)), 0)
    out = F.get(F.transform(F.array(centred), scaled), 0)
    return F.zip_with(F.zip_with(out, literal(gain), lambda a, b: a * b), literal(shift), lambda a, b: a + b)


@dataclass(frozen=True)
class Convolution:
    """One gated layer: three causal convolutions, weights[output][input * steps + step], the oldest step first."""

    steps: int
    dilation: int
    first: Matrix
    second: Matrix
    gate: Matrix
    biases: tuple[list[float], list[float], list[float]]

    @property
    def inputs(self) -> int:
        return len(self.gate[0]) // self.steps

    def __call__(self, x: Column) -> Column:
        """x: an array, a vector a time step; before the first step all is 0."""
        rest, size = [0.0] * self.inputs, F.size(x)

        def at(t: Column) -> Column:
            seen = [F.coalesce(F.get(x, t - (self.steps - 1 - i) * self.dilation), literal(rest)) if i < self.steps - 1 else F.get(x, t) for i in range(self.steps)]
            taps = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(self.inputs - 1)), lambda c: F.array(*[F.get(s, c) for s in seen])))
            said = lambda v: F.zip_with(sigmoid_of(linear(v, self.gate, self.biases[2])), F.zip_with(linear(v, self.first, self.biases[0]), linear(v, self.second, self.biases[1]), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda g, ab: g * ab["a"] + (1 - g) * ab["b"])
            return F.get(F.transform(F.array(taps), said), 0)

        return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), at)).otherwise(x)


def sigmoid_of(x: Column) -> Column:
    return F.transform(x, sigmoid)


def _cut(gain: list[float], shift: list[float]):
    return lambda x: F.transform(layer_norm(x, gain, shift), lambda y: F.greatest(y, F.lit(0.0)))


@dataclass(frozen=True)
class Stack:
    """Gated layers, each with layer normalization and a cut at 0; the input is added to the end, by skip where widths differ."""

    layers: list[Convolution]
    gains: list[list[float]]
    shifts: list[list[float]]
    skip: Matrix | None = None
    skip_bias: list[float] | None = field(default=None)

    def __post_init__(self):
        wide, narrow = len(self.layers[-1].gate), self.layers[0].inputs
        if (self.skip is None) != (wide == narrow):
            raise ValueError(f"a skip is wanted where the {narrow} inputs and {wide} outputs differ, and only there")

    def __call__(self, rows: DataFrame, column: str, out: str) -> DataFrame:
        """rows with out: the stack over column, an array of vectors by time step."""
        found = rows.withColumn("_x", F.col(column))
        for layer, gain, shift in zip(self.layers, self.gains, self.shifts, strict=True):
            found = found.withColumn("_x", layer(F.col("_x"))).withColumn("_x", F.transform("_x", _cut(gain, shift)))
        straight = F.col(column) if self.skip is None else F.transform(column, lambda v: linear(v, self.skip, self.skip_bias))
        return found.withColumn(out, F.zip_with("_x", straight, plus)).drop("_x")


@dataclass(frozen=True)
class Heads:
    """Attention of several heads: query, key and value are [head * width + d][input]; the a_ vectors are [head][width]."""

    width: int
    query: Matrix
    key: Matrix
    value: Matrix
    a_query: Matrix
    a_key: Matrix
    edge: Matrix | None = None
    a_edge: Matrix | None = None
    concat: bool = True

    @property
    def number(self) -> int:
        return len(self.a_query)

    def folded(self, weights: Matrix, a: Matrix) -> Matrix:
        """[head][input]: what a head's vector makes of the weights, as both are linear."""
        return [[sum(a[h][d] * weights[h * self.width + d][i] for d in range(self.width)) for i in range(len(weights[0]))] for h in range(self.number)]


def attend(nodes: DataFrame, pairs: DataFrame, heads: Heads, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, out): each node's attention over the nodes that send to it. A node that receives nothing gets zeros.

    nodes: (by, node, x: its vector); pairs: (by, recv, send[, e: the edge's vector]). by: what the graphs are apart in,
    such as a time step. The softmax of a receiver and head is taken in parts: within a part (receiver, salt) scores are
    less the part's maximum, and a receiver's parts, SALTS at most, meet with each part's sums scaled to the common one.
    """
    number, width, by = heads.number, heads.width, list(by)
    told = nodes.select(*by, F.col("node"), linear(F.col("x"), heads.folded(heads.query, heads.a_query)).alias("q"), linear(F.col("x"), heads.folded(heads.key, heads.a_key)).alias("k"), linear(F.col("x"), heads.value).alias("v"))
    ends = pairs.join(told.select(*by, F.col("node").alias("recv"), "q"), [*by, "recv"]).join(told.select(*by, F.col("node").alias("send"), "k", "v"), [*by, "send"])
    score = plus(F.col("q"), F.col("k"))
    if heads.edge is not None:
        score = plus(score, linear(F.col("e"), heads.folded(heads.edge, heads.a_edge)))
    scored = ends.select(*by, "recv", F.pmod(F.xxhash64("send"), F.lit(SALTS)).alias("salt"), score.alias("s"), "v")
    scored = scored.select(*by, "recv", "salt", "v", *[leaky(F.col("s")[h]).alias(f"s{h}") for h in range(number)])
    part, whole = Window.partitionBy(*by, "recv", "salt"), Window.partitionBy(*by, "recv")
    grown = scored.withColumns({f"m{h}": F.max(f"s{h}").over(part) for h in range(number)}).withColumns({f"s{h}": F.exp(F.col(f"s{h}") - F.col(f"m{h}")) for h in range(number)})
    cells = [(h, d) for h in range(number) for d in range(width)]
    sums = grown.groupBy(*by, "recv", "salt").agg(*[F.max(f"m{h}").alias(f"m{h}") for h in range(number)], *[F.sum(f"s{h}").alias(f"s{h}") for h in range(number)], *[F.sum(F.col(f"s{h}") * F.col("v")[h * width + d]).alias(f"x{h}_{d}") for h, d in cells])
    scales = sums.withColumns({f"f{h}": F.exp(F.col(f"m{h}") - F.max(f"m{h}").over(whole)) for h in range(number)})
    ready = scales.groupBy(*by, "recv").agg(*[F.sum(F.col(f"s{h}") * F.col(f"f{h}")).alias(f"s{h}") for h in range(number)], *[F.sum(F.col(f"x{h}_{d}") * F.col(f"f{h}")).alias(f"x{h}_{d}") for h, d in cells])
    value = lambda h, d: F.col(f"x{h}_{d}") / F.greatest(F.col(f"s{h}"), F.lit(LEAST_SUM))
    out = [value(h, d) for h, d in cells] if heads.concat else [sum((value(h, d) for h in range(1, number)), value(0, d)) / number for d in range(width)]
    ready = ready.select(*by, F.col("recv").alias("node"), F.array(*out).alias("out"))
    full = nodes.select(*by, "node").join(ready, [*by, "node"], "left")
    return full.select(*by, "node", F.transform(F.coalesce("out", literal([0.0] * len(out))), elu).alias("out"))


def fused(rows: DataFrame, a: str, b: str, out: str, gate: tuple[Matrix, list[float]], first: tuple[Matrix, list[float]], second: tuple[Matrix, list[float]]) -> DataFrame:
    """rows with out: tanh of two paths, vectors a and b, weighed by a gate that sees their sum."""
    parts = F.zip_with(linear(F.col(a), *first), linear(F.col(b), *second), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return rows.withColumn(out, F.zip_with(sigmoid_of(linear(plus(F.col(a), F.col(b)), *gate)), parts, lambda g, p: F.tanh(g * p["x"] + (1 - g) * p["y"])))
