"""Vector expressions: double arithmetic over arrays, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    An expression inside a lambda is computed again for every element, and the
    optimizer puts projections there; what a lambda binds stays computed.
    """
    return F.get(F.transform(F.array(value), body), 0)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; the squares are summed once, not for every component.  A zero vector stays."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x, lambda square: F.transform(v, lambda x: x / F.greatest(F.sqrt(square), F.lit(1e-30))))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the clamped cosine."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def reject_reason(v: Column, dim: int | None = None, cosine: bool = True) -> Column:
    """Why a vector is unusable, or null."""
    inf = float("inf")
    square = F.aggregate(as_double(v), F.lit(0.0), lambda a, x: a + x * x)
    reason = F.when(v.isNull(), "missing").when(F.exists(v, lambda x: x.isNull()), "null_component")
    if dim is not None:
        reason = reason.when(F.size(v) != dim, "dimension")
    reason = reason.when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == inf)), "not_finite")
    return reason.when((square == 0) | (square == inf), "norm") if cosine else reason


def _span(v: Column) -> Column:
    low, span = F.array_min(v), F.array_max(v) - F.array_min(v)
    return F.struct(low.alias("low"), F.when(span < 1e-30, F.lit(1.0)).otherwise(span).alias("span"))


def quantization(v: Column) -> Column:
    """``scale, offset`` of the row-affine 8-bit code; a flat row has range 1."""
    return bound(v, lambda v: bound(_span(v), lambda s: F.struct((s["span"] / 255).alias("scale"), s["low"].alias("offset"))))


def quantize(v: Column) -> Column:
    """Codes 0..255, rounded half up."""
    code = lambda x, s: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x - s["low"]) * 255 / s["span"] + 0.5))).cast("int")
    return bound(v, lambda v: bound(_span(v), lambda s: F.transform(v, lambda x: code(x, s))))


def dequantize(q: Column, scale: Column, offset: Column) -> Column:
    return bound(F.struct(scale.alias("scale"), offset.alias("offset")), lambda s: F.transform(q, lambda x: s["offset"] + s["scale"] * x))


def asymmetric_dot(query: Column, q: Column, scale: Column, offset: Column) -> Column:
    """A float query against a code, with the affine constants taken out of the loop."""
    return offset * total(query) + scale * dot(query, as_double(q))


def asymmetric_l2(query: Column, q: Column, scale: Column, offset: Column, sum_q: Column, sum_q2: Column) -> Column:
    """Distance of a float query to a coded row, from sums and one dot product."""
    row = F.size(q) * offset * offset + 2 * offset * scale * sum_q + scale * scale * sum_q2
    return F.sqrt(F.greatest(F.lit(0.0), dot(query, query) - 2 * asymmetric_dot(query, q, scale, offset) + row))


def code_dot(a: Column, b: Column) -> Column:
    """Exact integer dot product of two codes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda t, x: t + x)


def _coded_square(r: Column) -> Column:
    return F.size(r["q"]) * r["offset"] * r["offset"] + 2 * r["offset"] * r["scale"] * r["sum_q"] + r["scale"] * r["scale"] * r["sum_q2"]


def _coded_dot(a: Column, b: Column) -> Column:
    cross = a["offset"] * b["scale"] * b["sum_q"] + b["offset"] * a["scale"] * a["sum_q"]
    return F.size(a["q"]) * a["offset"] * b["offset"] + cross + a["scale"] * b["scale"] * code_dot(a["q"], b["q"])


def symmetric_l2(a: Column, b: Column) -> Column:
    """Distance of two coded rows (structs of ``q, scale, offset, sum_q, sum_q2``) in closed form."""
    return F.sqrt(F.greatest(F.lit(0.0), _coded_square(a) + _coded_square(b) - 2 * _coded_dot(a, b)))


def symmetric_cosine(a: Column, b: Column) -> Column:
    """Cosine distance of two coded rows in closed form."""
    cosine = _coded_dot(a, b) / F.greatest(F.sqrt(_coded_square(a) * _coded_square(b)), F.lit(1e-30))
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))


def sketch_cosine(pooled_unit_query: Column, p: Column, scale: Column, offset: Column, width: int) -> Column:
    """Coarse cosine distance: every pooled component stands for ``width`` of them."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), width * asymmetric_dot(pooled_unit_query, p, scale, offset)))


def int8_row(v: Column) -> Column:
    """``scale, q``: signed codes by the largest magnitude, rounded half to even."""
    top = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    scale = F.when(top == 0, F.lit(1.0)).otherwise(top / 127)
    return F.struct(scale.alias("scale"), F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)), lambda t: F.transform(v, lambda x: F.rint(x / F.when(t == 0, F.lit(1.0)).otherwise(t / 127)).cast("int"))).alias("q"))


def random_level(key: Column, m: int, seed: int = 0) -> Column:
    """A geometric level floor(-ln u / ln m) with u from a hash of the key."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + 1).cast("double") / F.lit(float(1 << 53))
    return F.floor(-F.log(u) / F.log(F.lit(float(m)))).cast("int")


def pooled(q: Column, dims: int, width: int) -> Column:
    """Means of adjacent codes, rounded half up: ``dims`` groups of ``width``."""
    return bound(
        q,
        lambda q: F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: F.floor(F.aggregate(F.slice(q, i * width + 1, width), F.lit(0.0), lambda a, x: a + x) / width + 0.5).cast("int"),
        ),
    )


def pooled_query(v: Column, dims: int, width: int) -> Column:
    return bound(
        v,
        lambda v: F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.slice(v, i * width + 1, width), F.lit(0.0), lambda a, x: a + x) / width
        ),
    )


def micro(q: Column, dims: int, width: int, micro_dims: int) -> Column:
    """A second, coarser pooling of the original codes, not of the first pooling."""
    return pooled(q, micro_dims, dims * width // micro_dims)


def nibbles(p: Column) -> Column:
    """4-bit codes of pooled bytes."""
    return F.transform(p, lambda x: F.least(F.lit(15), F.floor(x / 17 + 0.5).cast("int")))


def from_nibbles(p: Column) -> Column:
    return F.transform(p, lambda x: x * 17)
