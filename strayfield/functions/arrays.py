"""Column functions on ``ARRAY<FLOAT>`` vectors. Every function computes in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strayfield.operators.ordering import as_col


def doubles(v: str | Column) -> Column:
    return as_col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row; inside a lambda it would be computed per element."""
    return F.get(F.transform(F.array(value), body), 0)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: str | Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def l2_normalize(v: str | Column, eps: float | None = None) -> Column:
    """Divide by the L2 norm; with ``eps`` the norm is floored, else a zero vector becomes NULLs."""
    length = norm(v)
    length = F.greatest(length, F.lit(eps)) if eps is not None else F.nullif(length, F.lit(0.0))
    return bind(length, lambda n: F.transform(doubles(v), lambda x: x / n))


def adaptive_pool(v: str | Column, bins: int) -> Column:
    """Average pool to ``bins`` values; bin i covers [floor(i*L/bins), ceil((i+1)*L/bins))."""
    vec = doubles(v)
    size = F.size(vec)

    def pooled(i: Column) -> Column:
        lo = F.floor(i * size / F.lit(bins)).cast("int")
        hi = F.ceil((i + 1) * size / F.lit(bins)).cast("int")
        return total(F.slice(vec, lo + 1, hi - lo)) / (hi - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), pooled)


def standardize(v: str | Column, mean: str | Column, std: str | Column) -> Column:
    centred = F.zip_with(doubles(v), doubles(mean), lambda x, m: x - m)
    return F.zip_with(centred, doubles(std), lambda x, s: x / F.nullif(s, F.lit(0.0)))


def destandardize(v: str | Column, mean: str | Column, std: str | Column) -> Column:
    scaled = F.zip_with(doubles(v), doubles(std), lambda x, s: x * s)
    return F.zip_with(scaled, doubles(mean), lambda x, m: x + m)


def softmax(v: str | Column) -> Column:
    vec = doubles(v)
    exps = bind(F.array_max(vec), lambda top: F.transform(vec, lambda x: F.exp(x - top)))
    return bind(exps, lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t)))


def log_softmax(v: str | Column) -> Column:
    vec = doubles(v)
    lse = bind(F.array_max(vec), lambda top: top + F.log(total(F.transform(vec, lambda x: F.exp(x - top)))))
    return bind(lse, lambda n: F.transform(vec, lambda x: x - n))


def argmax(v: str | Column) -> Column:
    """0-based position of the first maximum."""
    vec = doubles(v)
    return (F.array_position(vec, F.array_max(vec)) - 1).cast("int")


def entropy(p: Column, eps: float = 1e-10) -> Column:
    return -total(F.transform(p, lambda x: x * F.log(x + F.lit(eps))))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def mean_squared_difference(a: str | Column, b: str | Column) -> Column:
    """Channel mean of the squared difference of two feature vectors."""
    return squared_distance(a, b) / F.size(as_col(a))


def topk_values(v: str | Column, k: int, smallest: bool = True) -> Column:
    ordered = F.sort_array(doubles(v), asc=smallest)
    return F.slice(ordered, 1, k)


def sorted_l1(a: str | Column, b: str | Column) -> Column:
    """Sum of absolute differences of the sorted values: the 1-D earth mover's form."""
    return total(F.zip_with(F.sort_array(doubles(a)), F.sort_array(doubles(b)), lambda x, y: F.abs(x - y)))


def alignment_divergence(reference: str | Column, candidate: str | Column) -> Column:
    """KL(softmax(candidate) || softmax(reference)), summed over the vector."""
    return total(
        F.zip_with(
            F.zip_with(softmax(candidate), log_softmax(candidate), lambda q, lq: F.struct(q.alias("q"), lq.alias("lq"))),
            log_softmax(reference),
            lambda t, lp: t["q"] * (t["lq"] - lp),
        )
    )
