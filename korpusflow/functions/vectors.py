"""Column functions over vectors and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The vector at length 1. Its length is taken once (as the variable of a transform), not for each element."""
    scaled = lambda n: F.transform(v, lambda x: x.cast("double") / n)
    return F.get(F.transform(F.array(F.greatest(norm(v), F.lit(1e-12))), scaled), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def hash_embed(text: Column, dim: int = 16) -> Column:
    """Deterministic unit vector of a text: bytes of its SHA-256 (repeated if dim needs more) put on -1 to 1."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0)
    return l2_normalize(raw)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def index_version(scope_hash: Column, digest: Column, tokenizer: Column, stemming: Column | None = None) -> Column:
    """Sixteen hex digits that name an index: of its scope, its records, its tokenizer and its stemming."""
    parts = [scope_hash, digest, tokenizer] + ([stemming] if stemming is not None else [])
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)
