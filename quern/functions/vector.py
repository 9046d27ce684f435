"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.columns import let


def dot(a: Column, b: Column) -> Column:
    """The inner product, accumulated in double precision from left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """Cosine; 0 if a norm is 0, null if the sizes differ or a vector is empty or null.

    Norms may be given where they are already columns, so that a join of many pairs does
    not compute them again for each.
    """
    a_norm = norm(a) if a_norm is None else a_norm
    b_norm = norm(b) if b_norm is None else b_norm
    value = F.when((a_norm == 0) | (b_norm == 0), F.lit(0.0)).otherwise(dot(a, b) / (a_norm * b_norm))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value)


def strict_cosine(a: Column, b: Column) -> Column:
    """As ``cosine``, but null for a zero norm (the row is then dropped by a filter)."""
    return F.when((norm(a) > 0) & (norm(b) > 0), cosine(a, b))


def dimension_problem(vector: Column, query: Column) -> Column:
    """Why a vector cannot be compared: ``empty-vector``, ``dimension-mismatch`` or null."""
    return F.when(F.coalesce(F.size(vector), F.lit(0)) <= 0, F.lit("empty-vector")).when(
        F.size(vector) != F.size(query), F.lit("dimension-mismatch")
    )


def deterministic_vector(model: Column, chunk_id: Column, content_hash: Column, char_count: Column) -> Column:
    """Eight numbers in [0, 1) from a SHA-256 over the inputs: a stand-in embedding."""
    digest = F.sha2(F.concat_ws("|", model, chunk_id, content_hash, char_count.cast("string")), 256)

    def number(d: Column, i: int) -> Column:
        return (F.conv(F.substring(d, 1 + 8 * i, 8), 16, 10).cast("long") % 10000 / 10000).cast("float")

    return let(digest, lambda d: F.array(*(number(d, i) for i in range(8))))


def vector_reference(model: Column, chunk_id: Column, content_hash: Column, char_count: Column) -> Column:
    """The first 12 bytes of the same digest, in hex."""
    return F.substring(
        F.sha2(F.concat_ws("|", model, chunk_id, content_hash, char_count.cast("string")), 256), 1, 24
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def point_id(record_id: Column) -> Column:
    """The first 8 bytes of a SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(record_id, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as a long from 0 to 2^32 - 1."""
    data = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    byte = F.transform(places, lambda i: F.conv(F.substring(data, 1 + 2 * i, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(
        byte, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)) % F.lit(1 << 32)
    )


def sparse_document(terms: Column) -> Column:
    """``map<term, weight>``: term frequency over the largest one, 1.0 throughout for a set."""
    return F.map_from_arrays(terms, F.transform(terms, lambda t: F.lit(1.0).cast("float")))


def sparse_query(terms: Column) -> Column:
    return F.map_from_arrays(terms, F.transform(terms, lambda t: F.lit(1.0).cast("float")))
