"""Column functions: times, vectors and histograms, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def frame_to_timestamp(frame: Column | str, fps: Column | str) -> Column:
    """HH:MM:SS of a frame, hours unbounded; 00:00:00 without a positive frame rate."""
    s = F.when(col(fps) > 0, (col(frame) / col(fps)).cast("long")).otherwise(F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """The vector over its Euclidean norm."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(col(v), lambda x: x.cast("double") / norm)


def cosine01(a: Column | str, b: Column | str) -> Column:
    """Cosine of two unit vectors, moved from [-1, 1] to [0, 1]."""
    return (dot(a, b) + 1) / 2


def hist_correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of two histograms, not below 0; 1 where either is constant."""
    a, b = col(a), col(b)
    n = F.size(a).cast("double")
    sa, sb = total(F.transform(a, lambda x: x.cast("double"))), total(F.transform(b, lambda x: x.cast("double")))
    va, vb = dot(a, a) - sa * sa / n, dot(b, b) - sb * sb / n
    both = va * vb
    return F.when(both > 1e-18, F.greatest(F.lit(0.0), (dot(a, b) - sa * sb / n) / F.sqrt(both))).otherwise(F.lit(1.0))


def appearance_score(fa: Column | str, ha: Column | str, fb: Column | str, hb: Column | str) -> Column:
    """Mean of the cosine part and the histogram part, of those that both sides have; 0 without either."""
    has_f, has_h = col(fa).isNotNull() & col(fb).isNotNull(), col(ha).isNotNull() & col(hb).isNotNull()
    f, h = cosine01(fa, fb), hist_correlation(ha, hb)
    return F.when(has_f & has_h, 0.5 * f + 0.5 * h).when(has_f, f).when(has_h, h).otherwise(F.lit(0.0))


def result_uri(bucket: Column | str, key: Column | str) -> Column:
    return F.concat(F.lit("s3://"), col(bucket), F.lit("/"), col(key))


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id from an md5 of the parts joined by bars: the same on every retry of a task."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
