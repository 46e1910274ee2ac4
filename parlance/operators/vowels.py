"""Vowel space: pools and moments of formant clouds, and ellipses fitted to them, in column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import fresh

#: Powers of f1 and f2 in the products of (x x, x y, y y, x, y, 1) with themselves.
_TERMS = ((2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0))
MOMENTS = sorted({(a + c, b + d) for a, b in _TERMS for c, d in _TERMS})
#: The basic vowels, keyed by their first letter.
BASIC = "aeiou"


def basic_vowel(label: Column) -> Column:
    """The first letter of a vowel's label in lower case, if it is a basic vowel; else null."""
    first = F.lower(F.substring(label.cast("string"), 1, 1))
    return F.when(first.isin(*BASIC), first)


def vowel_moments(formants: DataFrame) -> DataFrame:
    """Sums of f1**i * f2**j up to degree four for each vowel, in one aggregate."""
    power = lambda c, k: F.pow(F.col(c), F.lit(k)) if k else F.lit(1.0)
    return formants.where("f1 is not null and f2 is not null").groupBy("vowel").agg(*(F.sum(power("f1", i) * power("f2", j)).alias(f"m{i}{j}") for i, j in MOMENTS))


def central_moments(formants: DataFrame) -> DataFrame:
    """vowel, n, mean_x, mean_y, size and the sums c{i}{j} of u**i * v**j, u and v the formants from their means in units of `size`.

    size is the root of the mean of both variances, null for a single point. Two aggregates: powers of differences keep the digits that
    powers of the formants themselves would lose. Rows with a null or NaN formant are left out; a null vowel is a vowel.
    """
    rows = formants.select("vowel", F.nanvl("f1", F.lit(None)).alias("x"), F.nanvl("f2", F.lit(None)).alias("y")).where("x is not null and y is not null")
    means = rows.groupBy("vowel").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.sqrt((F.var_pop("x") + F.var_pop("y")) / 2).alias("size"))
    means = means.withColumn("size", F.when(F.col("size") > 0, F.col("size")))
    known = means.select(F.col("vowel").alias("of"), "mean_x", "mean_y", "size")
    near = rows.join(known, F.col("vowel").eqNullSafe(F.col("of"))).select("vowel", ((F.col("x") - F.col("mean_x")) / F.col("size")).alias("u"), ((F.col("y") - F.col("mean_y")) / F.col("size")).alias("v"))
    power = lambda c, k: [F.col(c)] * k
    product = lambda i, j: _product([*power("u", i), *power("v", j)])
    sums = near.groupBy(F.col("vowel").alias("of")).agg(*(F.sum(product(i, j)).alias(f"c{i}{j}") for i, j in MOMENTS if i + j > 1))
    return means.join(sums, F.col("vowel").eqNullSafe(F.col("of"))).drop("of")


def _product(factors: list[Column]) -> Column:
    out = factors[0]
    for f in factors[1:]:
        out = out * f
    return out


def ellipse_steps() -> list[dict[str, str]]:
    """SQL expressions, layer by layer, from the central moments of a cloud to its direct least-squares ellipse.

    The conic a uu + b uv + c vv + d u + e v + f with 4ac - bb = 1 that fits best is an eigenvector of a 6 x 6 problem. Its linear part follows from the quadratic one,
    which leaves 3 x 3 with one positive eigenvalue: the largest root of a cubic with three real ones. First moments are zero about the means.
    """
    quad = (("c40", "c31", "c22"), ("c31", "c22", "c13"), ("c22", "c13", "c04"))
    lin = (("c30", "c21", "c20"), ("c21", "c12", "c11"), ("c12", "c03", "c02"))
    rows = range(3)
    layers = [{"det": "nullif(c20 * c02 - c11 * c11, 0)"}]
    linear = {}
    for k in rows:  # the linear part of each quadratic term
        linear[f"tx{k}"] = f"-(c02 * {lin[k][0]} - c11 * {lin[k][1]}) / det"
        linear[f"ty{k}"] = f"-(c20 * {lin[k][1]} - c11 * {lin[k][0]}) / det"
        linear[f"tz{k}"] = f"-{lin[k][2]} / n"
    layers.append(linear)
    layers.append({f"s{i}{k}": f"({quad[i][k]} + {lin[i][0]} * tx{k} + {lin[i][1]} * ty{k} + {lin[i][2]} * tz{k}) / n" for i in rows for k in rows})
    layers.append({f"g{i}{k}": {0: f"s2{k} / 2", 1: f"-s1{k}", 2: f"s0{k} / 2"}[i] for i in rows for k in rows})
    minor = lambda a, b: f"(g{a}{a} * g{b}{b} - g{a}{b} * g{b}{a})"
    det = "g00 * (g11 * g22 - g12 * g21) - g01 * (g10 * g22 - g12 * g20) + g02 * (g10 * g21 - g11 * g20)"
    layers.append({"k2": "g00 + g11 + g22", "k1": f"{minor(0, 1)} + {minor(0, 2)} + {minor(1, 2)}", "k0": det})
    layers.append({"pp": "greatest(k2 * k2 / 3 - k1, 0) / 3", "qq": "k2 * k2 * k2 / 27 - k2 * k1 / 6 + k0 / 2"})
    layers.append({"turn": "acos(greatest(-1.0, least(1.0, qq / nullif(pp * sqrt(pp), 0)))) / 3"})
    layers.append({"root": "2 * sqrt(pp) * cos(turn) + k2 / 3"})
    shifted = [[f"(g{i}{k} - root)" if i == k else f"g{i}{k}" for k in rows] for i in rows]
    crosses = {}
    for name, (i, k) in {"p": (0, 1), "q": (0, 2), "r": (1, 2)}.items():
        for axis, (x, y) in enumerate(((1, 2), (2, 0), (0, 1))):
            crosses[f"{name}{axis}"] = f"{shifted[i][x]} * {shifted[k][y]} - {shifted[i][y]} * {shifted[k][x]}"
    layers.append(crosses)
    layers.append({f"{n}n": f"{n}0 * {n}0 + {n}1 * {n}1 + {n}2 * {n}2" for n in "pqr"})
    layers.append({name: f"CASE WHEN pn >= qn AND pn >= rn THEN p{k} WHEN qn >= rn THEN q{k} ELSE r{k} END" for k, name in enumerate(("qa", "qb", "qc"))})
    layers.append({"ld": "tx0 * qa + tx1 * qb + tx2 * qc", "le": "ty0 * qa + ty1 * qb + ty2 * qc", "lf": "tz0 * qa + tz1 * qb + tz2 * qc", "den": "CASE WHEN 4 * qa * qc - qb * qb > 0 THEN 4 * qa * qc - qb * qb END"})
    layers.append({"u0": "(qb * le - 2 * qc * ld) / den", "v0": "(qb * ld - 2 * qa * le) / den"})
    layers.append({"level": "nullif(-(lf + (ld * u0 + le * v0) / 2), 0)"})
    layers.append({"ea": "qa / level", "eb": "qb / level / 2", "ec": "qc / level"})
    layers.append({"large": "(ea + ec) / 2 + sqrt((ea - ec) * (ea - ec) / 4 + eb * eb)"})
    layers.append({"large": "CASE WHEN large > 0 THEN large END", "small": "CASE WHEN large > 0 AND ea * ec - eb * eb > 0 THEN (ea * ec - eb * eb) / large END"})
    degrees = "degrees(atan2(2 * eb, ea - ec)) / 2 + 90"
    layers.append({
        "center_f1": "CASE WHEN small IS NOT NULL THEN mean_x + u0 * size END", "center_f2": "CASE WHEN small IS NOT NULL THEN mean_y + v0 * size END",
        "axis_a": "size / sqrt(small)", "axis_b": "CASE WHEN small IS NOT NULL THEN size / sqrt(large) END", "angle": f"CASE WHEN small IS NOT NULL THEN {degrees} - CASE WHEN {degrees} >= 180 THEN 180 ELSE 0 END END",
    })
    return layers


ELLIPSE = ("center_f1", "center_f2", "axis_a", "axis_b", "angle")


def vowel_ellipses(formants: DataFrame, basic: bool = False) -> DataFrame:
    """Direct least-squares ellipse of each vowel: centre, half axes (the longer first), angle of the longer in degrees; nulls where there is none.

    vowel may be of any type. basic: vowels are pooled by their first letter, and other labels fall out. A cloud on a line, of one point or of a shape that no ellipse
    fits has nulls; an empty table gives no rows.
    """
    rows = formants.withColumn("vowel", basic_vowel(F.col("vowel"))).where("vowel is not null") if basic else formants
    out = central_moments(rows)
    for layer in ellipse_steps():
        out = out.withColumns({name: F.expr(e) for name, e in layer.items()})
    return out.select("vowel", *ELLIPSE)


def vowel_pools(phones: DataFrame, frames: DataFrame, kind: Column, basic: bool = False) -> DataFrame:
    """vowel, utt_id, f1 and f2: for each vowel among the phones (utt_id, ord, label, start, end), the means of both formants over its two end frames.

    frames: utt_id, i (from 0), t, f1, f2, a regular grid. kind: true for vowels. Times outside the frames go to the edge frames.
    """
    from .intervals import frame_on_grid

    (label,) = fresh(phones, "vowel")
    named = phones.where(kind).withColumn(label, basic_vowel(F.col("label")) if basic else F.col("label")).where(F.col(label).isNotNull())
    ends = named.select("utt_id", "ord", F.col(label).alias("vowel"), F.explode(F.array("start", "end")).alias("t"))
    found = frame_on_grid(ends, frames.select("utt_id", "i", "t", F.struct("f1", "f2").alias("value")))
    return found.groupBy("utt_id", "ord", "vowel").agg(F.avg("value.f1").alias("f1"), F.avg("value.f2").alias("f2")).select("vowel", "utt_id", "f1", "f2")
