"""Column expressions for p values, z scores, alleles and barcodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational approximations of algorithm AS 241 (Wichura 1988), lowest power first.
AS241 = {
    "a": [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    "b": [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
    "c": [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    "d": [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
    "e": [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    "f": [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
}
#: Z scores given to p values beyond the range of doubles.
LARGEST_P, Z_OF_LARGEST, SMALLEST_P, Z_OF_SMALLEST = 0.9999999999999999, -1.3914582123358836e-16, 1e-323, -38.467405617144344


def _horner(x: Column, coefficients: list[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function."""
    q = p - 0.5
    middle_r = F.lit(0.180625) - q * q
    middle = q * _horner(middle_r, AS241["a"]) / _horner(middle_r, AS241["b"])
    tail = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    near, far = tail - 1.6, tail - 5.0
    size = F.when(tail <= 5, _horner(near, AS241["c"]) / _horner(near, AS241["d"])).otherwise(_horner(far, AS241["e"]) / _horner(far, AS241["f"]))
    return F.when(F.abs(q) <= 0.425, middle).otherwise(F.when(q < 0, -size).otherwise(size))


def pvalue_to_zscore(p: Column, beta: Column | None = None) -> Column:
    """z of a two-sided p value, negative unless beta is positive."""
    z = F.when(p >= LARGEST_P, F.lit(Z_OF_LARGEST)).when(p <= SMALLEST_P, F.lit(Z_OF_SMALLEST)).otherwise(normal_quantile(p / 2))
    return z if beta is None else F.when(beta > 0, -z).otherwise(z)


def zscore_to_beta(z: Column, maf: Column, n: Column) -> tuple[Column, Column]:
    """Effect and its standard error from z, allele frequency and sample size; null where the frequency is 0."""
    root = F.sqrt(2 * maf * (1 - maf) * (n + z * z))
    return F.try_divide(z, root), F.try_divide(F.lit(1.0), root)


def sort_alleles(c: Column, sep: str = "/") -> Column:
    return F.concat_ws(sep, F.array_sort(F.split(c, sep)))


def log_modulus(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def barcode_key(barcode: Column, pool: Column) -> Column:
    return F.concat_ws("_", F.substring_index(barcode, "-", 1), pool)


def variant_type(alleles: Column) -> Column:
    n = F.length(alleles)
    return F.when(n == 3, "SNP").when(n <= 2, F.lit(None)).otherwise("INDEL")


def signif_group(a: Column, b: Column, alpha: float) -> Column:
    x, y = a <= alpha, b <= alpha
    return F.when(x & y, "Both").when(x, "Discovery").when(y, "Replication").otherwise("Neither")


def concat_variant(c: Column, sep: str = ":") -> Column:
    """F9. ``chr:pos:a:b`` with its two alleles in alphabetic order."""
    part = F.split(c, sep)
    a, b = F.get(part, F.lit(2)), F.get(part, F.lit(3))
    return F.concat_ws(sep, F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.least(a, b), F.greatest(a, b))


def minus_log10(p: Column) -> Column:
    """F10. -log10(p); null where p is not above 0."""
    return F.when(p > 0, -F.log10(p))


def bounds_group(a: Column, b: Column, low: float, high: float, names: tuple[str, str]) -> Column:
    """F20, the quality-control twin: which of two values lie strictly inside the bounds."""
    x, y = (a > low) & (a < high), (b > low) & (b < high)
    return F.when(x & y, "both").when(x, names[0]).when(y, names[1]).otherwise("neither")


def correlation(x: str | Column, y: str | Column) -> Column:
    """Aggregate: Pearson's correlation over rows with both values; null where one of them does not vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
