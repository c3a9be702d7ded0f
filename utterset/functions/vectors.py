"""Expressions over numeric arrays (samples, frames, embeddings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a variable.

    Inside a lambda a plain expression would be evaluated again per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def unit(x: Column) -> Column:
    """Divide by (L2 norm + 1e-8)."""
    return let(norm(x) + F.lit(1e-8), lambda length: F.transform(x, lambda v: v / length))


def argmax(x: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("long")


def pad_to(x: Column, n: Column | int) -> Column:
    """Right-pad with zeros to length ``n`` (longer input is kept)."""
    size = F.lit(n) if isinstance(n, int) else n
    missing = F.greatest(size - F.size(x), F.lit(0)).cast("int")
    return F.concat(x, F.array_repeat(F.lit(0.0), missing))


def start_crop(x: Column, n: int) -> Column:
    """First ``n`` values, zero-padded when shorter."""
    return pad_to(F.slice(x, 1, n), n)


def crop_from(x: Column, start: Column, n: int) -> Column:
    """``n`` values from 0-based ``start``, zero-padded when shorter."""
    return pad_to(F.slice(x, start.cast("int") + 1, n), n)


def to_mono(channels: Column) -> Column:
    """Average the channels of ``array<array<double>>`` sample by sample."""
    count = F.size(channels)
    return F.transform(
        F.sequence(F.lit(0), F.size(F.element_at(channels, 1)) - 1),
        lambda i: F.aggregate(channels, F.lit(0.0), lambda acc, ch: acc + F.get(ch, i)) / count,
    )


def valid_prefix(total_length: Column, duration: Column, rate: int) -> Column:
    """Samples covered by a declared duration; everything when it is unusable."""
    usable = duration.isNotNull() & ~F.isnan(duration) & (duration > 0) & (duration < float("inf"))
    wanted = F.greatest(F.lit(1), F.bround(duration * rate))
    return F.when(usable, F.least(total_length, wanted)).otherwise(total_length).cast("long")


def valid_frames(n_frames: Column, duration: Column, rate: int, samples_per_frame: Column) -> Column:
    """Frames covered by a declared duration (rounded up)."""
    usable = duration.isNotNull() & (duration > 0)
    wanted = F.greatest(F.lit(1), F.ceil(duration * rate / samples_per_frame))
    return F.when(usable, F.least(n_frames, wanted)).otherwise(n_frames).cast("long")


def max_abs_difference(x: Column, y: Column) -> Column:
    return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def is_close(a: Column, b: Column, rel: float, absolute: float) -> Column:
    """Symmetric closeness: |a-b| <= max(rel * max(|a|,|b|), absolute)."""
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def next_up(x: Column) -> Column:
    """The next greater double of finite values; others are returned as they are.

    The spacing of doubles around x is a power of two taken from its exponent.
    ``log2`` may be off by one next to a power, which two comparisons mend.
    """
    two, tiny = F.lit(2.0), F.lit(5e-324)
    size = F.greatest(F.abs(x), F.lit(2.0**-1022))
    rough = F.floor(F.log2(size)).cast("double")
    exponent = (
        F.when(F.pow(two, rough) > size, rough - 1).when(F.pow(two, rough + 1) <= size, rough + 1).otherwise(rough)
    )
    spacing = F.greatest(F.pow(two, exponent - 52), tiny)
    # below a power of two the spacing is half
    inward = F.when((F.pow(two, exponent) == F.abs(x)) & (exponent > -1022), spacing / 2).otherwise(spacing)
    return F.when(is_finite(x), x + F.when(x >= 0, spacing).otherwise(inward)).otherwise(x)
