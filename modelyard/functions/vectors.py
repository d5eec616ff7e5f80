"""Array functions: scaling, activations, probabilities and losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modelyard.functions import let

# Statistics the inputs are standardised with, brightest byte, blank level.
MEAN = 0.1307
STD = 0.3081
BYTE_MAX = 255.0
BLANK_LEVEL = 10


def scale(c: Column, top: float = BYTE_MAX) -> Column:
    """A number to [0, 1]."""
    return c.cast("double") / F.lit(float(top))


def standardize(c: Column, mean: float = MEAN, std: float = STD) -> Column:
    return (c - F.lit(mean)) / F.lit(std)


def flatten_grid(grid: Column, depth: int = 3) -> Column:
    """A nested array of the given depth as one flat array."""
    for _ in range(depth - 1):
        grid = F.flatten(grid)
    return grid


def preprocess(grid: Column, depth: int = 3, top: float = BYTE_MAX) -> Column:
    """Flatten, scale and standardise: the one chain that training and scoring share."""
    return F.transform(flatten_grid(grid, depth), lambda x: standardize(scale(x, top)))


def alpha_values(rgba: Column) -> Column:
    """Every fourth value of red, green, blue, alpha bytes."""
    return F.filter(rgba, lambda _, i: i % 4 == 3)


def has_content(pixels: Column, level: float = BLANK_LEVEL) -> Column:
    """True when any value is above the level."""
    return F.exists(pixels, lambda p: p > level)


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def exp_shifted(v: Column) -> Column:
    """exp(x - max), the stable numerator of softmax."""
    return let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))


def softmax(v: Column) -> Column:
    return let(exp_shifted(v), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def argmax(v: Column) -> Column:
    """Position of the largest value from zero; the first of equals."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def rounded(v: Column, places: int = 4) -> Column:
    return F.transform(v, lambda x: F.round(x, places))


def relative_percent(v: Column) -> Column:
    """Each value as a percentage of the largest; null where that is 0."""
    return let(F.array_max(v), lambda top: F.transform(v, lambda x: F.try_divide(x, top) * 100))


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax(logits)[label], without forming the softmax."""
    return F.log(total(exp_shifted(logits))) + F.array_max(logits) - F.get(logits, label)
