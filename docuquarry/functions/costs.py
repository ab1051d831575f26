"""Prices of model calls and waits between attempts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token read from or written to the cache costs beside one of the input.
CACHE_READ, CACHE_WRITE = 0.1, 1.25


def cost_usd(model: Column, prices: dict[str, tuple[float, float]], input_tokens: Column, output_tokens: Column, cache_read: Column | None = None, cache_write: Column | None = None) -> Column:
    """The price of a call from prices a million tokens (input, output), to six places; 0 for unknown models, null counts are 0."""
    n = lambda c: F.lit(0) if c is None else F.coalesce(c, F.lit(0))
    rate = lambda i: F.coalesce(*[F.when(model == m, F.lit(p[i])) for m, p in prices.items()], F.lit(0.0))
    paid = n(input_tokens) + CACHE_READ * n(cache_read) + CACHE_WRITE * n(cache_write)
    return F.round((paid * rate(0) + n(output_tokens) * rate(1)) / 1e6, 6)


def jittered_backoff(attempt: Column, key: Column, base: float, cap: float = 60.0, seed: int = 0) -> Column:
    """Seconds before an attempt (from 1): evenly spread from 0 to base doubled each time, cap at most. The draw is a digest of key, attempt and seed, so a rerun waits as long."""
    ceiling = F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), attempt.cast("string"), F.lit(str(seed)))), 1, 7), 16, 10).cast("long")
    return ceiling * drawn / float(1 << 28)
