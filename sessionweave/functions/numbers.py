"""Statistics and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: upper bounds of the token histogram; bins are (lower, upper], zero in the first
TOKEN_EDGES = (0, 50, 100, 250, 500, 1000, 2000, 4000, 8000, 16000, 32000)
#: fixed values: sizes of replaced text that count as huge
HUGE = (1024, 4096, 16384, 65536)


def token_bin(n: Column) -> Column:
    """Index of the histogram bin; the last is open."""
    out = F
    for i, top in enumerate(TOKEN_EDGES[1:]):
        out = out.when(n <= top, i)
    return out.otherwise(len(TOKEN_EDGES) - 1)


def token_labels() -> list[str]:
    return [f"{a}-{b}" for a, b in zip(TOKEN_EDGES, TOKEN_EDGES[1:], strict=False)] + [f"{TOKEN_EDGES[-1]}+"]


def ratio_bin(ratio: Column) -> Column:
    """Inflation class; half-open, null apart."""
    return F.when(ratio.isNull(), "no_core_change").when(ratio < 4, "lt4").when(ratio < 10, "4to10").when(ratio < 25, "10to25").otherwise("gte25")


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation at (n-1)*q, as an aggregate."""
    return F.percentile(x, F.lit(q))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null for none."""
    return F.when(whole > 0, part / whole)


def cost(tokens: dict[str, Column], prices: dict[str, Column]) -> Column:
    """Struct of cost by token class at prices for a million tokens, and their total."""
    each = {k: prices[k] * tokens[k] / 1e6 for k in tokens}
    total = sum(each.values(), F.lit(0.0))
    return F.struct(*(v.alias(k) for k, v in each.items()), total.alias("total"))


def cache_prices(price: Column) -> Column:
    """Read at a tenth; written for 5 minutes at 5/4 and for an hour at double the input price."""
    return F.struct((price * 0.1).alias("read"), (price * 1.25).alias("write_5m"), (price * 2.0).alias("write_1h"))


def blended_write_price(short: Column, long: Column, price: Column) -> Column:
    """Price of cache writes weighted by their tokens; the 5 minute price where there are none."""
    p = cache_prices(price)
    return F.when(short + long > 0, (short * p["write_5m"] + long * p["write_1h"]) / (short + long)).otherwise(p["write_5m"])


def close(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return F.abs(a - b) <= eps
