"""Expected value and profit of a binary bet. The forms differ on purpose and keep their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the market: fee, premium, fallback entry price.
FEE, PREMIUM, FALLBACK = 0.02, 0.01, 0.51


def expected(p: Column, entry: Column) -> Column:
    """EV1: expected value at an entry price with premium, not clamped."""
    return p * ((1 - FEE) / (entry + PREMIUM) - 1) - (1 - p)


def realised(win: Column, price: Column, fee: float = FEE, premium: float = PREMIUM) -> Column:
    """EV2 and EV3: profit with premium and a price held in [0.01, 0.99]; null where either is missing."""
    cost = F.least(F.greatest(price + premium, F.lit(0.01)), F.lit(0.99))
    return F.when(win.isNull() | price.isNull(), F.lit(None).cast("double")).when(win, (1 - fee) / cost - 1).otherwise(-1.0)


def realised_plain(win: Column, quote: Column) -> Column:
    """EV4: profit without premium."""
    return F.when(win, (1 - FEE) / quote - 1).otherwise(-1.0)


def realised_or_fallback(win: Column, entry: Column) -> Column:
    """EV5: as EV4 with a fallback entry price."""
    return realised_plain(win, F.coalesce(entry, F.lit(FALLBACK)))


def at_research_rate(p: Column, entry: Column) -> Column:
    """EV6: expected return at a researched win rate."""
    return p * (1 - FEE) / entry - 1


def fixed_price(win_rate: Column) -> Column:
    """EV7: re-evaluation at a fixed price of one half."""
    return win_rate * 0.9216 - (1 - win_rate)


def break_even(entry: Column, premium: float = PREMIUM) -> Column:
    """EV9: the win rate at which a bet at this price breaks even."""
    return (entry + premium) / (1 - FEE)
