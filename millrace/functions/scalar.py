"""Scalar column expressions: rating arithmetic, text helpers, hashed randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tournament names by weight class, matched whole and case-insensitively.
WORLD_EVENTS = ["FIFA World Cup", "Olympic Games"]
CONTINENTAL_EVENTS = [
    "Copa América", "UEFA Euro", "AFC Asian Cup", "African Cup of Nations",
    "Oceania Nations Cup", "CONCACAF Championship", "Gold Cup",
    "Confederations Cup", "EAFF Championship", "AFF Championship",
    "SAFF Cup", "WAFF Championship", "CAFA Nations Cup",
    "CONIFA World Football Cup", "CONMEBOL–UEFA Cup of Champions",
]
QUALIFYING_EVENTS = ["CONCACAF Nations League"]  # the others all contain "qualification"
WORLD_K, CONTINENTAL_K, QUALIFYING_K, FRIENDLY_K, OTHER_K = 60, 40, 30, 15, 25
HOME_ADVANTAGE, START_RATING = 100, 1500


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: str | Column) -> Column:
    """A floating-point value with NaN taken as missing."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def expected_score(own: str | Column, other: str | Column, home: bool = False) -> Column:
    diff = _col(own) - _col(other) + F.lit(float(HOME_ADVANTAGE if home else 0))
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), -diff / F.lit(400.0)))


def goal_multiplier(gap: str | Column) -> Column:
    gap = _col(gap)
    return F.when(gap <= 1, F.lit(1.0)).when(gap == 2, F.lit(1.5)).otherwise((F.lit(11.0) + gap) / F.lit(8.0))


def k_factor(tournament: str | Column) -> Column:
    name = F.lower(_col(tournament))
    return (
        F.when(name.isin([t.lower() for t in WORLD_EVENTS]), F.lit(WORLD_K))
        .when(name.isin([t.lower() for t in CONTINENTAL_EVENTS]), F.lit(CONTINENTAL_K))
        .when(name.contains("qualification") | name.isin([t.lower() for t in QUALIFYING_EVENTS]), F.lit(QUALIFYING_K))
        .when(name == "friendly", F.lit(FRIENDLY_K))
        .otherwise(F.lit(OTHER_K))
    )


def updated_rating(rating: str | Column, actual: Column, expected: Column, k: Column, multiplier: Column) -> Column:
    return _col(rating) + k * multiplier * (actual - expected)


def match_result(own: str | Column, other: str | Column) -> Column:
    own, other = _col(own), _col(other)
    return F.when(own > other, F.lit(1.0)).when(own < other, F.lit(0.0)).otherwise(F.lit(0.5))


def year_of(c: str | Column) -> Column:
    return F.year(F.to_date(_col(c)))


def moment(c: str | Column) -> Column:
    """Microseconds since 1970 as written on the clock, whatever the session time zone."""
    c = _col(c)
    seconds = F.hour(c) * 3600 + F.minute(c) * 60
    return (
        F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000
        + seconds.cast("bigint") * 1_000_000
        + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    )


def round_half_even(c: str | Column) -> Column:
    return F.rint(_col(c))


def last_token(c: str | Column, separator: str = "-") -> Column:
    return F.element_at(F.split(_col(c), separator), -1)


def row_hash(seed: int, *parts: str | Column) -> Column:
    """32 hex digits that depend only on the seed and the parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(p).cast("string") for p in parts]))


def hash_uniform(seed: int, *parts: str | Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of the hash; the same on every rerun."""
    return F.conv(F.substring(row_hash(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_normal(seed: int, *parts: str | Column) -> Column:
    """Standard normal from two hashed uniforms (Box-Muller)."""
    u1 = F.lit(1.0) - hash_uniform(seed, *parts, F.lit("a"))
    u2 = hash_uniform(seed, *parts, F.lit("b"))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
