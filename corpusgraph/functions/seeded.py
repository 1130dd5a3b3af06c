"""Seeded hashes and random streams; the same on any partitioning."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph.functions.exprs import let

# Fixed values of the two published algorithms.
_MASK = 0xFFFFFFFF
_FNV_START, _FNV_PRIME = 0x811C9DC5, 0x01000193
_STEP, _SEED_FACTOR = 0x6D2B79F5, 0x9E3779B1


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _low32(value: Column) -> Column:
    return value.bitwiseAND(_long(_MASK))


def multiply32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product, by 16-bit halves so that nothing overflows a long."""
    low = a * b.bitwiseAND(_long(0xFFFF))
    high = (a * F.shiftright(b, 16)).bitwiseAND(_long(0xFFFF))
    return _low32(low + F.shiftleft(high, 16))


def key_hash(key: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units."""
    def units(char: Column) -> Column:
        point = F.ascii(char).cast("long")
        above = point - 0x10000
        return F.when(point > 0xFFFF, F.array(
            F.shiftright(above, 10) + 0xD800, above.bitwiseAND(_long(0x3FF)) + 0xDC00)).otherwise(F.array(point))

    codes = F.flatten(F.transform(F.split(key, ""), units))
    return F.aggregate(codes, _long(_FNV_START), lambda h, c: _low32(h.bitwiseXOR(c) * _FNV_PRIME))


def stream_seed(seed: Column, key: Column) -> Column:
    """Seed of a key's own stream."""
    return multiply32(_low32(seed.cast("long")), _long(_SEED_FACTOR)).bitwiseXOR(key_hash(key))


def draw(seed: Column, n: Column) -> Column:
    """The n-th value, from 1, of a stream in [0, 1)."""
    state = _low32(_low32(seed.cast("long")) + multiply32(_low32(n.cast("long")), _long(_STEP)))

    def mix(s: Column) -> Column:
        first = multiply32(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(_long(1)))
        return let(first, lambda t: let(
            t.bitwiseXOR(_low32(t + multiply32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(_long(61))))),
            lambda u: u.bitwiseXOR(F.shiftright(u, 14)) / 4294967296.0))

    return let(state, mix)


def draws(seed: Column, count: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda n: draw(seed, n))


def in_range(value: Column, low: float, high: float) -> Column:
    if low > high:
        raise ValueError(f"range needs low <= high, got {low} and {high}")
    return F.lit(low) + value * (high - low)


def whole(value: Column, low: int, high: int) -> Column:
    """Integer between both bounds, both included."""
    if low > high:
        raise ValueError(f"integer range needs low <= high, got {low} and {high}")
    return (F.lit(low) + F.floor(value * (high - low + 1))).cast("long")


def pick(value: Column, items: Column) -> Column:
    index = F.least(F.floor(value * F.size(items)), F.size(items) - 1)
    return F.get(items, index.cast("int"))


def chance(value: Column, p: float) -> Column:
    if not 0 <= p <= 1:
        raise ValueError(f"a chance lies in [0, 1], got {p}")
    return value < p


def fork(seed: Column, drawn: int, salt: Column) -> Column:
    """Seed of a stream forked after ``drawn`` values."""
    state = _low32(_low32(seed.cast("long")) + multiply32(_long(drawn), _long(_STEP)))
    return multiply32(_low32(salt.cast("long")), _long(_SEED_FACTOR)).bitwiseXOR(state)
