"""Numbers written in Chinese characters, as native higher-order expressions.

All unit characters are powers of ten, so the running unit of a number is kept
as an exponent. Runs that must stay below 10 ** 18 are added up as whole
numbers, all others digit by digit as text, so that no run is too long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperweave.functions.html import bound, gaps

# Digits, and units as powers of ten.
DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5,
          "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 1, "百": 2, "千": 3, "万": 4, "亿": 8}
# Fixed pattern: a run starts with a digit from one to nine or with ten.
RUN = "[一二两三四五六七八九十][零一二两三四五六七八九十百千万亿]*"

_DECIMAL = "decimal(38,0)"


def _lookup(table: dict[str, int], ch: Column) -> Column:
    values = F.array(*[F.lit(v) for v in table.values()])
    return F.get(values, F.instr(F.lit("".join(table)), ch) - 1)


def _power(exponent: Column) -> Column:
    """10**exponent, NULL from 10**38 on."""
    powers = F.array(*[F.lit(str(10 ** k)).cast(_DECIMAL) for k in range(38)])
    return F.get(powers, exponent)


def _plus(total: Column, digit: Column, exponent: Column) -> Column:
    return F.try_add(
        total, F.try_multiply(_power(exponent), digit.cast("decimal(1,0)"))
    ).cast(_DECIMAL)


def _zero() -> Column:
    return F.lit(0).cast(_DECIMAL)


def _characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda ch: ch != "")


def _narrow(c: Column) -> Column:
    """The units of the run together are below 10 ** 18."""
    exponents = sum(
        ((F.length(c) - F.length(F.translate(c, unit, ""))) * k for unit, k in UNITS.items()), F.lit(0))
    return ((F.length(c) <= 6) & ~c.rlike("[万亿]")) | (exponents < 17)


def _read(c: Column, start: Column, add) -> tuple[Column, Column]:
    """State ``(total, power)`` after the characters from the right, and the unit in first place."""
    def step(state: Column, ch: Column) -> Column:
        unit = _lookup(UNITS, ch)
        power = F.when(unit > state["power"], unit).otherwise(state["power"] + unit)
        return F.struct(
            F.when(unit.isNull(), add(state["total"], _lookup(DIGITS, ch), state["power"]))
            .otherwise(state["total"]).alias("total"),
            F.coalesce(power, state["power"]).alias("power"),
        )

    lead = _lookup(UNITS, F.left(c, F.lit(1)))
    body = F.when(lead.isNotNull(), F.substr(c, F.lit(2))).otherwise(c)
    return F.aggregate(
        _characters(F.reverse(body)), F.struct(start.alias("total"), F.lit(0).alias("power")), step,
        lambda s: F.when(lead > s["power"], add(s["total"], F.lit(1), lead)).otherwise(s["total"])), lead


def _whole_number(c: Column) -> Column:
    powers = F.array(*[F.lit(10 ** k).cast("bigint") for k in range(18)])
    add = lambda total, digit, power: total + digit * F.get(powers, power)
    return _read(c, F.lit(0).cast("bigint"), add)[0]


_TERMS = "array<struct<digit:int,power:int>>"


def _term(digit: Column, power: Column) -> Column:
    return F.array(F.struct(digit.cast("int").alias("digit"), power.cast("int").alias("power")))


def _written(terms: Column) -> Column:
    """Sum of digits at powers of ten as text: summed at each power, then carried from the right."""
    last = F.array_max(F.transform(terms, lambda t: t["power"])) + F.length(F.size(terms).cast("string")) + 1

    def step(s: Column, power: Column) -> Column:
        here = s["carry"] + F.aggregate(
            terms, F.lit(0), lambda n, t: n + F.when(t["power"] == power, t["digit"]).otherwise(0))
        return F.struct((F.floor(here / 10)).cast("int").alias("carry"),
                        F.concat(F.pmod(here, F.lit(10)).cast("string"), s["text"]).alias("text"))

    digits = F.aggregate(
        F.sequence(F.lit(0), F.coalesce(last, F.lit(0))),
        F.struct(F.lit(0).alias("carry"), F.lit("").alias("text")), step, lambda s: s["text"])
    return _without_zeros(digits)


def _without_zeros(digits: Column) -> Column:
    plain = F.regexp_replace(digits, "^0+", "")
    return F.when(plain == "", "0").otherwise(plain)


def _digit_text(c: Column) -> Column:
    """The same sum in writing."""
    add = lambda terms, digit, power: F.concat(terms, _term(digit, power))
    return bound(_read(c, F.array().cast(_TERMS), add)[0], _written)


def compat_text(c: Column) -> Column:
    """Digits of a run, with the quirks kept for parity.

    Characters are read from the right. A unit that is larger than the running
    one replaces it, any other multiplies it; digits are added at the running
    unit. A unit in first place stands for itself only when it replaces. So
    十万 is 0 and 二零一八 is 11.
    """
    return F.when(_narrow(c), _whole_number(c).cast("string")).otherwise(_digit_text(c))


def compat_number(c: Column) -> Column:
    """The same as a number of up to 38 digits; NULL beyond."""
    return F.when(_narrow(c), _whole_number(c).cast(_DECIMAL)).otherwise(_digit_text(c).try_cast(_DECIMAL))


def strict_number(c: Column) -> Column:
    """Value of a run by the usual rules: 十万 is 100000, 二零一八 is 2018. NULL beyond 38 digits,
    which :func:`strict_text` has."""
    def step(s: Column, ch: Column) -> Column:
        digit, unit = _lookup(DIGITS, ch), _lookup(UNITS, ch)
        small = unit < 4
        counted = F.when(small, F.greatest(s["digit"], F.lit(1))).otherwise(F.lit(0))
        group = F.when(small, _plus(s["group"], counted, unit)).otherwise(
            F.try_add(s["group"], s["digit"].cast(_DECIMAL)).cast(_DECIMAL))
        lifted = F.when(
            unit == 8, F.try_multiply(F.try_add(s["total"], group), _power(F.lit(8)))
        ).otherwise(F.try_add(s["total"], F.try_multiply(group, _power(F.lit(4)))))
        return F.struct(
            F.when(unit >= 4, lifted.cast(_DECIMAL)).otherwise(s["total"]).alias("total"),
            F.when(digit.isNotNull(), s["group"]).when(small, group)
            .otherwise(_zero()).alias("group"),
            F.coalesce(digit, F.lit(0)).alias("digit"),
        )

    by_unit = F.aggregate(
        F.filter(F.split(c, ""), lambda ch: ch != ""),
        F.struct(_zero().alias("total"), _zero().alias("group"), F.lit(0).alias("digit")),
        step,
        lambda s: F.try_add(
            F.try_add(s["total"], s["group"]), s["digit"].cast(_DECIMAL)).cast(_DECIMAL),
    )
    spelt = F.translate(c, "".join(DIGITS), "".join(str(v) for v in DIGITS.values()))
    has_unit = c.rlike(f"[{''.join(UNITS)}]")
    return F.when(has_unit, by_unit).otherwise(spelt.try_cast(_DECIMAL))


def _strict_terms(c: Column) -> Column:
    """The strict value as digits at powers of ten.

    Read from the right. 万 lifts what is left of it by four powers up to the next
    large unit, every 亿 all that is left of it by eight more. A small unit waits
    for its digit and counts once without one; a digit counts before a unit or at
    the end, one before another digit does not.
    """
    def step(s: Column, ch: Column) -> Column:
        digit, unit = _lookup(DIGITS, ch), _lookup(UNITS, ch)
        small, large, waits = unit < 4, unit >= 4, s["waiting"].isNotNull()
        alone = F.when(waits, _term(F.lit(1), s["waiting"])).otherwise(F.array().cast(_TERMS))
        own = F.when(waits, _term(F.greatest(digit, F.lit(1)), s["waiting"])) \
            .when(s["open"], _term(digit, s["high"] + s["low"])).otherwise(F.array().cast(_TERMS))
        return F.struct(
            F.concat(s["terms"], F.when(digit.isNotNull(), own).when(unit.isNotNull(), alone)
                     .otherwise(F.array().cast(_TERMS))).alias("terms"),
            F.when(small, unit + s["high"] + s["low"]).alias("waiting"),
            F.coalesce(large, F.lit(False)).alias("open"),
            F.when(unit == 8, s["high"] + 8).otherwise(s["high"]).alias("high"),
            F.when(unit == 8, F.lit(0)).when(unit == 4, F.lit(4)).otherwise(s["low"]).alias("low"))

    start = F.struct(
        F.array().cast(_TERMS).alias("terms"), F.lit(None).cast("int").alias("waiting"), F.lit(True).alias("open"),
        F.lit(0).alias("high"), F.lit(0).alias("low"))
    return F.aggregate(_characters(F.reverse(c)), start, step, lambda s: F.concat(
        s["terms"], F.when(s["waiting"].isNotNull(), _term(F.lit(1), s["waiting"])).otherwise(
            F.array().cast(_TERMS))))


def strict_text(c: Column) -> Column:
    """Digits of a run by the usual rules, of any length."""
    spelt = F.translate(c, "".join(DIGITS), "".join(str(v) for v in DIGITS.values()))
    long = F.when(c.rlike(f"[{''.join(UNITS)}]"), bound(_strict_terms(c), _written)).otherwise(_without_zeros(spelt))
    return F.coalesce(strict_number(c).cast("string"), long)


def number_text(c: Column, strict: bool = False) -> Column:
    """The run as decimal digits, by the strict rules or with the quirks."""
    return strict_text(c) if strict else compat_text(c)


def replace_numbers(c: Column | str, strict: bool = False) -> Column:
    """Replace every run of number characters inside a text by its digits."""
    def rule(text: Column) -> Column:
        def joined(runs: Column) -> Column:
            return F.array_join(F.zip_with(
                gaps(text, RUN, runs, literal=False), runs,
                lambda gap, run: F.when(run.isNull(), gap)
                .otherwise(F.concat(gap, number_text(run, strict)))), "")

        return F.when(text.rlike(RUN), bound(
            F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), joined)).otherwise(text)

    return bound(F.col(c) if isinstance(c, str) else c, rule)
