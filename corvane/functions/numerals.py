"""Chinese numerals as column expressions, without a UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it: higher-order functions, which folds are, aren't
    recognized as common subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Digits and units of Chinese numerals.
DIGITS, UNITS = "零一二三四五六七八九", {"十": 10, "百": 100, "千": 1000}


def chinese_number(text: Column) -> Column:
    """The value of a Chinese numeral below ten thousand, 〇 and 两 included; null for anything else, also for empty text."""
    value = F.map_from_arrays(F.array(*[F.lit(c) for c in [*DIGITS, "〇", "两"]]), F.array(*[F.lit(k) for k in [*range(10), 0, 2]]))
    unit = F.map_from_arrays(F.array(*[F.lit(c) for c in UNITS]), F.array(*[F.lit(v) for v in UNITS.values()]))

    def step(acc: Column, c: Column) -> Column:
        times = F.when(acc["now"] == 0, 1).otherwise(acc["now"])
        return (
            F.when(value[c].isNotNull(), F.struct(acc["sum"].alias("sum"), value[c].alias("now")))
            .when(unit[c].isNotNull(), F.struct((acc["sum"] + times * unit[c]).alias("sum"), F.lit(0).alias("now")))
            .otherwise(F.struct(F.lit(None).cast("int").alias("sum"), F.lit(None).cast("int").alias("now")))
        )

    folded = F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("now")), step, lambda a: a["sum"] + a["now"])
    return F.when(F.length(text) > 0, folded)


def format_number(n: Column) -> Column:
    """The usual Chinese spelling of a number from 1 to 9999: 12 is 十二, 105 is 一百零五; null outside."""
    digit = lambda d: F.substring(F.lit(DIGITS), d + 1, F.lit(1))
    th, hu, te, on = F.floor(n / 1000).cast("int"), (F.floor(n / 100) % 10).cast("int"), (F.floor(n / 10) % 10).cast("int"), (n % 10).cast("int")
    zero = F.lit("零")
    spelt = F.concat(
        F.when(th > 0, F.concat(digit(th), F.lit("千"))).otherwise(""),
        F.when(hu > 0, F.concat(digit(hu), F.lit("百"))).when((th > 0) & (te + on > 0), zero).otherwise(""),
        F.when(te > 0, F.when((te == 1) & (th + hu == 0), F.lit("十")).otherwise(F.concat(digit(te), F.lit("十")))).when((on > 0) & (hu > 0), zero).otherwise(""),
        F.when(on > 0, digit(on)).otherwise(""),
    )
    return F.when((n > 0) & (n < 10000), spelt)
