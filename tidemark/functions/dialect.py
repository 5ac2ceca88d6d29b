"""SQL expressions in two spellings: Spark's, which the library runs, and the ANSI/DuckDB one of the oracle.

Every rule about missing values lives here: a rolling aggregate counts only non-null values against
its minimum; division by zero gives null; a comparison with null is false where it feeds a flag.
"""

from __future__ import annotations


class Dialect:
    """Spark SQL."""

    spark = True

    def table(self, name: str) -> str:
        return "{" + name + "}"

    def div(self, a: str, b: str) -> str:
        return f"try_divide({a}, {b})"

    def struct(self, *xs: str) -> str:
        return f"struct({', '.join(xs)})"

    def percentile(self, x: str, q: float) -> str:
        return f"percentile({x}, {q})"

    def collected(self, x: str) -> str:
        return f"collect_list({x})"

    def at_most(self, xs: str, x: str) -> str:
        return f"size(filter({xs}, v -> v <= {x}))"

    def adjusted_skew(self, x: str) -> str:
        """Bias-adjusted skewness."""
        return f"CASE WHEN count({x}) > 2 THEN skewness({x}) * sqrt(count({x}) * (count({x}) - 1)) / (count({x}) - 2) END"

    def sign(self, x: str) -> str:
        return f"signum({x})"

    def days(self, a: str, b: str) -> str:
        """Days from b to a."""
        return f"datediff({a}, {b})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def first_index(self, xs: str, test: str) -> str:
        """1-based position of the first element ``e`` for which the test holds; null if none."""
        return f"nullif(array_position(transform({xs}, e -> {test}), true), 0)"

    def ym(self, x: str) -> str:
        return f"date_format({x}, 'yyyy-MM')"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def explode_range(self, lo: str, hi: str) -> str:
        return f"explode(sequence({lo}, {hi}))"

    def begins(self, x: str, prefix: str) -> str:
        return f"startswith({x}, '{prefix}')"

    def lit_array(self, *xs) -> str:
        return f"array({', '.join(map(str, xs))})"


class Oracle(Dialect):
    """DuckDB."""

    spark = False

    def table(self, name: str) -> str:
        return name

    def div(self, a: str, b: str) -> str:
        return f"(({a}) / nullif({b}, 0))"

    def struct(self, *xs: str) -> str:
        return f"row({', '.join(xs)})"

    def percentile(self, x: str, q: float) -> str:
        return f"quantile_cont({x}, {q})"

    def collected(self, x: str) -> str:
        return f"list({x})"

    def at_most(self, xs: str, x: str) -> str:
        return f"len(list_filter({xs}, lambda v: v <= {x}))"

    def adjusted_skew(self, x: str) -> str:
        return f"skewness({x})"

    def sign(self, x: str) -> str:
        return f"CAST(sign({x}) AS DOUBLE)"

    def days(self, a: str, b: str) -> str:
        return f"date_diff('day', {b}, {a})"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def first_index(self, xs: str, test: str) -> str:
        return f"nullif(list_position(list_transform({xs}, lambda e: {test}), true), 0)"

    def ym(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m')"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def explode_range(self, lo: str, hi: str) -> str:
        return f"unnest(range({lo}, {hi} + 1))"

    def begins(self, x: str, prefix: str) -> str:
        return f"starts_with({x}, '{prefix}')"

    def lit_array(self, *xs) -> str:
        return f"[{', '.join(map(str, xs))}]"


SPARK, DUCK = Dialect(), Oracle()

SYMBOL = "PARTITION BY symbol ORDER BY Date"


def lag(x: str, k: int = 1, over: str = SYMBOL) -> str:
    return f"lag({x}, {k}) OVER ({over})"


def lead(x: str, k: int = 1, over: str = SYMBOL) -> str:
    return f"lead({x}, {k}) OVER ({over})"


def frame(lo: int, hi: int, over: str = SYMBOL) -> str:
    """A row frame from lo to hi, negative before the current row."""

    def edge(k: int) -> str:
        return "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"

    return f"({over} ROWS BETWEEN {edge(lo)} AND {edge(hi)})"


def rolling(f: str, x: str, width: int, least: int | None = None, prior: bool = False, over: str = SYMBOL) -> str:
    """A trailing aggregate over ``width`` rows (the current one included unless prior), null below ``least`` values."""
    w = frame(-width, -1, over) if prior else frame(-(width - 1), 0, over)
    least = width if least is None else least
    got = f"{f}({x}) OVER {w}"
    return f"CASE WHEN count({x}) OVER {w} >= {least} THEN {got} END"


def rolling_percentile(d: Dialect, x: str, q: float, width: int, least: int, prior: bool = False) -> str:
    w = frame(-width, -1) if prior else frame(-(width - 1), 0)
    return f"CASE WHEN count({x}) OVER {w} >= {least} THEN {d.percentile(x, q)} OVER {w} END"


def flag(test: str) -> str:
    """A comparison as 0.0 or 1.0, false where it is null."""
    return f"CAST(coalesce({test}, false) AS INT) * CAST(1.0 AS DOUBLE)"
