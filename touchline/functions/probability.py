"""Column functions on outcome triples (home, draw, away), odds and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12
TIE = 1e-12


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def add_up(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def parts(p: Column) -> list[Column]:
    return [F.get(p, F.lit(i)) for i in range(3)]


def normalise(p: Column) -> Column:
    """Floored at 1e-12 and scaled to sum 1; null if a part is null, NaN or infinite."""
    finite = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floored = F.transform(p, lambda x: F.greatest(x, F.lit(FLOOR)))
    return F.when(finite, let(floored, lambda q: F.transform(q, lambda x: x / add_up(parts(q)))))


def decimal_odds(text: Column) -> Column:
    """A price above 1, or null for anything else (blank, not a number, NaN, infinite)."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (x < float("inf")) & (x > 1), x)


def proportional(odds: Column) -> Column:
    return normalise(F.transform(odds, lambda o: 1 / o))


def shin_shares(implied: Column, z: Column) -> Column:
    """Shares under an insider share z, before they are scaled: the form that stays exact for small z."""
    book = add_up(parts(implied))
    return F.transform(implied, lambda q: 2 * (q * q / book) / (F.sqrt(z * z + 4 * (1 - z) * (q * q / book)) + z))


def shin_z(odds: Column, steps: int = 60) -> Column:
    """The insider share at which Shin's shares sum to 1, by bisection; 0 for a fair book, null for null prices; an underround book is an error."""
    implied = F.transform(odds, lambda o: 1 / o)

    def solve(q: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            over = add_up(parts(shin_shares(q, mid))) > 1
            return F.struct(F.when(over, mid).otherwise(s["lo"]).alias("lo"), F.when(over, s["hi"]).otherwise(mid).alias("hi"))

        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
        book = add_up(parts(q))
        return F.when(F.abs(book - 1) <= 1e-12, F.lit(0.0)).when(book > 1, root).when(book.isNotNull(), F.raise_error(F.lit("an underround book has no insider share")).cast("double"))

    return let(implied, solve)


def shin(odds: Column) -> Column:
    implied = F.transform(odds, lambda o: 1 / o)
    return let(F.struct(implied.alias("q"), shin_z(odds).alias("z")), lambda s: F.when(s["z"] == 0, proportional(odds)).otherwise(normalise(shin_shares(s["q"], s["z"]))))


def brier(p: Column, target: Column) -> Column:
    return add_up([F.pow(F.get(p, F.lit(i)) - (target == i).cast("double"), F.lit(2.0)) for i in range(3)]) / 3


def log_loss(p: Column, target: Column) -> Column:
    return -F.log(F.greatest(F.get(p, target), F.lit(1e-15)))


def ranked_probability_score(p: Column, target: Column) -> Column:
    h, d, _ = parts(p)
    return (F.pow(h - (target == 0).cast("double"), F.lit(2.0)) + F.pow(h + d - (target <= 1).cast("double"), F.lit(2.0))) / 2


def fractional_hit(p: Column, target: Column) -> Column:
    """1/k if the target is among the k parts within 1e-12 of the largest, else 0."""
    top = F.array_max(p)
    tied = F.size(F.filter(p, lambda x: top - x <= TIE))
    return F.when(top - F.get(p, target) <= TIE, 1 / tied).otherwise(F.lit(0.0))


def argmax(p: Column) -> Column:
    """Index of the largest part, the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def argmax_hit(p: Column, target: Column) -> Column:
    return (argmax(p) == target).cast("double")


def bin_of(x: Column, bins: int = 10) -> Column:
    """Equal-width bin by comparison with the edges i / bins; the last bin holds 1."""
    edges = F.array(*[F.lit(i) / F.lit(float(bins)) for i in range(bins)])
    return F.size(F.filter(edges, lambda e: x >= e)) - 1


def is_valid(p: Column, tolerance: float = 1e-6) -> Column:
    """Three finite parts within 0 to 1 that sum to 1."""
    inside = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    return F.coalesce((F.size(p) == 3) & inside & (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) <= tolerance), F.lit(False))


def poisson_outcomes(home: Column, away: Column, rho: Column | None = None, goals: int = 60) -> Column:
    """Triple for two Poisson rates; ``rho`` shifts the four lowest scores (whose factors cancel but for one term)."""

    def step(s: Column, g: Column) -> Column:
        ph = F.when(g == 0, F.exp(-home)).otherwise(s["ph"] * home / g)
        pa = F.when(g == 0, F.exp(-away)).otherwise(s["pa"] * away / g)
        return F.struct(ph.alias("ph"), pa.alias("pa"), (s["below"] + pa).alias("below"), (s["h"] + ph * s["below"]).alias("h"), (s["d"] + ph * pa).alias("d"))

    start = F.struct(*(F.lit(0.0).alias(c) for c in ("ph", "pa", "below", "h", "d")))
    counter = F.transform(F.sequence(F.lit(0), F.lit(goals)), lambda g: g.cast("double"))
    shift = F.lit(0.0) if rho is None else F.exp(-home - away) * home * away * rho
    return F.aggregate(counter, start, step, lambda s: normalise(F.array(s["h"] + shift, s["d"] - 2 * shift, 1 - s["h"] - s["d"] + shift)))


def points(scored: Column, conceded: Column) -> Column:
    return F.when(scored > conceded, 3).when(scored == conceded, 1).when(scored < conceded, 0)


def outcome(home_goals: Column, away_goals: Column) -> Column:
    """0 home, 1 draw, 2 away; null if a count is."""
    return F.when(home_goals > away_goals, 0).when(home_goals == away_goals, 1).when(home_goals < away_goals, 2)


def outcome_index(label: Column) -> Column:
    return F.when(label == "H", 0).when(label == "D", 1).when(label == "A", 2)


def week_block(timestamp: Column) -> Column:
    """Monday of the ISO week of epoch seconds, as text."""
    return F.date_format(F.date_trunc("week", F.timestamp_seconds(timestamp)), "yyyy-MM-dd")


def iso_date(timestamp: Column) -> Column:
    return F.date_format(F.timestamp_seconds(timestamp), "yyyy-MM-dd")


def parse_kickoff(date: Column, time: Column) -> Column:
    """Epoch seconds of D/M/YY or D/M/YYYY and HH:MM (further parts ignored; noon if blank)."""
    d = F.split(date, "/")
    year = F.get(d, F.lit(2)).cast("int")
    clock = F.split(F.when(F.trim(time) == "", F.lit(None)).otherwise(F.trim(time)), ":")
    hour, minute = F.coalesce(F.get(clock, F.lit(0)).cast("int"), F.lit(12)), F.coalesce(F.get(clock, F.lit(1)).cast("int"), F.lit(0))
    stamp = F.make_timestamp(F.when(year < 100, year + 2000).otherwise(year), F.get(d, F.lit(1)).cast("int"), F.get(d, F.lit(0)).cast("int"), hour, minute, F.lit(0))
    return F.unix_seconds(stamp)


def key_digest(keys: Column) -> Column:
    """SHA-256 of the distinct keys in order, one a line."""
    return F.sha2(F.concat(F.concat_ws("\n", F.sort_array(F.collect_set(keys))), F.lit("\n")), 256)
