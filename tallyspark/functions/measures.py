"""Body measures, loans and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import bind


def bmi(weight_kg: Column, height_cm: Column) -> Column:
    return F.when(height_cm > 0, F.round(weight_kg / F.pow(height_cm / 100, 2), 1))


def age_years(born: Column, on: Column, days_per_year: float = 365) -> Column:
    return F.floor(F.datediff(on, born) / days_per_year)


def bmr(weight_kg: Column, height_cm: Column, age: Column, male: Column) -> Column:
    """Mifflin-St Jeor, whole kilocalories; null where the sex isn't known."""
    return F.round(10 * weight_kg + 6.25 * height_cm - 5 * age + F.when(male, 5).when(~male, -161), 0)


def whr(waist: Column, hips: Column) -> Column:
    return F.when(hips > 0, F.round(waist / hips, 3))


def emi(principal: Column, yearly_percent: Column, months: Column) -> Column:
    """Equal monthly instalment of a reducing balance; without interest, principal / months."""
    r = yearly_percent / 1200
    return F.when(yearly_percent == 0, principal / months).otherwise(principal * r * F.pow(1 + r, months) / (F.pow(1 + r, months) - 1))


def flat_emi(principal: Column, flat_percent: Column, months: Column) -> Column:
    return (principal + principal * flat_percent / 100 * months / 12) / months


def effective_rate(principal: Column, payment: Column, months: Column, steps: int = 200, high: float = 100.0) -> Column:
    """Yearly percent at which `payment` pays the principal off, by bisection; null if the payments are too few."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(high).alias("hi"))

    def solved(v: Column) -> Column:
        # v holds the row's values: an expression used in a step is computed in each step. Neighbouring doubles have no middle left to try.
        def over(mid: Column) -> Column:
            r = F.greatest(mid, F.lit(1e-12)) / 1200
            return bind(r, lambda r: bind(F.pow(1 + r, v["months"]), lambda grown: v["principal"] * r * grown / (grown - 1) > v["payment"]))

        def halve(s: Column, _: Column) -> Column:
            moved = lambda mid: F.when(over(mid), F.struct(s["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), s["hi"].alias("hi")))
            return bind((s["lo"] + s["hi"]) / 2, lambda mid: F.when((mid == s["lo"]) | (mid == s["hi"]), s).otherwise(moved(mid)))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: F.round((s["lo"] + s["hi"]) / 2, 4))
        return F.when((v["payment"] > 0) & (v["months"] > 0) & (v["payment"] * v["months"] >= v["principal"]), found)

    return bind(F.struct(principal.alias("principal"), payment.alias("payment"), months.alias("months")), solved)


def overdraft_cost(principal: Column, fd_percent: Column, spread: Column, months: Column) -> Column:
    """What borrowing against a deposit costs net: the spread over the deposit's own rate."""
    return emi(principal, fd_percent + spread, months) * months - principal - principal * fd_percent / 100 * months / 12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def principal_for(payment: Column, yearly_percent: Column, months: Column) -> Column:
    """The principal that a monthly payment pays off; null unless payment and months are over 0 and the rate isn't negative."""
    r = yearly_percent / 1200
    able = (payment > 0) & (months > 0) & (yearly_percent >= 0)
    return F.when(able, F.when(yearly_percent == 0, payment * months).otherwise(payment * (1 - F.pow(1 + r, -months)) / r))
