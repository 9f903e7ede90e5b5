"""Income tax: slabs, rebate, surcharge with marginal relief, regimes, gains, deductions, forms.

Every taxpayer is one row, and everything is expressions over it, so nothing
shuffles. Amounts are decimals; each slab's part is rounded half up to the paisa
before parts are added.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules

MONEY = "decimal(18,2)"
INPUTS = (
    "gross_salary", "interest_income", "dividend_income", "rental_income_net", "business_income", "other_income", "capital_gain_equity_stcg", "capital_gain_equity_ltcg",
    "capital_gain_other", "deduction_80c", "deduction_80ccd_1b", "deduction_80ccd_2", "deduction_80d_self", "deduction_80d_parents", "deduction_80e", "deduction_80g",
    "deduction_80gg", "deduction_80tta_or_ttb", "home_loan_interest_self", "home_loan_interest_letout",
)
FLAGS = {"is_salaried": True, "is_pensioner": False, "is_senior": False, "is_super_senior": False}
ZERO = Decimal(0)


def m(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast(MONEY)


def _share(amount: Column, percent) -> Column:
    """So many per cent, half up to the paisa."""
    return F.round(amount.cast("decimal(18,4)") * F.lit(Decimal(str(percent))).cast("decimal(6,2)") / 100, 2).cast(MONEY)


def slab_tax(income: Column, slabs: Sequence[tuple[int | None, int]]) -> Column:
    parts, lower = [], 0
    for upper, percent in slabs:
        top = income if upper is None else F.least(income, m(upper))
        parts.append(_share(F.greatest(top - m(lower), m(0)).cast(MONEY), percent))
        lower = upper
    return reduce(lambda a, b: a + b, parts).cast(MONEY)


def _by_age(amount, of_slabs) -> Column:
    return F.when(F.col("is_super_senior"), of_slabs(amount, rules.OLD_SLABS["super_senior"])).when(F.col("is_senior"), of_slabs(amount, rules.OLD_SLABS["senior"])).otherwise(of_slabs(amount, rules.OLD_SLABS["below_60"]))


def rebate(taxable: Column, slab: Column, threshold: int, cap: int) -> Column:
    return F.when(taxable <= threshold, F.least(slab, m(cap))).otherwise(m(0))


def _top(income: Column, brackets, value) -> Column:
    """``value`` of the highest bracket that income exceeds, else null."""
    return F.coalesce(*(F.when(income > t, value(t, p)) for t, p in reversed(brackets)))


def surcharge(tax: Column, income: Column, brackets) -> Column:
    return F.coalesce(_top(income, brackets, lambda t, p: _share(tax, p)), m(0))


def marginal_relief(tax: Column, charge: Column, income: Column, brackets, tax_at) -> Column:
    """What of a surcharge exceeds the income beyond its threshold, given the tax at the threshold."""
    relief = _top(income, brackets, lambda t, p: F.least(F.greatest((tax + charge - tax_at(t) - (income - m(t))).cast(MONEY), m(0)), charge))
    return F.when((charge > 0) & (tax > 0), F.coalesce(relief, m(0))).otherwise(m(0))


def equity_tax(stcg: Column, ltcg: Column, rates) -> Column:
    short, long, exempt = rates
    return (_share(stcg, short) + _share(F.greatest(ltcg - m(exempt), m(0)).cast(MONEY), long)).cast(MONEY)


def filled(taxpayers: DataFrame) -> DataFrame:
    """All inputs as decimals and flags; missing ones are zero, salaried and below 60."""
    have = set(taxpayers.columns)
    amounts = {c: m(F.coalesce(F.col(c), F.lit(0))) if c in have else m(0) for c in INPUTS}
    flags = {c: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d) for c, d in FLAGS.items()}
    return taxpayers.withColumns(amounts | flags)


def _gross() -> Column:
    return reduce(lambda a, b: a + b, (F.col(c) for c in ("gross_salary", "interest_income", "dividend_income", "rental_income_net", "business_income", "other_income", "capital_gain_other"))).cast(MONEY)


def _chapter_old() -> Column:
    caps, cap = rules.SECTION_CAPS, lambda c, n: F.least(F.col(c), m(n))
    by_age = lambda c, senior, other: F.when(F.col("is_senior"), cap(c, senior)).otherwise(cap(c, other))
    return (
        cap("deduction_80c", caps["80C"]) + cap("deduction_80ccd_1b", caps["80CCD1B"]) + by_age("deduction_80d_self", caps["80D_senior"], caps["80D_self"])
        + cap("deduction_80d_parents", caps["80D_senior"]) + F.col("deduction_80e") + F.col("deduction_80g") + F.col("deduction_80gg")
        + by_age("deduction_80tta_or_ttb", caps["80TTB"], caps["80TTA"]) + F.col("deduction_80ccd_2")
    ).cast(MONEY)


def regime(taxpayers: DataFrame, fy: str, new: bool, name: str) -> DataFrame:
    """Adds ``{name}_*`` columns of one regime; ``taxpayers`` is filled."""
    if fy not in rules.NEW_SLABS:
        raise ValueError(f"no tax rules for {fy}")
    p = lambda c: F.col(f"{name}_{c}")
    brackets = rules.NEW_SURCHARGE if new else rules.OLD_SURCHARGE
    threshold, cap = rules.NEW_REBATE[fy] if new else rules.OLD_REBATE
    slabs = (lambda x: slab_tax(x, rules.NEW_SLABS[fy])) if new else (lambda x: _by_age(x, slab_tax))
    standard = F.when(F.col("is_salaried") | F.col("is_pensioner"), m(rules.STANDARD_DEDUCTION[fy][new])).otherwise(m(0))
    if new:
        house, chapter = F.least(F.col("home_loan_interest_letout"), m(200000)), F.col("deduction_80ccd_2")
    else:
        house, chapter = F.least(F.col("home_loan_interest_self"), m(rules.SECTION_CAPS["24b"])) + F.col("home_loan_interest_letout"), _chapter_old()

    out = taxpayers.withColumn(f"{name}_gross", _gross()).withColumn(f"{name}_deductions", (standard + house + chapter).cast(MONEY))
    out = out.withColumn(f"{name}_taxable", F.greatest((p("gross") - p("deductions")).cast(MONEY), m(0))).withColumn(f"{name}_slab_tax", slabs(p("taxable")))
    out = out.withColumn(f"{name}_special_tax", equity_tax(F.col("capital_gain_equity_stcg"), F.col("capital_gain_equity_ltcg"), rules.EQUITY[fy]))
    out = out.withColumn(f"{name}_rebate", rebate(p("taxable"), p("slab_tax"), threshold, cap))
    out = out.withColumn(f"{name}_tax", F.greatest((p("slab_tax") + p("special_tax") - p("rebate")).cast(MONEY), m(0))).withColumn(f"{name}_full_surcharge", surcharge(p("tax"), p("gross"), brackets))
    out = out.withColumn(f"{name}_relief", marginal_relief(p("tax"), p("full_surcharge"), p("gross"), brackets, lambda t: slabs(m(t))))
    out = out.withColumn(f"{name}_surcharge", (p("full_surcharge") - p("relief")).cast(MONEY)).withColumn(f"{name}_cess", _share((p("tax") + p("surcharge")).cast(MONEY), rules.CESS))
    return out.withColumn(f"{name}_total", (p("tax") + p("surcharge") + p("cess")).cast(MONEY))


def compare(taxpayers: DataFrame, fy: str) -> DataFrame:
    """Both regimes, their difference and which is cheaper."""
    both = regime(regime(filled(taxpayers), fy, False, "old"), fy, True, "new")
    delta = (F.col("old_total") - F.col("new_total")).cast(MONEY)
    return both.withColumn("delta", delta).withColumn("recommendation", F.when(delta > 0, "new").when(delta < 0, "old").otherwise("neutral"))


def what_if(taxpayers: DataFrame, fy: str, scenarios: dict[str, dict[str, int]]) -> DataFrame:
    """The comparison for each named change of inputs, with the saving against the unchanged row."""
    base = compare(taxpayers, fy).select("user_id", F.least("old_total", "new_total").alias("_base"))
    parts = [compare(taxpayers.withColumns({c: F.lit(v) for c, v in patch.items()}), fy).select("user_id", F.lit(name).alias("scenario"), F.least("old_total", "new_total").alias("tax")) for name, patch in sorted(scenarios.items())]
    return reduce(DataFrame.unionByName, parts).join(base, "user_id").withColumn("saving", (F.col("_base") - F.col("tax")).cast(MONEY)).drop("_base")


def capital_gains(lines: DataFrame, fy: str) -> DataFrame:
    """Equity gains (user_id, realised_on, kind stcg/ltcg, amount) by user: those before the cut at the old rates, later ones at the year's; each side has its own exemption."""
    cut = F.col("realised_on") < F.lit(rules.EQUITY_CUT).cast("date")
    amount = F.greatest(m(F.col("amount")), m(0))
    total = lambda c: F.coalesce(F.sum(F.when(c, amount)), m(0)).cast(MONEY)
    sums = lines.groupBy("user_id").agg(*(total((F.col("kind") == k) & (cut if early else ~cut)).alias(f"{k}_{'pre' if early else 'post'}") for k in ("stcg", "ltcg") for early in (True, False)))
    pre, post = rules.EQUITY_BEFORE, rules.EQUITY[fy]
    out = sums.withColumn("stcg_tax", (_share(F.col("stcg_pre"), pre[0]) + _share(F.col("stcg_post"), post[0])).cast(MONEY))
    out = out.withColumn("ltcg_tax", (_share(F.greatest(F.col("ltcg_pre") - m(pre[2]), m(0)).cast(MONEY), pre[1]) + _share(F.greatest(F.col("ltcg_post") - m(post[2]), m(0)).cast(MONEY), post[1])).cast(MONEY))
    return out.withColumn("exemption_used", (F.least(F.col("ltcg_pre"), m(pre[2])) + F.least(F.col("ltcg_post"), m(post[2]))).cast(MONEY)).withColumn("total_tax", (F.col("stcg_tax") + F.col("ltcg_tax")).cast(MONEY))


def hra_exemption(hra: Column, rent: Column, basic: Column, city: Column) -> Column:
    metro = F.lower(F.trim(F.coalesce(city, F.lit("")))).isin(*rules.HRA_METROS)
    part = F.when(metro, _share(m(basic), 50)).otherwise(_share(m(basic), 40))
    return F.least(F.greatest(m(hra), m(0)), F.greatest(part, m(0)), F.greatest((m(rent) - _share(m(basic), 10)).cast(MONEY), m(0)))


def utilisation(taxpayers: DataFrame) -> DataFrame:
    """Cap, claim and rest of each deduction section, a row each; null caps have none."""
    caps, senior = rules.SECTION_CAPS, F.col("is_senior")
    by_age = lambda a, b: F.when(senior, m(a)).otherwise(m(b))
    sections = (
        ("80C/80CCC/80CCD(1)", "deduction_80c", m(caps["80C"])), ("80CCD(1B)", "deduction_80ccd_1b", m(caps["80CCD1B"])),
        ("80D (self)", "deduction_80d_self", by_age(caps["80D_senior"], caps["80D_self"])), ("80D (parents)", "deduction_80d_parents", m(caps["80D_senior"])),
        ("80E", "deduction_80e", F.lit(None).cast(MONEY)), ("80TTA/80TTB", "deduction_80tta_or_ttb", by_age(caps["80TTB"], caps["80TTA"])),
        ("24(b) self-occupied", "home_loan_interest_self", m(caps["24b"])),
    )
    rows = F.array(*(F.struct(F.lit(s).alias("section"), cap.alias("cap"), F.col(c).alias("claimed"), F.greatest((cap - F.col(c)).cast(MONEY), F.when(cap.isNotNull(), m(0))).alias("_rest")) for s, c, cap in sections))
    return filled(taxpayers).select("user_id", F.explode(rows).alias("s")).select("user_id", "s.section", "s.cap", "s.claimed", F.when(F.col("s.cap").isNotNull(), F.col("s._rest")).alias("remaining"))


def itr_form(profiles: DataFrame) -> DataFrame:
    """The return form for each profile, with what rules out the simplest one."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in profiles.columns else F.lit(False)
    resident = F.coalesce(F.col("is_resident"), F.lit(True)) if "is_resident" in profiles.columns else F.lit(True)
    high = F.col("total_income") > 5000000
    farm = F.coalesce(F.col("agricultural_income"), F.lit(0)) > 5000 if "agricultural_income" in profiles.columns else F.lit(False)
    checks = (
        (~resident, "non_resident"), (high, "income_over_50_lakh"), (flag("has_capital_gains"), "capital_gains"), (flag("has_several_houses"), "several_houses"),
        (flag("has_house_loss"), "house_loss"), (flag("has_foreign_assets"), "foreign_assets"), (flag("is_director"), "director_or_unlisted_shares"), (farm, "agricultural_income"),
    )
    blockers = F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in checks)), lambda x: x.isNotNull())
    simple = flag("is_presumptive") & ~high & ~flag("has_capital_gains") & ~flag("has_foreign_assets") & resident
    return profiles.withColumn("blockers", blockers).withColumn("form", F.when(flag("has_business_income"), F.when(simple, "ITR-4").otherwise("ITR-3")).when(F.size("blockers") == 0, "ITR-1").otherwise("ITR-2"))


def simple_new_regime(income: Column, start_year: int) -> dict[str, Column]:
    """The short calculator of compliance reports: slabs and rebate with relief at its edge; no standard deduction, no surcharge."""
    fy = {2023: "2023-24", 2024: "2024-25"}.get(start_year, "2025-26" if start_year >= 2025 else "2023-24")
    threshold, cap = rules.NEW_REBATE[fy]
    taxable = F.greatest(m(income), m(0))
    base = slab_tax(taxable, rules.NEW_SLABS[fy])
    back = F.when(taxable <= threshold, F.least(base, m(cap))).when(taxable <= threshold + cap, F.greatest(F.least(m(cap), (base - (taxable - m(threshold))).cast(MONEY)), m(0))).otherwise(m(0))
    after = F.greatest((base - back).cast(MONEY), m(0))
    cess = _share(after, rules.CESS)
    return {"tax_before_rebate": base, "rebate": back, "tax_after_rebate": after, "cess": cess, "total_tax": (after + cess).cast(MONEY)}
