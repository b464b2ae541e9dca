"""Obligations, fees and penalties of contracts: conflicts, totals, exposures, ratios.

Rows belong to a contract (``contract_id``); every step groups or windows by it alone, so a table
partitioned by contract is never shuffled again. Money sums run on decimals: they don't depend on
the order in which tasks finish. A sum is *known* only if it has an amount and one currency; an
empty sum or one over several currencies is unavailable, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions.money import RECURRING, difference_class, label_key, monthly_factor
from tallystone.functions.text import label_similarity

# Which source wins.
SOURCE_RANK = {"type_details": 5, "financial_obligation": 4, "fee_item": 3, "penalty_item": 3, "extracted_number": 2}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
# Special amounts of which a contract may state several.
REPEATED = ("statedTotalCost", "salaryComponent")
# What is never a payment obligation.
EXCLUDED_ROLES = ("asset_value", "principal", "reference_value", "scenario_balance", "scenario_payment", "credit_limit", "coverage_limit", "income", "conditional_income", "non_cash_benefit")
EXCLUDED_CONTEXTS = ("early_settlement_scenario", "default_scenario", "cancellation_scenario", "insurance_claim_scenario", "reference_only")
BY = "contract_id"
_MONEY = "decimal(38,6)"


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def guaranteed(mandatory: Column, conditional: Column) -> Column:
    return _is(mandatory) & ~_is(conditional)


def normal_path(mandatory: Column, conditional: Column) -> Column:
    """Not conditional, and not stated to be optional."""
    return ~_is(conditional) & F.coalesce(mandatory, F.lit(True))


def refundability(is_deposit: Column, refundable: Column) -> Column:
    """'include', 'exclude', or 'exclude_unresolved' for a deposit that nothing is said about."""
    return F.when(_is(refundable), "exclude").when(_is(is_deposit) & refundable.isNull(), "exclude_unresolved").otherwise("include")


def eligible_role(role: Column, context: Column) -> Column:
    return ~role.isin(*EXCLUDED_ROLES) & ~context.isin(*EXCLUDED_CONTEXTS)


def money(value: Column, currency: Column) -> Column:
    known = value.isNotNull() & currency.isNotNull()
    return F.struct(F.when(known, F.round(value.cast(_MONEY), 2).cast("double")).alias("value"), F.when(known, currency).alias("currency"), F.when(known, "known").otherwise("unavailable").alias("status"))


def _guarded(total: Column, amount: Column, currency: Column, where: Column) -> Column:
    ok = where & amount.isNotNull() & currency.isNotNull()
    lo, hi = F.min(F.when(ok, currency)), F.max(F.when(ok, currency))
    return money(F.when(lo == hi, total), F.when(lo == hi, lo))


def known_sum(amount: Column, currency: Column, where: Column | None = None) -> Column:
    """Aggregate: the sum over rows with amount and currency, if they share one currency."""
    where = F.lit(True) if where is None else _is(where)
    return _guarded(F.sum(F.when(where & currency.isNotNull(), amount.cast(_MONEY))), amount, currency, where)


def known_max(amount: Column, currency: Column, where: Column | None = None) -> Column:
    where = F.lit(True) if where is None else _is(where)
    return _guarded(F.max(F.when(where & currency.isNotNull(), amount.cast(_MONEY))), amount, currency, where)


def sum_of(*parts: Column) -> Column:
    """The sum of money structs of one row under the same rule."""
    known = F.filter(F.array(*parts), lambda m: m["status"] == "known")
    currencies = F.array_distinct(F.transform(known, lambda m: m["currency"]))
    total = F.aggregate(known, F.lit(0).cast(_MONEY), lambda s, m: (s + m["value"].cast(_MONEY)).cast(_MONEY))
    return F.when(F.size(currencies) == 1, money(total, F.get(currencies, F.lit(0)))).otherwise(money(F.lit(None), F.lit(None)))


def recurring_commitment(obligations: DataFrame) -> DataFrame:
    """Per contract the monthly and annual equivalent of its mandatory recurring obligations, what is
    billed monthly to the day, whether currencies mix, and which obligations count."""
    factor = monthly_factor(F.col("frequency"))
    counts = _is(F.col("mandatory")) & factor.isNotNull() & F.col("amount").isNotNull() & F.col("currency").isNotNull()
    rows = obligations.withColumn("_counts", counts).withColumn("_monthly", F.col("amount") * factor)
    out = rows.groupBy(BY).agg(
        known_sum(F.col("_monthly"), F.col("currency"), F.col("_counts")).alias("monthly_equivalent"),
        known_sum(F.col("_monthly") * 12, F.col("currency"), F.col("_counts")).alias("annual_equivalent"),
        known_sum(F.col("amount"), F.col("currency"), F.col("_counts") & (F.col("frequency") == "monthly")).alias("actual_monthly"),
        (F.min(F.when(F.col("_counts"), F.col("currency"))) < F.max(F.when(F.col("_counts"), F.col("currency")))).alias("mixed"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_counts"), F.struct("ordinal", "id")))), lambda x: x["id"]).alias("included_ids"),
    )
    none = money(F.lit(None), F.lit(None))
    actual = F.when(~_is(F.col("mixed")) & (F.col("actual_monthly.value") > 0), F.col("actual_monthly")).otherwise(none)
    return out.withColumn("mixed", _is(F.col("mixed"))).withColumn("actual_monthly", actual)


def fee_collection(fees: DataFrame) -> DataFrame:
    """Totals of a contract's fees; a deposit counts as mandatory only if it is said not to be refundable."""
    amount, currency = F.col("amount"), F.col("currency")
    include = refundability(F.col("is_deposit"), F.col("refundable")) == "include"
    undefined = F.bool_or(amount.isNull() | currency.isNull())
    out = fees.groupBy(BY).agg(
        known_sum(amount, currency).alias("total"),
        known_sum(amount, currency, guaranteed(F.col("mandatory"), F.col("conditional")) & include).alias("mandatory"),
        known_sum(amount, currency, F.col("frequency") == "one_time").alias("upfront"),
        known_sum(amount, currency, F.col("frequency").isin(*RECURRING)).alias("recurring"),
        known_sum(amount, currency, F.col("conditional")).alias("conditional"),
        undefined.alias("has_undefined"),
    )
    return out.withColumn("status", F.when(F.col("total.status") != "known", "unavailable").when(F.col("has_undefined"), "estimated").otherwise("known"))


def penalty_collection(penalties: DataFrame) -> DataFrame:
    amount, currency = F.col("amount"), F.col("currency")
    out = penalties.groupBy(BY).agg(known_sum(amount, currency).alias("total"), known_max(amount, currency).alias("highest"), F.bool_or(amount.isNull() | currency.isNull()).alias("has_undefined"))
    return out.withColumn("status", F.when(F.col("total.status") != "known", "unavailable").when(F.col("has_undefined"), "estimated").otherwise("known"))


def totals_by_currency(amounts: DataFrame) -> DataFrame:
    known = amounts.filter(F.col("amount").isNotNull() & F.col("currency").isNotNull())
    return known.groupBy(BY, "currency").agg(F.round(F.sum(F.col("amount").cast(_MONEY)), 2).cast("double").alias("total"))


def scheduled_total(monthly: Column, months: Column) -> Column:
    """Monthly equivalent times months; days and years are never turned into months."""
    return money(monthly["value"] * months, monthly["currency"])


def total_cost(contracts: DataFrame) -> DataFrame:
    """Cost figures of each row from money structs ``principal``, ``upfront_obligations``, ``balloon``,
    ``mandatory_fees``, ``monthly_equivalent``, ``stated_total`` and ``months``."""
    none = money(F.lit(None), F.lit(None))
    out = contracts.withColumn("scheduled", scheduled_total(F.col("monthly_equivalent"), F.col("months")))
    out = out.withColumn("repayment", sum_of(F.col("scheduled"), F.col("balloon")))
    out = out.withColumn("core", sum_of(F.col("upfront_obligations"), F.col("repayment"), F.col("mandatory_fees")))
    out = out.withColumn("financing_repayment", F.when(F.col("principal.status") == "known", F.col("repayment")).otherwise(none))
    r, p, s, c = (F.col(x) for x in ("financing_repayment", "principal", "stated_total", "core"))
    fits = (r["currency"] == p["currency"]) & (p["value"] != 0) & (r["value"] >= p["value"])
    out = out.withColumn("financing_cost", F.when(_is(fits), money(r["value"] - p["value"], p["currency"])).otherwise(none))
    same = _is(s["currency"] == c["currency"])
    return out.withColumn("difference", F.when(same, difference_class(s["value"], c["value"])).otherwise("unavailable"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Percent of two money structs; null unless both are known, in one currency, over something not 0."""
    same = _is(numerator["currency"] == denominator["currency"]) & _is(denominator["value"] != 0)
    return F.when(same, F.round((F.try_divide(numerator["value"], denominator["value"]) * 100).cast(_MONEY), 2).cast("double"))


def backfill_currency(candidates: DataFrame) -> DataFrame:
    """Candidates with the contract's currency where they state none, if the contract states exactly one."""
    w = Window.partitionBy(BY)
    only = F.when(F.min("currency").over(w) == F.max("currency").over(w), F.max("currency").over(w))
    return candidates.withColumn("_only", only).withColumn("currency", F.coalesce("currency", F.when(F.col("amount").isNotNull(), F.col("_only")))).drop("_only")


def currency_distribution(candidates: DataFrame) -> DataFrame:
    """'SAR: 3, USD: 1' per contract with several currencies, the most frequent first."""
    counts = candidates.filter("currency is not null").groupBy(BY, "currency").agg(F.count("*").alias("n"))
    listed = counts.groupBy(BY).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "currency", "n"))).alias("c")).filter(F.size("c") > 1)
    return listed.select(BY, F.array_join(F.transform("c", lambda x: F.concat(x["currency"], F.lit(": "), x["n"].cast("string"))), ", ").alias("distribution"))


def priority(chars: Column) -> list[Column]:
    """The order of rival candidates: source, confidence, length of evidence (``chars``), field, position."""
    rank = lambda c, table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c))
    return [F.desc_nulls_last(rank("source_kind", SOURCE_RANK)), F.desc_nulls_last(rank("confidence", CONFIDENCE_RANK)), F.desc(chars), F.collate("source_field", "UNICODE"), F.col("ordinal")]


def _keyed(candidates: DataFrame) -> DataFrame:
    """With ``_label_key``, the normalised label, unless they have it."""
    return candidates if "_label_key" in candidates.columns else candidates.withColumn("_label_key", label_key(F.col("label")))


def conflict_slot() -> Column:
    """What a candidate (with ``_label_key``) is the value of; stated totals and salary components may stand side by side."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    special = F.concat_ws("|", F.lit("special"), part("special_key"), F.when(F.col("special_key").isin(*REPEATED), F.col("_label_key")))
    plain = F.concat_ws("|", part("target_kind"), part("category"), part("currency"), part("frequency"), F.col("_label_key"))
    return F.when(F.col("target_kind") == "special", special).otherwise(plain)


def ranked_rivals(candidates: DataFrame) -> DataFrame:
    """Candidates with their ``place`` among those of their slot (1 wins), ``rivals`` (how many others there
    are), ``conflict`` (whether amounts differ), ``position`` (where the slot first came up) and
    ``winner_field``, the source of the winner."""
    slot = Window.partitionBy(BY, "_slot")
    rows = _keyed(candidates).withColumn("_slot", conflict_slot())
    rows = rows if "_label_key" in candidates.columns else rows.drop("_label_key")
    # a null amount is a value of its own here
    lo, hi = F.min("amount").over(slot), F.max("amount").over(slot)
    filled = F.count("amount").over(slot)
    n = F.count("*").over(slot)
    differ = _is(lo != hi) | ((filled > 0) & (filled < n))
    ranked = slot.orderBy(*priority(F.col("_chars") if "_chars" in candidates.columns else F.coalesce(F.length("evidence"), F.lit(0))))
    return rows.withColumns({"position": F.min("ordinal").over(slot), "rivals": n - 1, "conflict": differ, "place": F.row_number().over(ranked), "winner_field": F.first("source_field").over(ranked)}).drop("_slot")


def resolve_conflicts(candidates: DataFrame) -> DataFrame:
    """The winner of each slot, with ``rivals``, ``conflict`` and ``position`` as ``ranked_rivals`` has them."""
    return ranked_rivals(candidates).filter("place = 1").drop("place", "winner_field")


def deduplicate(candidates: DataFrame) -> DataFrame:
    """One candidate of each cluster of restatements, with ``merged`` (how many it stands for).

    Candidates that agree in kind, category, frequency, currency and amount are compared, in the order
    of ``ordinal`` (a row's own within its contract), with the first member of each cluster so far:
    stated flags and dates must not contradict, and two of unnamed category need a word of their labels
    in common. Compatibility with unstated values isn't transitive, so this is a fold. It runs over
    variants: equal flags, date and normalised label always end in one cluster, so they are counted and ranked by
    a partial aggregation first, and a fold is as long as a contract has different statements of an
    amount. An unnamed category without any word merges with nothing and stays out of the fold.
    """
    return candidates.join(kept(candidates), [BY, "ordinal"])


def kept(candidates: DataFrame) -> DataFrame:
    """contract, ordinal and ``merged`` of the candidates that ``deduplicate`` keeps."""
    rank = lambda c, table: -F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c)), F.lit(0))
    score = F.struct(rank("source_kind", SOURCE_RANK).alias("s"), rank("confidence", CONFIDENCE_RANK).alias("c"), (-F.coalesce(F.length("evidence"), F.lit(0))).alias("e"), F.collate("source_field", "UNICODE").alias("f"), F.col("ordinal"))
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("target_kind", "special_key", "category", "frequency", "currency")], F.coalesce(F.format_string("%.2f", F.col("amount")), F.lit("null")))
    vague = F.col("category").isNull() | F.col("category").isin("unknown", "other")
    stated = ("mandatory", "conditional", "start_date", "_label_key")
    rows = _keyed(candidates).select(BY, "ordinal", key.alias("_key"), *stated, vague.alias("vague"), score.alias("best"))
    single = F.col("vague") & (F.col("_label_key") == "")
    variants = rows.filter(~single).groupBy(BY, "_key", "vague", *stated).agg(F.min("ordinal").alias("first"), F.min("best").alias("best"), F.count("*").alias("n"))
    member = F.struct("first", "best", "n", *stated)
    groups = variants.groupBy(BY, "_key", "vague").agg(F.array_sort(F.collect_list(member)).alias("_m"))
    agree = lambda a, b: a.isNull() | b.isNull() | (a == b)

    def merges(head: Column, m: Column) -> Column:
        unlike = F.col("vague") & (label_similarity(head["_label_key"], m["_label_key"]) <= 0)
        return agree(head["mandatory"], m["mandatory"]) & agree(head["conditional"], m["conditional"]) & agree(head["start_date"], m["start_date"]) & ~unlike

    def step(clusters: Column, m: Column) -> Column:
        at = F.array_position(F.transform(clusters, lambda c: merges(c["head"], m)), True)
        grown = F.transform(clusters, lambda c, i: F.struct(c["head"].alias("head"), F.when(i + 1 == at, F.least(c["best"], m["best"])).otherwise(c["best"]).alias("best"), F.when(i + 1 == at, c["n"] + m["n"]).otherwise(c["n"]).alias("n")))
        fresh = F.array(F.struct(m.alias("head"), m["best"].alias("best"), m["n"].alias("n")))
        return F.when(at > 0, grown).otherwise(F.concat(clusters, fresh))

    first = F.transform(F.slice("_m", 1, 1), lambda m: F.struct(m.alias("head"), m["best"].alias("best"), m["n"].alias("n")))
    clusters = F.when(F.size("_m") == 1, first).otherwise(F.aggregate(F.slice("_m", F.lit(2), F.size("_m")), first, step))
    best = groups.select(BY, F.explode(clusters).alias("c")).select(BY, F.col("c.best.ordinal").alias("ordinal"), F.col("c.n").alias("merged"))
    return best.union(rows.filter(single).select(BY, "ordinal", F.lit(1).cast("long")))


def budget_impact(rows: DataFrame) -> DataFrame:
    """Monthly room, burden and reserves before and after a contract; unknown figures stay null."""
    c = F.col
    debt, spend, income, new = c("existing_debt"), c("essential_expenses"), c("monthly_income"), c("monthly_commitment")
    before = spend + debt
    out = rows.withColumns({"available_before": income - spend - debt, "available_after": income - spend - debt - new, "outflow_after": before + new})
    share = lambda x: F.when(income > 0, x / income * 100)
    out = out.withColumns({"contract_ratio": share(new), "total_commitment_ratio": share(debt + new), "outflow_ratio": share(c("outflow_after")), "remaining_savings": c("savings") - c("upfront_costs")})
    return out.withColumn("coverage_months", F.when(c("outflow_after") > 0, F.round(c("remaining_savings") / c("outflow_after"), 1)))


def employment_budget_impact(rows: DataFrame, mode: str) -> DataFrame:
    """The same for a job: ``mode`` 'replace_current_income' or 'add_to_current_income'."""
    if mode not in ("replace_current_income", "add_to_current_income"):
        raise ValueError(mode)
    c = F.col
    now, offer, costs = c("monthly_income"), c("guaranteed_income"), c("essential_expenses") + c("existing_debt")
    after, change = (offer, offer - now) if mode == "replace_current_income" else (now + offer, offer)
    outflow = costs + c("deductions")
    return rows.withColumns({
        "income_after": after,
        "income_change": change,
        "remaining_before": now - costs,
        "remaining_after": after - outflow,
        "income_change_percent": F.when(now > 0, change / now * 100),
        "savings_after": c("savings") - F.coalesce(c("upfront_payment"), F.lit(0)),
        "coverage_months": F.when(outflow > 0, F.round(c("savings") / outflow, 1)),
    })
