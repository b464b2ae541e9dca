"""Financial concepts: what each amount of an agreement is to its reader.

Items are rows (contract_id, contract_type, ordinal, source, label, amount, currency, percentage, frequency,
n_payments, mandatory, conditional, refundable, financial_role, trigger, kind), where ``source`` is
obligation, fee, penalty or informational and ``kind`` the type within it. Everything is column
expressions, one window by concept and amount, and aggregates by contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions import money as M
from tallystone.functions import wordlists as L

ITEM_COLUMNS = ("contract_id", "contract_type", "ordinal", "source", "label", "amount", "currency", "percentage", "frequency", "n_payments", "mandatory", "conditional", "refundable", "financial_role", "trigger", "kind")
#: A stated sum and a computed one that differ by less are the same.
CENT = 0.01


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.greatest(*[F.lower(text).contains(w.lower()) for w in (*words, words[0])]), F.lit(False))


def informational_amounts(candidates: DataFrame) -> DataFrame:
    """Amounts that are stated but not due, of resolved candidates: those with a special key, and asset
    values; ``info_type`` names them, and ``id`` numbers them by source field within the contract."""
    rows = candidates.filter("special_key IS NOT NULL OR role = 'asset_value'")
    order = Window.partitionBy("contract_id").orderBy(F.collate("source_field", "UNICODE"), "ordinal")
    info = F.coalesce(_lookup(L.INFORMATIONAL_TYPES, F.col("special_key")), F.lit("asset_value"))
    return rows.withColumn("info_type", info).withColumn("id", F.concat(F.lit("informational-"), (F.row_number().over(order) - 1).cast("string")))


def financial_items(obligations: DataFrame, fees: DataFrame, penalties: DataFrame, informational: DataFrame) -> DataFrame:
    """The four kinds of items under one set of columns, in that order; a kind has null for what it has not.

    Each frame has contract_id, contract_type, ordinal, label, amount, currency, percentage, financial_role
    and ``kind``, and may have the rest; ``ordinal`` counts within its kind.
    """
    given = {
        "obligation": ("frequency", "n_payments", "mandatory", "conditional", "refundable"),
        "fee": ("percentage", "frequency", "mandatory", "conditional", "refundable"),
        "penalty": ("percentage", "conditional", "trigger"),
        "informational": ("percentage",),
    }
    always = ("contract_id", "contract_type", "ordinal", "label", "amount", "currency", "financial_role", "kind")
    kinds = {"percentage": "double", "frequency": "string", "n_payments": "double", "mandatory": "boolean", "conditional": "boolean", "refundable": "boolean", "trigger": "string"}
    out = None
    for place, (source, rows) in enumerate(zip(given, (obligations, fees, penalties, informational), strict=True)):
        columns = [F.lit(source).alias(c) if c == "source" else (F.col(c) if c in always or c in given[source] else F.lit(None)).cast(kinds[c] if c in kinds else rows.schema[c].dataType).alias(c) for c in ITEM_COLUMNS]
        one = rows.select(*columns, F.lit(place).alias("place"))
        out = one if out is None else out.unionByName(one)
    return out


def canonical_concept(kind: Column, source: Column, label: Column, frequency: Column, role: Column, contract_type: Column) -> Column:
    """The concept of an item: by its type, else by words of its label, else by its role."""
    by_type = F.coalesce(*[F.when(source == s, _lookup(table, kind)) for s, table in L.TYPE_CONCEPTS.items()])
    rent = F.when(frequency == "annual", "annual_rent").otherwise("monthly_rent")
    by_label = F.coalesce(*[F.when(_any_of(label, words), rent if concept == "monthly_rent" else F.lit(concept)) for concept, words in L.LABEL_CONCEPTS.items()])
    recurring = F.when(contract_type == "lease", rent).otherwise(F.coalesce(_lookup(L.RECURRING_CONCEPTS, contract_type), F.lit("recurring_payment")))
    by_role = (
        F.when(((source == "penalty") & ~role.eqNullSafe("conditional_income")) | (role == "conditional_cost"), "conditional_payment")
        .when(role == "recurring_outflow", recurring)
        .otherwise(_lookup(L.ROLE_CONCEPTS, role))
    )
    return F.coalesce(by_type, F.when(source != "informational", F.coalesce(by_label, by_role)), F.lit("other"))


def item_bucket(role: Column, mandatory: Column, conditional: Column) -> Column:
    return (
        F.when(role.isin(*L.INFORMATIONAL_ROLES), "informational")
        .when((role == "conditional_cost") | conditional.eqNullSafe(True), "conditional")
        .otherwise(F.when(mandatory.eqNullSafe(True), "guaranteed").otherwise("informational"))
    )


def stated_cap(label: Column, trigger: Column) -> Column:
    """Whether an amount is stated as the most that can fall due."""
    return _any_of(F.concat_ws(" ", label, F.coalesce(trigger, F.lit(""))), L.SAYS_STATED_CAP)


def financial_concepts(items: DataFrame, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """Items with an amount or a percentage, with ``concept``, ``bucket`` and ``is_cap``; of items of one
    concept, currency and amount the first by ``order``. Unnamed concepts and amounts of nothing or
    without a currency are never repeats."""
    shown = items.filter("amount IS NOT NULL OR percentage IS NOT NULL")
    concept = canonical_concept(*[F.col(c) for c in ("kind", "source", "label", "frequency", "financial_role", "contract_type")])
    rows = shown.withColumns({"concept": concept, "bucket": item_bucket(F.col("financial_role"), F.col("mandatory"), F.col("conditional")), "is_cap": stated_cap(F.col("label"), F.col("trigger"))})
    cents = F.round(F.col("amount") * 100).cast("long")
    keyed = (F.col("concept") != "other") & F.col("currency").isNotNull() & F.coalesce(F.col("amount") != 0, F.lit(False))
    first = F.row_number().over(Window.partitionBy("contract_id", "concept", "currency", "_cents", "_keyed").orderBy(*order))
    rows = rows.withColumns({"_cents": cents, "_keyed": keyed}).withColumn("_n", first)
    return rows.filter("_n = 1 OR NOT _keyed").drop("_n", "_cents", "_keyed")


def contract_group(concept: Column, bucket: Column, role: Column) -> Column:
    return (
        F.when(bucket == "conditional", "conditionalAmounts")
        .when(role.isin("financing_principal", "credit_limit", "coverage_limit"), "financingAndCredit")
        .when(role == "rate_or_percentage", "ratesAndPercentages")
        .when(concept.isin(*L.FEE_LIKE_CONCEPTS), "feesAndCosts")
        .otherwise(F.when(bucket == "guaranteed", "whatYoullPay").otherwise("otherStatedAmounts"))
    )


def employment_group(source: Column, kind: Column, bucket: Column, role: Column) -> Column:
    info = F.when(source == "informational", kind)
    return (
        F.when(info == "monthly_income", "whatYouWillReceive")
        .when(info.isin("salary_component", "total_fixed_compensation"), "compensationBreakdown")
        .when(role == "conditional_income", "conditionalOrNonGuaranteed")
        .when(role == "conditional_cost", "potentialDeductions")
        .when(role == "benefit", "otherBenefits")
        .when(bucket == "guaranteed", "compensationBreakdown")
        .when(bucket == "conditional", "conditionalOrNonGuaranteed")
        .otherwise("otherBenefits")
    )


def grouped(concepts: DataFrame) -> DataFrame:
    """Concepts with ``group``: by the groups of employment in employment contracts, else of the others."""
    job = employment_group(*[F.col(c) for c in ("source", "kind", "bucket", "financial_role")])
    return concepts.withColumn("group", F.when(F.col("contract_type") == "employment", job).otherwise(contract_group(*[F.col(c) for c in ("concept", "bucket", "financial_role")])))


def _one_currency(value: Column, where: Column) -> Column:
    """struct(total, currency) of known amounts; null over none or several currencies."""
    known = where & F.col("amount").isNotNull() & F.col("currency").isNotNull()
    low, high = F.min(F.when(known, F.col("currency"))), F.max(F.when(known, F.col("currency")))
    return F.when(low == high, F.struct(F.sum(F.when(known, value).cast("decimal(38,6)")).cast("double").alias("total"), low.alias("currency")))


def applicable_amounts(concepts: DataFrame, order: str = "ordinal") -> DataFrame:
    """Per contract, struct(total, currency): the guaranteed monthly outflow; the upfront liquidity; the
    guaranteed income. Null where unknown, nothing or over several currencies.

    Upfront liquidity is the guaranteed upfront and refundable amounts. Where the contract states what is
    due at signing, and those with the guaranteed one-time outflows (and in a lease the first rent) come
    to just that sum, it is that sum.
    """
    role, sure = F.col("financial_role"), F.col("bucket") == "guaranteed"
    known = F.col("amount").isNotNull() & F.col("currency").isNotNull()
    first = lambda value, where: F.min_by(value, F.when(where & known, F.col(order)))
    upfront = sure & role.isin("upfront_liquidity", "refundable")
    info = F.when(F.col("source") == "informational", F.col("kind"))
    rent = (F.col("contract_type") == "lease") & sure & (role == "recurring_outflow") & (F.col("concept") == "monthly_rent")
    rents = Window.partitionBy("contract_id").orderBy(F.when(rent & known, F.col(order)).asc_nulls_last())
    rows = concepts.withColumn("_rent", rent & known & (F.row_number().over(rents) == 1))
    monthly = sure & (role == "recurring_outflow")
    per = rows.groupBy("contract_id").agg(
        _one_currency(F.coalesce(F.col("amount") * M.monthly_factor(F.col("frequency")), F.lit(0.0)), monthly).alias("monthly"),
        _one_currency(F.col("amount"), upfront).alias("narrow"),
        _one_currency(F.col("amount"), upfront | (sure & (role == "one_time_outflow")) | F.col("_rent")).alias("wide"),
        first(F.struct("amount", "currency"), info == "stated_due_at_signing").alias("stated"),
        first(F.struct(F.col("amount").alias("total"), "currency"), info == "monthly_income").alias("income"),
    )
    positive = lambda x: F.when(F.col(f"{x}.total") > 0, F.col(x))
    agrees = (F.col("wide.currency") == F.col("stated.currency")) & (F.abs(F.col("wide.total") - F.col("stated.amount")) < CENT)
    return per.select("contract_id", positive("monthly").alias("monthly_outflow"), F.when(agrees, F.col("wide")).otherwise(positive("narrow")).alias("upfront_liquidity"), F.col("income").alias("employment_income"))


def duration_facts(durations: DataFrame, concepts: DataFrame) -> DataFrame:
    """contract_id, fact, value, unit, concept: the contract's duration in its best unit (``durations``:
    contract_id, months, years, days), and the number of payments of each guaranteed item."""
    unit = F.when(F.col("months").isNotNull(), "months").when(F.col("years").isNotNull(), "years").when(F.col("days").isNotNull(), "days")
    value = F.coalesce(F.col("months").cast("double"), F.col("years").cast("double"), F.col("days").cast("double"))
    terms = durations.select("contract_id", F.lit("contractDuration").alias("fact"), value.alias("value"), unit.alias("unit"), F.lit(None).cast("string").alias("concept")).filter("unit IS NOT NULL")
    counts = concepts.filter("bucket = 'guaranteed' AND n_payments > 0").select("contract_id", F.lit("installmentCount").alias("fact"), F.col("n_payments").cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), "concept")
    return terms.unionByName(counts)


def key_figures(concepts: DataFrame, durations: DataFrame, limit: int = 5, order: str = "ordinal") -> DataFrame:
    """contract_id, key, place, amount, currency, percentage, unit: the first ``limit`` of the headline
    figures that the contract has, in their fixed order; of items of one concept the first counts, and only
    with a rate for the interest rate and an amount for the others."""
    ranks = F.create_map(*[F.lit(x) for i, key in enumerate(L.KEY_FIGURES) for x in (key, i)])
    none = lambda kind: F.lit(None).cast(kind)
    items = concepts.select("contract_id", F.col("concept").alias("key"), F.col(order).alias("_o"), "amount", "currency", "percentage", none("string").alias("unit"))
    terms = duration_facts(durations, concepts).filter("fact = 'contractDuration'").select("contract_id", F.lit("duration").alias("key"), F.lit(0).cast("long").alias("_o"), F.col("value").alias("amount"), none("string").alias("currency"), none("double").alias("percentage"), "unit")
    rows = items.withColumn("_o", F.col("_o").cast("long")).unionByName(terms).withColumn("_r", F.try_element_at(ranks, F.col("key")))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("contract_id", "key").orderBy("_o"))).filter("_n = 1")
    first = first.filter(F.when(F.col("key") == "interest_rate", F.col("percentage").isNotNull()).otherwise(F.col("amount").isNotNull()))
    # other concepts come last and go here: a filter on the rank alone would be evaluated at the source too
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("contract_id").orderBy(F.col("_r").asc_nulls_last())))
    return placed.filter((F.col("place") <= limit) & F.col("_r").isNotNull()).drop("_o", "_r", "_n")


def executive_findings(clauses: DataFrame, concepts: DataFrame, missing: DataFrame, most: tuple[int, int, int] = (3, 2, 1), total: int = 5) -> DataFrame:
    """contract_id, place, kind, title, detail: risky clauses (high before medium), the largest conditional
    amounts, and what is missing, at most so many of each and of all.

    ``clauses``: contract_id, ordinal, title, summary, explanation, risk; ``missing``: contract_id,
    ordinal, reason. What has no title or no text is left out after the cut, as is a blank reason before it.
    """
    shown = lambda c: F.nullif(F.trim(c), F.lit(""))
    best = lambda df, n, *order: df.withColumn("_n", F.row_number().over(Window.partitionBy("contract_id").orderBy(*order))).filter(F.col("_n") <= n)
    risky = best(clauses.filter(F.col("risk").isin("high", "medium")), most[0], F.when(F.col("risk") == "high", 0).otherwise(1), "ordinal")
    risky = risky.select("contract_id", F.lit(0).alias("_k"), "_n", F.lit("risk_clause").alias("kind"), shown(F.col("title")).alias("title"), F.coalesce(shown(F.col("explanation")), shown(F.col("summary"))).alias("detail"))
    size = F.coalesce("amount", "percentage")
    costs = best(concepts.filter((F.col("bucket") == "conditional") & size.isNotNull()), most[1], size.desc(), "ordinal")
    said = F.coalesce(F.when(F.col("amount").isNotNull(), F.concat_ws(" ", plain_number(F.col("amount")), F.col("currency"))), F.concat(plain_number(F.col("percentage")), F.lit("%")))
    detail = F.concat_ws(" — ", F.when(F.col("is_cap"), F.concat(F.lit("up to "), said)).otherwise(said), shown(F.col("trigger")))
    costs = costs.select("contract_id", F.lit(1).alias("_k"), "_n", F.lit("conditional_cost").alias("kind"), F.when(F.col("concept") == "other", shown(F.col("label"))).otherwise(F.col("concept")).alias("title"), detail.alias("detail"))
    gaps = best(missing.withColumn("reason", shown(F.col("reason"))).filter("reason IS NOT NULL"), most[2], "ordinal").select("contract_id", F.lit(2).alias("_k"), "_n", F.lit("missing_information").alias("kind"), F.lit("Incomplete information").alias("title"), F.col("reason").alias("detail"))
    rows = risky.unionByName(costs).unionByName(gaps).filter("title IS NOT NULL AND detail IS NOT NULL")
    return best(rows.withColumnRenamed("_n", "_m"), total, "_k", "_m").withColumn("place", F.col("_n")).drop("_k", "_m", "_n")


def plain_number(value: Column) -> Column:
    """Thousands in groups, up to two decimals, none that are zero."""
    return F.regexp_replace(F.format_number(value, 2), r"\.?0+$", "")


def unresolved_contingent(fees: DataFrame, penalties: DataFrame) -> DataFrame:
    """contract_id, unquantified: whether a conditional fee or a penalty has no full amount; contracts
    with neither are left out (``fees``: contract_id, amount, currency, conditional)."""
    open_ = (F.col("amount").isNull() | F.col("currency").isNull()).alias("open")
    rows = fees.filter("conditional").select("contract_id", open_).unionByName(penalties.select("contract_id", open_))
    return rows.groupBy("contract_id").agg(F.bool_or("open").alias("unquantified"))
