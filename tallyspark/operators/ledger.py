"""The sales ledger: classification of raw transactions, facts, dimensions, quality figures and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import AMOUNT, CANCELLATION, EXCLUDED_DUPLICATE, PURCHASE, QUARANTINED


def _text(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _number(c: str) -> Column:
    return F.col(c).try_cast("decimal(18,6)")


def is_cancellation() -> Column:
    return F.upper("invoice_no").startswith("C")


def is_fact() -> Column:
    return F.col("disposition").isin(PURCHASE, CANCELLATION)


def classify(raw: DataFrame, dealt_by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Typed rows with disposition, reason, duplicate_of, eligibility and month (``schema.LEDGER`` in).

    The first row of equal content stands for all; of the rest the first rule that is broken is the reason.
    ``dealt_by`` names columns that rows of equal content share; rows that are dealt out by them already stay where they are.
    ``parts`` says into how many tasks rows are dealt; without it, into as many as the session's shuffles have.
    """
    typed = raw.select(
        *dealt_by, "source_row_id", F.col("source_row").cast("long").alias("source_row"), "content_hash", *[_text(c).alias(c) for c in ("invoice_no", "stock_code", "description", "customer_id", "country")],
        _number("quantity").alias("exact_quantity"), F.col("quantity").try_cast("long").alias("quantity"), F.col("invoice_time").try_cast("timestamp_ntz").alias("at"), _number("unit_price").alias("unit_price"),
    )
    if parts is not None:
        typed = typed.repartition(parts, *(dealt_by or ("content_hash",)))
    # one pass in order of content, over typed columns: rows are dealt out once, and no more of them than a query needs
    in_turn = Window.partitionBy(*dealt_by, "content_hash").orderBy(F.asc_nulls_last("source_row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    typed = typed.withColumn("first_row_id", F.when(F.first("source_row").over(in_turn).isNotNull(), F.first("source_row_id").over(in_turn)))
    typed = typed.withColumn("signed_amount", (F.col("exact_quantity") * F.col("unit_price")).cast(AMOUNT))
    quantity, cancels = F.col("quantity"), is_cancellation()
    rules = (
        (F.col("invoice_no").isNull() | F.col("stock_code").isNull(), "MISSING_TRANSACTION_KEY"),
        (F.col("at").isNull(), "INVALID_TIME"),
        (quantity.isNull() | (F.col("exact_quantity") != quantity) | (quantity == 0), "INVALID_QUANTITY"),
        (F.col("unit_price").isNull() | (F.col("unit_price") <= 0), "NONPOSITIVE_OR_INVALID_PRICE"),
        (cancels & (quantity > 0), "CANCELLATION_SIGN_CONFLICT"),
        (~cancels & (quantity < 0), "NEGATIVE_WITHOUT_CANCELLATION"),
    )
    broken = F.coalesce(*[F.when(rule, F.lit(name)) for rule, name in rules])
    again = F.col("first_row_id").isNotNull() & (F.col("source_row_id") != F.col("first_row_id"))
    out = typed.withColumn("broken", broken)
    return out.select(
        "source_row_id", "source_row", "content_hash", "invoice_no", "stock_code", "description", "quantity", F.col("at").cast("string").alias("invoice_time"), F.col("at").cast("date").alias("invoice_date"),
        "unit_price", "customer_id", "country", "signed_amount", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("INVALID")).alias("transaction_month"),
        F.when(again, EXCLUDED_DUPLICATE).when(F.col("broken").isNotNull(), QUARANTINED).when(cancels, CANCELLATION).otherwise(PURCHASE).alias("disposition"),
        F.when(again, F.lit("SUSPECTED_EXACT_DUPLICATE")).otherwise(F.col("broken")).alias("reason"), F.when(again, F.col("first_row_id")).alias("duplicate_of"),
        (F.col("customer_id").isNotNull() & F.col("broken").isNull() & ~again).alias("customer_eligible"), F.when(cancels, "UNMATCHED").otherwise("NOT_APPLICABLE").alias("cancellation_link"),
    )


def facts(audit: DataFrame) -> DataFrame:
    return audit.where(is_fact())


def customers(ledger_facts: DataFrame, *more: Column) -> DataFrame:
    """customer_id with the country of its latest row (later source row first); ``more`` are aggregates to keep beside it."""
    known = ledger_facts.where(F.col("customer_id").isNotNull())
    return known.groupBy("customer_id").agg(F.max_by("country", F.struct("invoice_time", "source_row")).alias("country"), *more)


def products(ledger_facts: DataFrame, *more: Column) -> DataFrame:
    """stock_code with its latest description; a row without one is looked at last; ``more`` are aggregates to keep beside it."""
    order = F.struct(F.col("description").isNotNull(), "invoice_time", "source_row")
    return ledger_facts.groupBy("stock_code").agg(F.max_by("description", order).alias("description"), *more)


def row_marks(*columns: str) -> Column:
    """A sum over rows that depends on what the columns hold and not on the rows' order."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def _raw_amount() -> Column:
    return F.sum((_number("quantity") * _number("unit_price")).cast(AMOUNT)).cast("decimal(38,6)").alias("amount")


def source_totals(raw: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows, distinct ids and amount.  ``parts`` says into how many tasks ids are dealt; without it, as many as the session's shuffles have."""
    if parts is None:
        return raw.agg(F.count("*").alias("row_count"), F.count_distinct("source_row_id").alias("distinct_rows"), _raw_amount())
    # an id is in one task, so tasks count theirs; ids hardly repeat, so they aren't gathered before
    by_id = raw.select("source_row_id", "quantity", "unit_price").repartition(parts, "source_row_id").groupBy("source_row_id").agg(F.count("*").alias("copies"), _raw_amount())
    return by_id.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"), F.count("source_row_id").alias("distinct_rows"), F.sum("amount").cast("decimal(38,6)").alias("amount"))


def source_marks(raw: DataFrame) -> DataFrame:
    """Rows, amount and marks of ids and contents: one pass without a shuffle."""
    return raw.agg(F.count("*").alias("row_count"), _raw_amount(), row_marks("source_row_id").alias("ids"), row_marks("source_row_id", "content_hash").alias("contents"))


def audit_totals(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("row_count"), F.count_distinct("source_row_id").alias("distinct_rows"), F.sum("signed_amount").cast("decimal(38,6)").alias("amount"))


def input_profile(audit: DataFrame, product_dim: DataFrame | None = None, customer_dim: DataFrame | None = None) -> DataFrame:
    """One row of figures.  Each name is counted by a narrow branch of its own, so ``audit`` should be a written table.

    Names that a dimension of the audit's facts holds aren't looked up in the facts again.
    """
    figures = audit.agg(
        F.min("invoice_time").alias("first_time"), F.max("invoice_time").alias("last_time"), F.count_if(F.col("customer_id").isNull()).alias("missing_customers"), F.count_if(F.col("description").isNull()).alias("missing_descriptions"),
        F.count_if(is_cancellation()).alias("cancellation_lines"), F.count_if(F.col("quantity") < 0).alias("negative_lines"), F.count_if(F.col("unit_price") <= 0).alias("unpriced_lines"),
    )
    for column, name, dim in (("invoice_no", "invoices", None), ("customer_id", "customers", customer_dim), ("stock_code", "products", product_dim)):
        names = audit.select(column) if dim is None else audit.where(~is_fact()).select(column).unionByName(dim.select(column))
        figures = figures.crossJoin(F.broadcast(names.agg(F.count_distinct(column).alias(name))))  # one row each
    return figures


def summary(audit: DataFrame, disposition: str) -> DataFrame:
    """Lines, invoices and amount of one disposition; zero without rows."""
    zero = F.lit(0).cast("decimal(38,6)")
    return audit.where(F.col("disposition") == disposition).agg(F.count("*").alias("line_count"), F.count_distinct("invoice_no").alias("invoices"), F.coalesce(F.sum("signed_amount").cast("decimal(38,6)"), zero).alias("amount"))


def dispositions(audit: DataFrame) -> DataFrame:
    return audit.groupBy("disposition", "reason").agg(
        F.count("*").alias("row_count"), F.sum("signed_amount").cast("decimal(38,6)").alias("amount"), F.count_if(F.col("signed_amount").isNull()).alias("without_amount"), F.count_if(F.col("customer_id").isNull()).alias("without_customer"),
    ).orderBy("disposition", "reason")


def dimension_matches(ledger_facts: DataFrame, product_dim: DataFrame, customer_dim: DataFrame) -> DataFrame:
    """How many facts find their product and customer; a null customer never matches."""
    p = product_dim.select("stock_code", F.col("stock_code").alias("product_key"))
    c = customer_dim.select("customer_id", F.col("customer_id").alias("customer_key"))
    joined = ledger_facts.select("stock_code", "customer_id").join(p, "stock_code", "left").join(c, "customer_id", "left")
    return joined.agg(F.count("*").alias("fact_rows"), F.count("product_key").alias("product_matches"), F.count("customer_key").alias("customer_matches"))


def key_matches(by_product: DataFrame, by_customer: DataFrame, product_dim: DataFrame, customer_dim: DataFrame) -> DataFrame:
    """What ``dimension_matches`` says, from the facts' keys with their numbers of ``lines``: a row for each key is joined, not one for each fact."""
    p = product_dim.select("stock_code", F.col("stock_code").alias("product_key"))
    c = customer_dim.select("customer_id", F.col("customer_id").alias("customer_key"))
    lines = lambda key: F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("lines"))), F.lit(0))
    found = by_product.join(p, "stock_code", "left").agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("fact_rows"), lines("product_key").alias("product_matches"))
    known = by_customer.join(c, "customer_id", "left").agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("customer_rows"), lines("customer_key").alias("customer_matches"))
    return found.crossJoin(F.broadcast(known))  # one row each


def dimension_sizes(product_dim: DataFrame, customer_dim: DataFrame) -> DataFrame:
    one = customer_dim.agg(F.count("*").alias("customers"))
    return product_dim.agg(F.count("*").alias("products")).crossJoin(F.broadcast(one))


def month_amount(ledger_facts: DataFrame, month: str) -> DataFrame:
    """The amount of one month; over a table partitioned by month only that partition is read."""
    return ledger_facts.where(F.col("transaction_month") == month).agg(F.sum("signed_amount").cast("decimal(38,6)").alias("amount"))


class ReconciliationError(RuntimeError):
    """Totals of two steps differ."""


def reconcile(
    raw: DataFrame, audit: DataFrame, ledger_facts: DataFrame, product_dim: DataFrame, customer_dim: DataFrame, expected_rows: int | None = None, seen: Row | None = None,
    keys: tuple[DataFrame, DataFrame] | None = None, parts: int | None = None,
) -> dict:
    """Check that no row and no amount was lost between the steps; the figures, or ReconciliationError.

    ``seen`` is the row of ``source_marks``, if it was made before; ``keys`` are the facts' products and customers with their
    numbers of ``lines``, if they were counted before.  ``parts`` says into how many tasks ids are dealt.
    """
    source, amount = seen or source_marks(raw).first(), F.sum("signed_amount").cast("decimal(38,6)").alias("amount")
    retained = [F.count_if(is_fact()).alias("retained"), F.sum(F.when(is_fact(), F.col("signed_amount"))).cast("decimal(38,6)").alias("retained_amount"), F.sum(F.when(is_fact(), F.xxhash64("source_row_id")).cast("decimal(38,0)")).alias("retained_ids")]
    kept = audit.agg(F.count("*").alias("row_count"), amount, row_marks("source_row_id").alias("ids"), *retained).first()
    ids = audit.select("source_row_id")
    distinct = (ids if parts is None else ids.repartition(parts, "source_row_id")).agg(F.count_distinct("source_row_id")).first()[0]  # both sides have the same ids, so they are counted on one
    if any(source[c] != kept[c] for c in ("row_count", "amount", "ids")) or kept["row_count"] != distinct:
        raise ReconciliationError(f"source {tuple(source)} and audit {tuple(kept)} differ")
    if expected_rows is not None and source["row_count"] != expected_rows:
        raise ReconciliationError(f"{source['row_count']} rows, the manifest says {expected_rows}")
    stored = ledger_facts.agg(F.count("*"), amount, row_marks("source_row_id")).first()
    if tuple(stored) != (kept["retained"], kept["retained_amount"], kept["retained_ids"]):
        raise ReconciliationError(f"the audit retains {tuple(kept)[3:]}, the facts are {tuple(stored)}")
    match = (key_matches(*keys, product_dim, customer_dim) if keys else dimension_matches(ledger_facts, product_dim, customer_dim)).first()
    if keys and match["customer_rows"] != (known := keys[1].agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]):
        raise ReconciliationError(f"{known} facts have a customer, {match['customer_rows']} are joined to one")
    if not kept["retained"] == match["fact_rows"] == match["product_matches"]:
        raise ReconciliationError(f"{kept['retained']} retained lines, {match['fact_rows']} facts, {match['product_matches']} with a product")
    return {"rows": source["row_count"], "amount": str(source["amount"]), "facts": match["fact_rows"], "customer_matches": match["customer_matches"]}
