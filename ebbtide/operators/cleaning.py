"""Parsing, row rules and identities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.scalars import clip
from ebbtide.operators.ordering import settle

MONEY = "decimal(18,4)"

# The accepted date texts. A clock time has 1-2 digit parts after
# a plain date and two-digit parts in ISO-8601, where an offset may follow.
CLOCK = r"([01]?\d|2[0-3]):[0-5]?\d"
ISO_CLOCK = r"([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?"
DASHED = rf"^\d{{4}}-(\d{{1,2}}-\d{{1,2}}( {CLOCK}:[0-5]?\d)?|\d{{2}}-\d{{2}}[T ]{ISO_CLOCK})$"
SLASHED = rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}( {CLOCK})?$"
COMPACT = r"^\d{8}$"


def parse_date(text: Column, month_first: bool = False) -> Column:
    """The date, or NULL when no accepted format fits.

    ISO forms come first. Slashed dates are read day first, or month first
    when asked, and the other way round when that is no date. A pattern finds
    the form and the parts are put in ISO order for a cast, so no parser
    fails by exception and the expression stays small enough to be compiled.
    """
    c = F.trim(text)

    def reordered(pattern: str, order: str) -> Column:
        return F.regexp_replace(c, pattern, order).try_cast("date")

    slashed, compact = r"^(\d{1,2})/(\d{1,2})/(\d{4}).*$", r"^(\d{4})(\d{2})(\d{2})$"
    first, second = ("$3-$1-$2", "$3-$2-$1") if month_first else ("$3-$2-$1", "$3-$1-$2")
    return (
        F.when(c.rlike(DASHED), c.try_cast("date"))
        .when(c.rlike(SLASHED), F.coalesce(reordered(slashed, first), reordered(slashed, second)))
        .when(c.rlike(COMPACT), reordered(compact, "$1-$2-$3"))
    )


def parse_decimal(text: Column, default: Column | str = "0") -> Column:
    """Blank gives the default, text that is no number gives NULL."""
    fallback = default if isinstance(default, Column) else F.lit(default).cast(MONEY)
    return F.when(text.isNull() | (text == ""), fallback).otherwise(F.trim(text).try_cast(MONEY))


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(f"`{name}`")), F.lit("")) == ""


def _text(name: str) -> Column:
    return F.trim(F.col(f"`{name}`"))


# Per layout the date, the numbers and the identifiers to check.
#: Numbers that a layout may have; where the column is present, a text that is no number rejects the row.
OPTIONAL_NUMBERS = {
    "uci": (),
    "redsea": ("TOTAL AMOUNT", "Vat Amount", "Discount Amount", "Discount Amount(%)"),
    "daily": ("gross_sales", "quantity"),
}
CHECKS = {
    "uci": ("InvoiceDate", ("Quantity", "UnitPrice"), ("InvoiceNo", "StockCode"), "missing invoice or stock code"),
    "redsea": (
        "TRX DATE", ("QUANTITY", "Unit Price", "Net Amount"), ("TRX NUMBER", "ITEM CODE"),
        "missing transaction or item code",
    ),
    "daily": ("date", ("net_sales",), (), ""),
}


def split_valid(df: DataFrame, layout: str) -> DataFrame:
    """Add `reject_reason`: NULL for accepted rows, else the first problem."""
    date_col, numbers, ids, missing = CHECKS[layout]
    reason = F.when(
        parse_date(F.col(f"`{date_col}`"), layout == "uci").isNull(),
        F.concat(F.lit("invalid date: "), F.coalesce(F.col(f"`{date_col}`"), F.lit(""))),
    )
    for n in numbers:
        reason = reason.when(
            parse_decimal(F.col(f"`{n}`")).isNull(),
            F.concat(F.lit("invalid numeric value: "), F.col(f"`{n}`")),
        )
    for n in OPTIONAL_NUMBERS[layout]:
        if n in df.columns:
            broken = ~_blank(n) & parse_decimal(F.col(f"`{n}`")).isNull()
            reason = reason.when(broken, F.concat(F.lit("invalid numeric value: "), F.col(f"`{n}`")))
    for i in ids:
        reason = reason.when(_blank(i), F.lit(missing))
    return df.withColumn("reject_reason", reason)


def first_rejections(df: DataFrame, n: int = 100) -> DataFrame:
    """Messages of the first rejected rows in file order."""
    return df.where("reject_reason is not null").select("row_no", "reject_reason").orderBy("row_no").limit(n)


def optional(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _cut(text: Column, n: int) -> Column:
    return F.nullif(F.substring(F.coalesce(text, F.lit("")), 1, n), F.lit(""))


def to_sales(df: DataFrame, layout: str) -> DataFrame:
    """Accepted rows of a layout in the one sales schema."""
    zero = F.lit(0).cast(MONEY)
    if layout == "daily":
        day, net = parse_date(F.col("date")), parse_decimal(F.col("net_sales"))
        fields = {
            "sale_date": day,
            "transaction_number": F.concat(F.lit("DAILY-"), F.date_format(day, "yyyyMMdd")),
            "transaction_type": F.lit("DAILY_IMPORT"),
            "sku": F.lit("DAILY-IMPORTED-AGGREGATE"),
            "product_name": F.lit("Imported daily aggregate"),
            "customer_key": F.lit(None).cast("string"),
            "channel": F.lit("Aggregate"),
            "family": F.lit("Daily aggregate"),
            "subclass": F.lit("Daily aggregate"),
            "franchise": F.lit("Imported CSV"),
            "quantity": _whole(parse_decimal(optional(df, "quantity"))),
            "unit_price": F.lit(1).cast(MONEY),
            "discount_amount": zero,
            "discount_percent": F.lit(0.0),
            "gross_sales": parse_decimal(optional(df, "gross_sales"), net if "gross_sales" not in df.columns else "0"),
            "net_sales": net,
            "vat_amount": zero,
            "total_amount": net,
        }
    elif layout == "uci":
        qty = _whole(parse_decimal(F.col("Quantity")))
        price = parse_decimal(F.col("UnitPrice"))
        net = (qty * price).cast(MONEY)
        invoice, sku = _text("InvoiceNo"), _text("StockCode")
        fields = {
            "sale_date": parse_date(F.col("InvoiceDate"), month_first=True),
            "transaction_number": invoice,
            "transaction_type": F.when((qty < 0) | F.upper(invoice).startswith("C"), "RETURN").otherwise("INV"),
            "sku": _cut(sku, 50),
            "product_name": _cut(F.coalesce(F.nullif(_text("Description"), F.lit("")), sku), 150),
            "customer_key": F.nullif(_text("CustomerID"), F.lit("")),
            "channel": F.lit("Online"),
            "family": F.lit("Retail"),
            "subclass": F.lit(None).cast("string"),
            "franchise": _cut(F.coalesce(F.nullif(F.col("Country"), F.lit("")), F.lit("UCI")), 120),
            "quantity": qty,
            "unit_price": price,
            "discount_amount": zero,
            "discount_percent": F.lit(0.0),
            "gross_sales": F.greatest(net, zero),
            "net_sales": net,
            "vat_amount": zero,
            "total_amount": net,
        }
    elif layout == "redsea":
        net, total = parse_decimal(F.col("`Net Amount`")), parse_decimal(F.col("`TOTAL AMOUNT`"))
        sku = _text("ITEM CODE")
        vat_missing = (total - net).cast(MONEY)
        given = F.trim(optional(df, "Discount Amount(%)"))
        pct = F.when(F.coalesce(given, F.lit("")) == "", F.lit(0.0)).otherwise(given.try_cast("double"))
        fields = {
            "sale_date": parse_date(F.col("`TRX DATE`")),
            "transaction_number": _text("TRX NUMBER"),
            "transaction_type": F.upper(F.coalesce(F.nullif(F.trim(optional(df, "Type")), F.lit("")), F.lit("INV"))),
            "sku": _cut(sku, 50),
            "product_name": _cut(F.coalesce(F.nullif(F.trim(optional(df, "ITEM DESC")), F.lit("")), sku), 150),
            "customer_key": F.nullif(_text("CUSTOMER NUMBER"), F.lit("")),
            "channel": _cut(F.coalesce(F.nullif(F.col("`SALES CHANNEL`"), F.lit("")), F.lit("Store")), 30),
            "family": _cut(optional(df, "FAMILY"), 80),
            "subclass": _cut(optional(df, "SUBCLASS"), 120),
            "franchise": _cut(optional(df, "FRANCHISE"), 120),
            "quantity": _whole(parse_decimal(F.col("QUANTITY"))),
            "unit_price": parse_decimal(F.col("`Unit Price`")),
            "discount_amount": parse_decimal(optional(df, "Discount Amount")),
            "discount_percent": clip(pct, 0.0, 100.0),
            "gross_sales": F.greatest(net, zero),
            "net_sales": net,
            "vat_amount": parse_decimal(optional(df, "Vat Amount"), vat_missing) if "Vat Amount" not in df.columns
            else parse_decimal(F.col("`Vat Amount`")),
            "total_amount": total,
        }
    else:
        raise ValueError(f"unknown layout {layout}")
    kept = [c for c in ("source_row_hash", "source_import_id") if c in df.columns]
    return df.select(*[v.alias(k) for k, v in fields.items()], *kept)


def _whole(number: Column) -> Column:
    """Cut off the fraction."""
    n = number.cast("double")
    return F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("long")


def row_hash(df: DataFrame, mode: str, columns: Sequence[str] | None = None) -> DataFrame:
    """`source_row_hash`: the layout and the row as JSON with sorted names."""
    names = sorted(columns or [c for c in df.columns if c not in ("row_no", "reject_reason")])
    payload = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"})
    return df.withColumn("source_row_hash", F.sha2(F.concat(F.lit(f"{mode}:"), payload), 256))


def insert_new(existing: DataFrame, incoming: DataFrame, key: str = "source_row_hash") -> DataFrame:
    """Incoming rows whose hash is new, once each.

    Repeats collapse before the shuffle; the key is a hash, so partitions
    come out even.
    """
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def insert_counts(incoming: DataFrame, inserted: DataFrame) -> DataFrame:
    parsed = incoming.agg(F.count(F.lit(1)).alias("parsed_rows"))
    new = inserted.agg(F.count(F.lit(1)).alias("inserted_rows"))
    return parsed.join(F.broadcast(new)).withColumn(
        "duplicate_rows", F.greatest(F.col("parsed_rows") - F.col("inserted_rows"), F.lit(0))
    )


def duplicate_effect(df: DataFrame, amount: str) -> DataFrame:
    """What dropping identical rows removes, in rows and money."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(
        F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("clean_rows"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.sum(F.col(amount) * (F.col("_n") - 1).cast("decimal(18,0)")).alias("duplicate_amount"),
    )


def flag_returns(df: DataFrame, invoice: str, quantity: str, price: str) -> DataFrame:
    """Cancellation by invoice prefix or negative quantity, and the signed amount."""
    is_return = F.upper(F.col(invoice).cast("string")).startswith("C") | (F.col(quantity) < 0)
    size = F.abs(F.col(quantity)) * F.col(price)
    return df.withColumn("is_return", is_return).withColumn("amount", F.when(is_return, -size).otherwise(size))


def money_columns(df: DataFrame, quantity: str, price: str, is_return: str, fx: str = "4.6", vat: str = "0.15") -> DataFrame:
    """Converted unit price, subtotal, VAT and total, each rounded to cents
    half to even."""
    unit = F.bround(F.col(price).cast("decimal(14,4)") * F.lit(fx).cast("decimal(6,4)"), 2)
    d = df.withColumn("unit_sar", unit.cast("decimal(16,2)"))
    size = F.abs(F.col(quantity)).cast("decimal(10,0)") * F.col("unit_sar")
    d = d.withColumn("subtotal", F.when(F.col(is_return), -size).otherwise(size).cast("decimal(20,2)"))
    d = d.withColumn("vat", F.bround(F.col("subtotal") * F.lit(vat).cast("decimal(4,2)"), 2).cast("decimal(20,2)"))
    return d.withColumn("total", (F.col("subtotal") + F.col("vat")).cast("decimal(21,2)"))


def money_mismatch(df: DataFrame, subtotal: str, vat: str, total: str, rate: str = "0.15") -> DataFrame:
    """Rows whose stored parts disagree by more than a cent."""
    limit = F.lit("0.011").cast("decimal(6,3)")
    expected_vat = F.bround(F.col(subtotal) * F.lit(rate).cast("decimal(4,2)"), 2)
    return df.where(
        (F.abs(F.col(vat) - expected_vat) > limit)
        | (F.abs(F.col(total) - (F.col(subtotal) + F.col(vat))) > limit)
    )


def gross_return_split(df: DataFrame, net: str) -> DataFrame:
    zero = F.lit(0).cast(MONEY)
    return df.withColumns({"gross": F.greatest(F.col(net), zero), "returns": F.greatest(-F.col(net), zero)})


def preferred_scope(sales: DataFrame) -> DataFrame:
    """Imported rows once there are any, otherwise the seeded ones; `data_mode`
    says which."""
    imported = sales.agg((F.count_if(F.col("source_import_id").isNotNull()) > 0).alias("_has"))
    keep = F.col("source_import_id").isNotNull() == F.col("_has")
    return (
        sales.join(F.broadcast(imported))
        .where(keep)
        .withColumn("data_mode", F.when(F.col("_has"), "imported").otherwise("seed"))
        .drop("_has")
    )


def choose_history(sales: DataFrame, min_days: int = 28, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the one history source to use, with `data_mode`; per group when
    `by` is given. Sources are never mixed.

    The choice needs only the calendar span of each source.
    """
    by = list(by)
    source = (
        F.when(F.col("transaction_type") == "DAILY_IMPORT", "daily_import")
        .when(F.col("transaction_type") == "DAILY_AGGREGATE", "seed_aggregate")
        .otherwise("transaction_level")
    )
    tagged = sales.withColumn("_source", source)
    spans = tagged.groupBy(*by, "_source").agg(
        (F.datediff(F.max("sale_date"), F.min("sale_date")) + 1).alias("_span")
    )

    def span(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("_source") == name, F.col("_span"))), F.lit(0)).alias(name)

    choice = spans.groupBy(*by).agg(span("transaction_level"), span("daily_import"))
    rich, daily = F.col("transaction_level"), F.col("daily_import")
    # one row per group, written once: its size is known where the lines meet it
    choice = settle(choice.select(
        *by,
        F.when(rich >= min_days, "transaction_level")
        .when(daily >= min_days, "daily_import")
        .when(rich > 0, "transaction_level_insufficient")
        .when(daily > 0, "daily_import_insufficient")
        .otherwise("seed_aggregate")
        .alias("data_mode"),
    ))
    joined = tagged.join(choice, by) if by else tagged.join(F.broadcast(choice))
    return joined.where(F.col("_source") == F.regexp_replace("data_mode", "_insufficient$", "")).drop("_source")


def scope_to_branches(df: DataFrame, branches: Sequence[int] | None, col: str = "branch") -> DataFrame:
    """None keeps all rows, an empty scope keeps none.

    A scope is a user's own branch list: short, and known to the caller.
    """
    if branches is None:
        return df
    if not branches:
        return df.limit(0)
    table = df.sparkSession.createDataFrame([(int(b),) for b in sorted(set(branches))], f"{col} int")
    return df.join(F.broadcast(table), col, "left_semi")


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def classify_text(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first matching pattern, ignoring case."""
    subject = F.coalesce(text, F.lit(""))
    label = None
    for name, pattern in rules:
        hit = subject.rlike(f"(?i){pattern}")
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return F.lit(default) if label is None else label.otherwise(default)


def admin_line(code: Column, text: Column, codes: Sequence[str], pattern: str) -> Column:
    """True for charges and corrections that are not sales of a product."""
    c = F.upper(F.trim(F.coalesce(code.cast("string"), F.lit(""))))
    return c.isin(*codes) | F.upper(F.coalesce(text, F.lit(""))).rlike(pattern)


def effective_customer(df: DataFrame, customer: str, invoice: str) -> DataFrame:
    """The observed customer, or a stand-in made from the invoice."""
    seen = F.col(customer).isNotNull()
    return df.withColumns(
        {
            "effective_customer": F.coalesce(
                F.col(customer).cast("string"), F.concat(F.lit("INV-"), F.col(invoice).cast("string"))
            ),
            "customer_source": F.when(seen, "observed").otherwise("invoice_fallback"),
            "observed_customer": F.when(seen, F.col(customer).cast("string")),
        }
    )


def stable_int(text: Column, modulus: int) -> Column:
    """The first 8 bytes of SHA-256 as a big-endian number, modulo `modulus`."""
    head = F.conv(F.substring(F.sha2(text.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(modulus).cast("decimal(20,0)")).cast("long")


def stable_id(text: Column, modulus: int, prefix: str) -> Column:
    width = len(str(modulus - 1))
    return F.concat(F.lit(prefix), F.lpad(stable_int(text, modulus).cast("string"), width, "0"))


def id_collisions(df: DataFrame, source: str, target: str) -> DataFrame:
    """Violations of the one-to-one mapping, either way round."""
    pairs = df.select(source, target).distinct()
    one = pairs.groupBy(F.col(source).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    two = pairs.groupBy(F.col(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return one.withColumn("side", F.lit("source")).unionByName(two.withColumn("side", F.lit("target"))).where("n > 1")


def weighted_bucket(key: Column, weights: Mapping[str, float]) -> Column:
    """A label drawn by hash in proportion to its weight."""
    total = float(sum(weights.values()))
    u = stable_int(key, 10**12) / F.lit(float(10**12))
    names = list(weights)
    running, out = 0.0, None
    for name in names[:-1]:
        running += weights[name] / total
        out = F.when(u < running, name) if out is None else out.when(u < running, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def quota_assign(keys: DataFrame, key: str, group: str, share: Column, salt: str, ranges: int = 1024) -> DataFrame:
    """Exactly round(share * n) keys of each group get `in_quota`, in hash
    order.

    The hash range is cut evenly, keys are numbered inside each cut and
    shifted by the sizes of the cuts before it, so a group of any size is
    ordered by many tasks. `share` may depend on the group.
    """
    k = keys.select(group, key).distinct().withColumn(
        "_h", stable_int(F.concat(F.lit(f"{salt}:"), F.col(group), F.lit(":"), F.col(key)), 10**15)
    )
    k = settle(k.withColumn("_cut", F.floor(F.col("_h") / F.lit(10.0**15 / ranges)).cast("int")))
    before = Window.partitionBy(group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = k.groupBy(group, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(
        group,
        "_cut",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy(group)).alias("_all"),
    )
    inside = Window.partitionBy(group, "_cut").orderBy("_h", key)
    placed = k.withColumn("_row", F.row_number().over(inside)).join(sizes, [group, "_cut"])
    return placed.select(
        group, key, (F.col("_start") + F.col("_row") <= F.bround(share * F.col("_all"))).alias("in_quota")
    )


def select_indicator(df: DataFrame, words: Sequence[str], city_total: bool | None = None, sector_total: bool | None = None) -> DataFrame:
    """Rows whose indicator holds all words and not "change"; totals can be
    required or excluded on each level."""
    text = F.lower("indicator")
    keep = ~text.contains("change")
    for w in words:
        keep = keep & text.contains(w)
    for col, want in (("city", city_total), ("sector", sector_total)):
        if want is not None:
            keep = keep & ((F.lower(F.trim(col)) == "total") == F.lit(want))
    return df.where(keep)


# Accented Latin letters and their plain form.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def normal_label(text: Column) -> Column:
    """Lower case words of plain letters and digits, & read as "and"."""
    c = F.translate(text, ACCENTED, PLAIN)
    c = F.regexp_replace(c, r"[^\x00-\x7F]", "")
    c = F.regexp_replace(c, "&", " and ")
    return F.lower(F.trim(F.regexp_replace(c, "[^a-zA-Z0-9]+", " ")))


def canonical_labels(df: DataFrame, label: str, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Map labels through the alias table; labels without one drop out.

    The alias table is written by hand, so its size is fixed.
    """
    rows = [(a, name) for name, options in aliases.items() for a in options]
    table = df.sparkSession.createDataFrame(rows, "alias string, canonical string")
    table = table.select(normal_label(F.col("alias")).alias("_n"), "canonical").distinct()
    return df.withColumn("_n", normal_label(F.col(label))).join(F.broadcast(table), "_n").drop("_n")


def apply_rule_multipliers(df: DataFrame, rules: Sequence[tuple[Column, float]], base: str) -> DataFrame:
    """The product of the factors whose condition holds; the modelled value
    stays beside the base value."""
    factor = F.lit(1.0)
    for condition, f in rules:
        factor = factor * F.when(condition, F.lit(float(f))).otherwise(F.lit(1.0))
    d = df.withColumn("multiplier", F.round(factor, 4))
    return d.withColumn("modeled", F.col(base).cast("double") * F.col("multiplier"))


def clip_nonnegative(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.greatest(F.col(value), F.lit(0.0)))


FORBIDDEN = ("future", "target", "actual_")


def select_features(
    df: DataFrame, allow_prefixes: Sequence[str] = (), allow: Sequence[str] = (), deny: Sequence[str] = (),
    deny_prefixes: Sequence[str] = (), budget: int | None = None, keys: Sequence[str] = (),
) -> list[str]:
    """Numeric columns that may be features.

    Names that look like a label, a future value or an outcome are refused
    even when asked for by name.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    wrong = [c for c in allow if any(w in c.lower() for w in FORBIDDEN)]
    if wrong:
        raise ValueError(f"outcome columns asked for as features: {wrong}")
    chosen = [
        c
        for c in numeric
        if c not in keys
        and c not in deny
        and not c.startswith(tuple(deny_prefixes))
        and not any(w in c.lower() for w in FORBIDDEN)
        and (not (allow_prefixes or allow) or c in allow or c.startswith(tuple(allow_prefixes)))
    ]
    if not chosen:
        raise ValueError("no usable feature columns")
    if budget is not None and len(chosen) > budget:
        raise ValueError(f"{len(chosen)} features exceed the budget of {budget}")
    return chosen


def fill_neutral(df: DataFrame, columns: Sequence[str], share_col: str | None = None, year: Column | None = None,
                 share_by_year: Mapping[int, float] | None = None, default_share: float = 0.85) -> DataFrame:
    """Missing ratios and indexes become 1, other features 0, a missing
    payment share that year's known share."""
    out = {
        c: F.coalesce(F.col(c), F.lit(1.0 if "ratio" in c or "index" in c else 0.0)) for c in columns
    }
    if share_col is not None:
        known = F.lit(default_share)
        for y, s in (share_by_year or {}).items():
            known = F.when(year == y, F.lit(float(s))).otherwise(known)
        out[share_col] = F.coalesce(F.col(share_col), known)
    return df.withColumns(out)
