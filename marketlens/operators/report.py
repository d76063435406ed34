"""Executive summary: KPI table, recommendations and dashboard cards.

The published summary is typed in by hand.  Here every number is computed: ``summary`` reduces the
analyses to one row of figures, and the KPI / recommendation rows are produced from that one
wide row.  Nothing is collected to the driver; all text is
formatted by Spark expressions after the numbers are rounded.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import rules as R
from marketlens.functions import published as P
from marketlens.functions.numeric import r, ratio
from marketlens.operators.common import checkpoint_once, sort_small
from marketlens.operators.summary import DEFAULT_RULES, SummaryRules, figures
from marketlens.sources.tables import Tables


# ---------------------------------------------------------------- display text

def money0(x: Column) -> Column:
    """'$13,591,643' — rounded half-up to whole units first."""
    return F.concat(F.lit("$"), F.format_number(r(x, 0).cast("bigint"), 0))


def money2(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(r(x, 2), 2))


def millions(x: Column) -> Column:
    """'$1.48M'."""
    return F.concat(F.lit("$"), F.format_number(r(x / F.lit(1e6), 2), 2), F.lit("M"))


def count0(x: Column) -> Column:
    return F.format_number(x.cast("bigint"), 0)


def dec2(x: Column) -> Column:
    return F.format_number(r(x, 2), 2)


def dec1(x: Column) -> Column:
    return F.format_number(r(x, 1), 1)


def na(x: Column) -> Column:
    return F.coalesce(x, F.lit("n/a"))


# ---------------------------------------------------------------- KPI table

def _kpi_rows(f: DataFrame) -> DataFrame:
    c = F.col
    out_of_5 = lambda x: F.concat(dec2(x), F.lit(" / 5"))
    percent = lambda x: F.concat(dec2(x), F.lit("%"))
    n_sellers = lambda x: F.concat(count0(x), F.lit(" sellers"))
    # column and display text, in the order of P.KPIS
    shown = [
        ("gross_revenue", money0),
        ("avg_item_price", money2),
        ("cancel_revenue", money0),
        ("pipeline_revenue", money0),
        ("freight_loss_top5", money0),
        ("orders_with_items", count0),
        ("on_time_pct", percent),
        ("worst_delay_days", lambda x: F.concat(x.cast("string"), F.lit(" days"))),
        ("on_time_review", out_of_5),
        ("critical_review", out_of_5),
        ("total_unique_customers", count0),
        ("repeat_customers", count0),
        ("retention_rate_pct", percent),
        ("champions", count0),
        ("cold_customers", count0),
        ("dormant_value", millions),
        ("sellers", count0),
        ("platform_review", out_of_5),
        ("elite_sellers", n_sellers),
        ("high_cancel_sellers", n_sellers),
        ("undermonetised_sellers", n_sellers),
        ("credit_share", percent),
        ("credit_installments", lambda x: F.concat(dec2(x), F.lit(" months"))),
        ("high_risk_exposure", money0),
        ("paid_in_full_rows", count0),
    ]
    rows = [(category, kpi, c(x), text(c(x))) for (category, kpi), (x, text) in zip(P.KPIS, shown, strict=True)]
    structs = [
        F.struct(
            F.lit(cat).alias("category"),
            F.lit(kpi).alias("kpi"),
            F.lit(pos).alias("position"),
            num.cast("double").alias("value_num"),
            text.alias("value"),
        )
        for pos, (cat, kpi, num, text) in enumerate(rows, 1)
    ]
    return f.select(F.explode(F.array(*structs)).alias("k")).select("k.*")


def kpi_table(f: DataFrame) -> DataFrame:
    """P19 from a figures row."""
    return _kpi_rows(f).select("category", "kpi", "value", "position", "value_num").transform(sort_small, "position")


def kpi_dashboard(t: Tables, as_of: dt.date | str = R.DEFAULT_AS_OF, rules: SummaryRules = DEFAULT_RULES) -> DataFrame:
    return kpi_table(figures(t, as_of, rules))


# ---------------------------------------------------------------- recommendations

def recommendations(t: Tables, as_of: dt.date | str = R.DEFAULT_AS_OF, rules: SummaryRules = DEFAULT_RULES) -> DataFrame:
    return recommendation_rows(figures(t, as_of, rules))


def recommendation_rows(f: DataFrame) -> DataFrame:
    """P20 from a figures row."""
    c = F.col

    def txt(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else na(p) for p in parts])

    lowest = F.when(c("high_risk_review") <= c("least_tier_review"), F.lit("lowest satisfaction ")).otherwise(F.lit("satisfaction "))
    moves = F.when(c("critical_review") < c("on_time_review"), F.lit("drops")).otherwise(F.lit("goes"))
    # action, evidence and impact, in the order of P.AREAS
    texts = [
        (txt("Cancel high-freight low-value listings"),
         txt("Category ", c("top_freight_category"), " leads freight losses at ", dec2(c("top_freight_pct")), "% average freight ratio"),
         txt(money0(c("freight_loss_top5")), " direct losses recoverable")),
        (txt("Investigate ", count0(c("pipeline_orders")), " paid but unshipped orders immediately"),
         txt("Invoiced + processing orders sitting idle with customer money held"),
         txt(money0(c("pipeline_revenue")), " stuck in pipeline")),
        (txt("Place ", count0(c("high_cancel_sellers")), " high-cancellation sellers on performance review"),
         txt(dec2(c("high_cancel_rate")), "% avg cancellation rate vs ", dec2(c("cancel_share_pct")), "% of all orders cancelled"),
         txt("Reduces ", money0(c("cancel_revenue")), " annual cancellation losses")),
        (txt("Launch win-back campaign for ", count0(c("cold_customers")), " high-value cold customers"),
         txt("Avg spend ", money0(c("cold_spend")), " each, not purchased in ", count0(c("cold_days")), " days"),
         txt(millions(c("dormant_value")), " potential repeat revenue")),
        (txt("Investigate ", c("worst_year").cast("string"), " logistics failure"),
         txt(count0(c("date_orders")), " orders ", c("date_least").cast("string"), "-", c("date_most").cast("string"), " days late all sharing the delivery date ", c("date_on")),
         txt("Review score ", moves, " from ", dec2(c("on_time_review")), " to ", dec2(c("critical_review")), " when orders are late")),
        (txt("Set maximum instalment limits per product category"),
         txt(count0(c("high_risk_rows")), " high-risk orders with ", millions(c("high_risk_exposure")), " exposure, ", lowest, dec2(c("high_risk_review"))),
         txt("Reduces refund risk on high-instalment purchases")),
        (txt("Create growth programme for ", count0(c("undermonetised_sellers")), " undermonetised quality sellers"),
         txt("Avg review ", dec2(c("undermonetised_review")), " but revenue only ", money0(c("undermonetised_revenue")), " vs ", money0(c("elite_revenue")), " for top performers"),
         txt(dec1(ratio(c("elite_revenue"), c("undermonetised_revenue"))), "x revenue potential without quality risk")),
        (txt("Protect top ", count0(c("elite_sellers")), " elite sellers with dedicated account management"),
         txt("Top ", count0(c("elite_sellers")), " sellers avg ", money0(c("elite_revenue")), " revenue each, carry disproportionate platform share"),
         txt("Losing 3 elite sellers = ", money0(c("elite_revenue") * F.lit(3.0)), " revenue risk")),
    ]
    rows = [(str(i), area, *text) for i, (area, text) in enumerate(zip(P.AREAS, texts, strict=True), 1)]
    structs = [
        F.struct(
            F.lit(p).alias("priority"),
            F.lit(area).alias("recommendation_area"),
            action.alias("action"),
            evidence.alias("evidence"),
            impact.alias("estimated_impact"),
        )
        for p, area, action, evidence, impact in rows
    ]
    return f.select(F.explode(F.array(*structs)).alias("x")).select("x.*").transform(sort_small, "priority")


# ---------------------------------------------------------------- dashboard cards

def dashboard_cards(t: Tables, as_of: dt.date | str = R.DEFAULT_AS_OF, rules: SummaryRules = DEFAULT_RULES) -> DataFrame:
    """The page's cards as data: section, label, value, note, tone."""
    return card_rows(figures(t, as_of, rules))


def card_rows(f: DataFrame) -> DataFrame:
    """Dashboard cards from a figures row."""
    c = F.col

    def txt(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else na(p) for p in parts])

    satisfaction_drop = r(ratio((c("on_time_review") - c("critical_review")) * F.lit(100.0), c("on_time_review")), 0)
    # value and note, in the order of P.CARDS
    texts = [
        (millions(c("gross_revenue")), txt("")),
        (money2(c("avg_item_price")), txt("")),
        (money0(c("cancel_revenue")), txt(count0(c("cancel_orders")), " cancelled orders")),
        (money0(c("pipeline_revenue")), txt(count0(c("pipeline_orders")), " paid, unshipped")),
        (money0(c("freight_loss_top5")), txt("Top 5 categories")),
        (count0(c("orders_with_items")), txt("")),
        (txt(dec2(c("on_time_pct")), "%"), txt("")),
        (txt(c("worst_delay_days").cast("string"), " days"), txt(c("worst_year").cast("string"), " logistics failure")),
        (txt(dec2(c("on_time_review")), "/5"), txt("")),
        (txt(dec2(c("critical_review")), "/5"), txt(count0(satisfaction_drop), "% satisfaction drop")),
        (count0(c("total_unique_customers")), txt("")),
        (txt(dec2(c("retention_rate_pct")), "%"), txt("Industry avg 20–30%")),
        (count0(c("champions")), txt("Avg spend ", money0(c("champion_spend")))),
        (count0(c("cold_customers")), txt("Avg spend ", money0(c("cold_spend")))),
        (millions(c("dormant_value")), txt("Win-back potential")),
        (count0(c("sellers")), txt("")),
        (txt(dec2(c("platform_review")), "/5"), txt("")),
        (count0(c("elite_sellers")), txt("Avg ", money0(c("elite_revenue")), " revenue")),
        (count0(c("high_cancel_sellers")), txt(dec2(c("high_cancel_rate")), "% cancel rate")),
        (count0(c("undermonetised_sellers")), txt(dec2(c("undermonetised_review")), " avg review")),
        (txt(dec2(c("credit_share")), "%"), txt("")),
        (dec2(c("credit_installments")), txt("Credit card orders")),
        (millions(c("high_risk_exposure")), txt("10+ instalment orders")),
        (count0(c("paid_in_full_rows")), txt("Score ", dec2(c("paid_in_full_review")), "/5")),
    ]
    cards = [(section, label, *text, tone) for (section, label, tone), text in zip(P.CARDS, texts, strict=True)]
    structs = [
        F.struct(
            F.lit(pos).alias("position"),
            F.lit(section).alias("section"),
            F.lit(label).alias("label"),
            na(value).alias("value"),
            note.alias("note"),
            F.lit(tone).alias("tone"),
        )
        for pos, (section, label, value, note, tone) in enumerate(cards, 1)
    ]
    return f.select(F.explode(F.array(*structs)).alias("x")).select("x.*").transform(sort_small, "position")


# ---------------------------------------------------------------- all three at once

def executive_summary(t: Tables, as_of: dt.date | str = R.DEFAULT_AS_OF, rules: SummaryRules = DEFAULT_RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """KPI table, recommendations and cards from ONE computation of the figures.

    The analyses run once; their one-row result is checkpointed to
    the shared ``spark.checkpoint.dir`` (lineage cut, survives executor loss)
    and the three outputs are read from it.
    """
    f = checkpoint_once(figures(t, as_of, rules))
    return kpi_table(f), recommendation_rows(f), card_rows(f)
