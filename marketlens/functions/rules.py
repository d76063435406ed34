"""Scoring and classification ladders (first matching arm wins).

Thresholds are parameters (one frozen dataclass per rule); labels are the
published category names.  A comparison with NULL is not true, so a NULL
input falls through to the next arm, exactly like SQL ``CASE WHEN``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Category labels that must equal the published ones, verbatim
# (they contain an em dash, U+2014).
# ---------------------------------------------------------------------------
FREIGHT_CRITICAL = "critical — freight exceeds product"
FREIGHT_HIGH = "high risk — freight over 75% of price"
FREIGHT_MODERATE = "moderate — freight over 50% of price"
FREIGHT_OK = "acceptable"

DELIVERY_ON_TIME = "on time"
DELIVERY_SLIGHT = "slightly late (1-7 days)"
DELIVERY_VERY = "very late (8-30 days)"
DELIVERY_CRITICAL = "critically late (30+ days)"
DELIVERY_LABELS = (DELIVERY_ON_TIME, DELIVERY_SLIGHT, DELIVERY_VERY, DELIVERY_CRITICAL)
# Scorecard tiers are the same labels prefixed "1 — " … "4 — ".

SEG_CHAMPION = "Champion"
SEG_LOYAL = "Loyal customer"
SEG_PROMISING = "Promising — new customer"
SEG_AT_RISK = "At risk — was loyal"
SEG_CANNOT_LOSE = "Cannot lose — high value gone cold"
SEG_LOST = "Lost or low value"

SELLER_ELITE = "Top performer — elite seller"
SELLER_QUALITY_RISK = "Revenue strong but quality risk"
SELLER_HIDDEN_GEM = "Hidden gem — strong revenue and quality"
SELLER_UNDERMONETISED = "Quality strong but undermonetised"
SELLER_HIGH_CANCEL = "High cancellation — needs review"
SELLER_AVERAGE = "Average performer"

PAY_HIGH = "High risk — large purchase, many instalments"
PAY_MEDIUM = "Medium risk — mid purchase, extended payment"
PAY_LOW = "Low risk — moderate instalment behaviour"
PAY_NONE = "No risk — paid in full"
PAY_MINIMAL = "Minimal risk — short instalment, low value"

CANCELED = "canceled"
DELIVERED = "delivered"
EXCLUDED_STATUSES = ("canceled", "unavailable")
PIPELINE_STATUSES = ("invoiced", "processing")
CREDIT_CARD = "credit_card"
# ---------------------------------------------------------------------------

# The reference date of the published figures; the derived test tables end
# in 1998, so tests and the oracle pass their own ``as_of``.
DEFAULT_AS_OF = dt.date(2018, 10, 1)
TESTDATA_AS_OF = dt.date(2001, 8, 31)


def _lit_dec(v: float) -> Column:
    """The threshold as the exact decimal it is written as."""
    return F.lit(Decimal(str(v)))


@dataclass(frozen=True)
class FreightRule:
    high_share: float = 0.75
    moderate_share: float = 0.50

    def label(self, price: Column, freight: Column) -> Column:
        return (
            F.when(freight >= price, FREIGHT_CRITICAL)
            .when(freight >= price * _lit_dec(self.high_share), FREIGHT_HIGH)
            .when(freight >= price * _lit_dec(self.moderate_share), FREIGHT_MODERATE)
            .otherwise(FREIGHT_OK)
        )


@dataclass(frozen=True)
class DeliveryRule:
    slight_days: int = 7
    very_days: int = 30

    def names(self) -> tuple[str, str, str, str]:
        """The labels; with the published thresholds they are DELIVERY_LABELS."""
        return (
            DELIVERY_ON_TIME,
            f"slightly late (1-{self.slight_days} days)",
            f"very late ({self.slight_days + 1}-{self.very_days} days)",
            f"critically late ({self.very_days}+ days)",
        )

    def label(self, delivered: Column, estimated: Column, tiered: bool = False) -> Column:
        days = F.datediff(delivered, estimated)
        names = [f"{i} — {n}" for i, n in enumerate(self.names(), 1)] if tiered else list(self.names())
        return (
            F.when(delivered <= estimated, names[0])
            .when(days <= self.slight_days, names[1])
            .when(days <= self.very_days, names[2])
            .otherwise(names[3])
        )


@dataclass(frozen=True)
class RfmRule:
    recency_days: tuple[int, int, int] = (90, 180, 270)  # <= each -> 4, 3, 2; else 1
    frequency_orders: tuple[int, int, int] = (3, 2, 1)  # >= each -> 4, 3, 2; else 1
    monetary: tuple[float, float, float] = (500, 200, 100)  # >= each -> 4, 3, 2; else 1

    def recency_score(self, days: Column) -> Column:
        a, b, c = self.recency_days
        return F.when(days <= a, 4).when(days <= b, 3).when(days <= c, 2).otherwise(1)

    def frequency_score(self, orders: Column) -> Column:
        a, b, c = self.frequency_orders
        return F.when(orders >= a, 4).when(orders >= b, 3).when(orders >= c, 2).otherwise(1)

    def monetary_score(self, spend: Column) -> Column:
        a, b, c = self.monetary
        return F.when(spend >= a, 4).when(spend >= b, 3).when(spend >= c, 2).otherwise(1)


@dataclass(frozen=True)
class SegmentRuleA:
    """Score-based segments (the per-customer listing)."""

    champion_total: int = 10
    loyal_total: int = 8
    promising_recency: int = 3
    promising_frequency: int = 2
    at_risk_recency: int = 2
    at_risk_frequency: int = 3
    cannot_lose_recency: int = 1
    cannot_lose_monetary: int = 3

    def label(self, r: Column, f: Column, m: Column) -> Column:
        total = r + f + m
        return (
            F.when(total >= self.champion_total, SEG_CHAMPION)
            .when(total >= self.loyal_total, SEG_LOYAL)
            .when((r >= self.promising_recency) & (f <= self.promising_frequency), SEG_PROMISING)
            .when((r <= self.at_risk_recency) & (f >= self.at_risk_frequency), SEG_AT_RISK)
            .when((r <= self.cannot_lose_recency) & (m >= self.cannot_lose_monetary), SEG_CANNOT_LOSE)
            .otherwise(SEG_LOST)
        )


@dataclass(frozen=True)
class SegmentRuleB:
    """Raw-value segments (the summary): same labels, different arms after the first two."""

    champion_total: int = 10
    loyal_total: int = 8
    promising_days: int = 180
    promising_orders: int = 1
    cold_days: int = 270
    at_risk_orders: int = 3
    cannot_lose_spend: float = 500

    def label(self, r: Column, f: Column, m: Column, days: Column, orders: Column, spend: Column) -> Column:
        total = r + f + m
        return (
            F.when(total >= self.champion_total, SEG_CHAMPION)
            .when(total >= self.loyal_total, SEG_LOYAL)
            .when((days <= self.promising_days) & (orders <= self.promising_orders), SEG_PROMISING)
            .when((days > self.cold_days) & (orders >= self.at_risk_orders), SEG_AT_RISK)
            .when((days > self.cold_days) & (spend >= self.cannot_lose_spend), SEG_CANNOT_LOSE)
            .otherwise(SEG_LOST)
        )


@dataclass(frozen=True)
class SellerRule:
    elite_revenue: float = 100000
    good_review: float = 4.0
    risky_review: float = 3.7
    gem_revenue_low: float = 50000
    niche_revenue_low: float = 10000
    niche_review: float = 4.2
    cancel_rate: float = 5

    def label(self, revenue: Column, review: Column, cancel_rate: Column) -> Column:
        return (
            F.when((revenue > self.elite_revenue) & (review >= self.good_review), SELLER_ELITE)
            .when((revenue > self.elite_revenue) & (review < self.risky_review), SELLER_QUALITY_RISK)
            .when(revenue.between(self.gem_revenue_low, self.elite_revenue) & (review >= self.good_review), SELLER_HIDDEN_GEM)
            .when(revenue.between(self.niche_revenue_low, self.gem_revenue_low) & (review >= self.niche_review), SELLER_UNDERMONETISED)
            .when(cancel_rate > self.cancel_rate, SELLER_HIGH_CANCEL)
            .otherwise(SELLER_AVERAGE)
        )


@dataclass(frozen=True)
class PaymentRiskRule:
    high: tuple[int, float] = (10, 300)
    medium: tuple[int, float] = (6, 200)
    low: tuple[int, float] = (3, 100)

    def label(self, installments: Column, value: Column) -> Column:
        def arm(t: tuple[int, float]) -> Column:
            return (installments >= t[0]) & (value >= _lit_dec(t[1]))

        return (
            F.when(arm(self.high), PAY_HIGH)
            .when(arm(self.medium), PAY_MEDIUM)
            .when(arm(self.low), PAY_LOW)
            .when(installments == 1, PAY_NONE)
            .otherwise(PAY_MINIMAL)
        )
