"""Names of the published summary, used by the report and by its oracle."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# They must equal the published ones, verbatim and in this order.
# ---------------------------------------------------------------------------
KPIS = (
    ("REVENUE", "Total Gross Revenue"),
    ("REVENUE", "Avg Order Value"),
    ("REVENUE", "Revenue Lost to Cancellations"),
    ("REVENUE", "Revenue Stuck in Pipeline"),
    ("REVENUE", "Freight Margin Losses (Top 5 Categories)"),
    ("DELIVERY", "Total Orders"),
    ("DELIVERY", "On Time Delivery Rate"),
    ("DELIVERY", "Worst Single Delivery Delay"),
    ("DELIVERY", "On Time Avg Review Score"),
    ("DELIVERY", "Critically Late Avg Review Score"),
    ("CUSTOMERS", "Total Unique Customers"),
    ("CUSTOMERS", "Repeat Customers"),
    ("CUSTOMERS", "Retention Rate"),
    ("CUSTOMERS", "Champion Customers"),
    ("CUSTOMERS", "High Value Gone Cold"),
    ("CUSTOMERS", "Dormant Revenue Opportunity"),
    ("SELLERS", "Total Active Sellers"),
    ("SELLERS", "Platform Avg Review Score"),
    ("SELLERS", "Elite Top Performers"),
    ("SELLERS", "High Cancellation Sellers"),
    ("SELLERS", "Undermonetised Quality Sellers"),
    ("PAYMENTS", "Credit Card Share"),
    ("PAYMENTS", "Avg Credit Instalments"),
    ("PAYMENTS", "High Risk Instalment Exposure"),
    ("PAYMENTS", "No Risk (Paid in Full) Orders"),
)
AREAS = (
    "Revenue Recovery",
    "Pipeline Fix",
    "Seller Management",
    "Customer Retention",
    "Delivery Operations",
    "Credit Risk",
    "Seller Development",
    "Platform Health",
)
# section, label, tone
CARDS = (
    ("Revenue", "Gross revenue", "neutral"),
    ("Revenue", "Avg order value", "neutral"),
    ("Revenue", "Lost to cancellations", "negative"),
    ("Revenue", "Stuck in pipeline", "negative"),
    ("Revenue", "Freight margin losses", "negative"),
    ("Delivery", "Total orders", "neutral"),
    ("Delivery", "On time delivery rate", "positive"),
    ("Delivery", "Worst single delay", "negative"),
    ("Delivery", "On time review score", "positive"),
    ("Delivery", "Late delivery score", "negative"),
    ("Customer LTV", "Unique customers", "neutral"),
    ("Customer LTV", "Retention rate", "negative"),
    ("Customer LTV", "Champion customers", "positive"),
    ("Customer LTV", "High value gone cold", "warning"),
    ("Customer LTV", "Dormant opportunity", "info"),
    ("Sellers", "Active sellers", "neutral"),
    ("Sellers", "Platform avg review", "neutral"),
    ("Sellers", "Elite top performers", "positive"),
    ("Sellers", "High cancellation", "negative"),
    ("Sellers", "Undermonetised quality", "warning"),
    ("Payment & Credit Risk", "Credit card share", "neutral"),
    ("Payment & Credit Risk", "Avg instalments", "neutral"),
    ("Payment & Credit Risk", "High risk exposure", "negative"),
    ("Payment & Credit Risk", "Paid in full orders", "positive"),
)
# ---------------------------------------------------------------------------
