"""ANSI SQL that states each registered query independently, for DuckDB.

``STATEMENTS`` maps a query name to its SQL over the model tables; ``statement`` puts the
definitions of those tables, over the star tables, in front of it.
"""

from __future__ import annotations

from sql_oracle.lines import LINES
from sql_oracle.model import MODEL
from sql_oracle.quality import QUALITY
from sql_oracle.reviews import REVIEWS
from sql_oracle.sheets import SHEETS
from sql_oracle.sla import SLA

STATEMENTS = {**QUALITY, **SLA, **REVIEWS, **SHEETS, **LINES}

# Whatever way the tables are laid out, kept or published, results are the same.
STATEMENTS |= {
    "s6_refreshed_months": STATEMENTS["q05b_month_sheet"],
    "s7_published_states": STATEMENTS["q05c_state_sheet"],
    "j2_bucketed_months": STATEMENTS["q05b_month_sheet"],
    "x2_bucketed_handover": STATEMENTS["x2_seller_handover"],
    "s2_loaded_payments": """
        SELECT payment_type, count(*) AS payments, CAST(max(payment_installments) AS INTEGER) AS installments,
               CAST(sum(payment_cents) AS BIGINT) / 100.0 AS paid FROM m_payments GROUP BY payment_type""",
    "s2_rejected_payments": """
        SELECT 'payment_sequential' AS column_name, 'first' AS value, 'not int' AS reason, count(*) AS faults
        FROM m_payments WHERE payment_installments = 5
        UNION ALL SELECT 'payment_value', '1.2.3', 'not decimal(10,2)', count(*) FROM m_payments WHERE payment_installments = 7""",
    "p5_clustered_months": """
        SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS purchase_month, order_status, count(*) AS orders_count
        FROM m_orders WHERE order_purchase_timestamp >= TIMESTAMP '1997-12-01' AND order_purchase_timestamp < TIMESTAMP '1998-05-01'
        GROUP BY ALL""",
}


def statement(name: str) -> str:
    """Complete SQL of one query."""
    body = STATEMENTS[name].strip()
    joint = ",\n" if body[:4].upper() == "WITH" else "\n"
    return f"WITH {MODEL}{joint}{body[4:].strip() if joint != chr(10) else body}"
