"""Physical-plan helpers: pre-aggregation, skew-safe top-k, lineage cuts.
Everything else is left to Catalyst and AQE."""

from rentscope.plans.lineage import cut_lineage, stored
from rentscope.plans.preagg import RENTAL_COLS, customer_rollup, films, paid_rentals, payers, payments_per_rental, rental_lines
from rentscope.plans.topk import top_k_per_group

__all__ = ["RENTAL_COLS", "cut_lineage", "customer_rollup", "films", "paid_rentals", "payers", "payments_per_rental", "rental_lines", "stored", "top_k_per_group"]
