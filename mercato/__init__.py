"""mercato: a Spark-native marketplace analytics engine.

Raw order data (nine landing tables) becomes a star schema (four dimensions and
an order-line fact), four pre-aggregated views and six KPI reports, plus a
guarded ad-hoc SQL surface and batch jobs for access decisions and audit rows.
Everything is expressed with the DataFrame API so Catalyst and AQE plan it.
"""

from mercato.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
