"""capaflow: shipment capacity planning expressed as Spark DataFrame jobs.

Shipments wait in an append-only ledger and are allocated once a week
against three nested limits (sender guarantee, driver capacity per postal
code and province, print capacity). Every limit check is a running
position (``row_number``-like rank) compared with a residual obtained by a
join, so the whole week of every province is planned by one Spark job.
"""

from capaflow.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
