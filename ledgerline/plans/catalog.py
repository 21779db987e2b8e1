"""All registered queries over the proxy views, with the SQL they are held against."""

from ledgerline.plans import jobs_coverage, jobs_events, jobs_model, jobs_places, jobs_routes, jobs_rows, jobs_state, jobs_streams  # noqa: F401
from ledgerline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Places, sizes and positions are 32-bit integers in Spark and 64-bit ones in SQL.
INTEGERS = {
    "h2_station_rank": ["place"], "a27_field_mapping": ["size"], "f14_alternatives": ["place"], "e2_fusion_domains": ["sources"], "d8_nearest_within_radius": ["place"], "a2_page_rows": ["pos"], "a5_page_posts": ["pos", "size"],
    "a6_mentions": ["context_size"], "a3_pipe_rows": ["n", "cells"], "c28_page_text": ["size"], "f5_trajectory": ["sequence"], "m6_next_station_hypotheses": ["place"],
}
for _name, _columns in INTEGERS.items():
    ORACLE_SQL[_name] = f"SELECT * REPLACE ({', '.join(f'{c}::INTEGER AS {c}' for c in _columns)}) FROM ({ORACLE_SQL[_name]})"
