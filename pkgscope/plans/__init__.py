"""Query plans: each module registers named queries with their oracle SQL."""

from pkgscope.plans import q_catalog, q_chainmatch, q_diff, q_entity, q_files, q_impact, q_match, q_pairs, q_reports, q_runtime, q_source, q_sources, q_stream, q_tables, q_tree, q_usage, q_versions  # noqa: F401
from pkgscope.plans.registry import ORACLES, QUERIES  # noqa: F401
