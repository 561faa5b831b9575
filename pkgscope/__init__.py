"""pkgscope: package-API analytics as Spark jobs.

Catalogue tables (entities, members, aliases, releases, requirements),
client access chains, matching, version diffs, impact, dependency
violations and reports, all expressed with DataFrame / SQL operators.
Only Python source parsing runs in Python workers (``mapInPandas``).
"""

__all__ = ["session"]
