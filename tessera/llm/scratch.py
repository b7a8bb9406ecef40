"""Tables written between the steps of a job, in the folder that the cluster shares."""

from __future__ import annotations

from tessera.sources.tables import new_path, removed
from tessera.sources.tables import written as materialize

__all__ = ["materialize", "new_path", "removed"]
