"""Code-corpus knowledge graphs as Spark jobs: many repositories, one set of tables keyed by ``repo_id``."""

from lodemap.session import get_session

__all__ = ["get_session"]
