"""maskloom: segmentation-dataset analytics on PySpark DataFrames and streams."""

from maskloom.session import build_session, cut

__all__ = ["build_session", "cut"]
