"""lodeseek: hybrid vector / keyword retrieval as ordinary Spark plans."""

from lodeseek.plans.collection import Collection

__all__ = ["Collection"]
__version__ = "0.1.0"
