"""Models."""
import os, sys
import numpy as np
from .base import Base, other as o


class Model(Base):
    """A model."""

    @property
    def size(self) -> int:
        return helper(self.rows).count()

    class Inner:
        pass


class Other(pkg.Base, metaclass=Meta):
    def size(self):
        'Single quoted.'
        return 1


LIMIT = 1000 * 1000 * 1000
_private = 1
__version__ = "1"
x: int = 3
