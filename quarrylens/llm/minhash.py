"""Former name of ``near_copies``."""

from .near_copies import drop_near_copies

__all__ = ["drop_near_copies"]
