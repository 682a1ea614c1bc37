"""Lineage cuts in the shared folder and size-checked broadcasts, as the rest of the library has them."""

from ..sources.arrow_fs import filesystem
from ..sources.shared import BROADCAST_ROWS, discard, parts, shared_dir, shared_path, small, temporary, written

__all__ = ["BROADCAST_ROWS", "discard", "filesystem", "parts", "shared_dir", "shared_path", "small", "temporary", "written"]
