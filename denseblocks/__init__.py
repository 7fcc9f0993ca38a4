"""denseblocks: dense-block detection in multi-attribute relations on Spark."""

from .config import DEFAULT, Options, local_session
from .relation import Relation, from_columns
from .plans.search import find_blocks, find_block, prepare

__all__ = ["DEFAULT", "Options", "local_session", "Relation", "from_columns", "find_blocks", "find_block", "prepare"]
