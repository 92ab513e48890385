"""Column functions over spans, text and check digits."""

from spanforge.functions.columns import *  # noqa: F403
from spanforge.functions import display  # noqa: F401
