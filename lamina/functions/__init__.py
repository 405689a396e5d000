"""Lane functions as Column expressions. Every function takes the type's tag; masks are boolean columns.

A `mask` with `keep` (a column) passes that column through where the mask is off; without it, zero.
"""

from lamina.functions.arithmetic import *  # noqa: F403
from lamina.functions.bits import *  # noqa: F403
from lamina.functions.compare import *  # noqa: F403
from lamina.functions.convert import *  # noqa: F403
from lamina.functions.lanes import *  # noqa: F403
from lamina.functions.masks import *  # noqa: F403
from lamina.functions.reduce import *  # noqa: F403
