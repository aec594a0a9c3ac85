"""Column-level building blocks (no UDFs)."""
from routekit.functions.geodesy import *  # noqa: F401,F403
from routekit.functions.plane import *  # noqa: F401,F403
from routekit.functions.rules import *  # noqa: F401,F403
from routekit.functions.text import *  # noqa: F401,F403
