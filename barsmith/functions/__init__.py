"""Column-expression functions (JVM side, no Python UDFs)."""
from barsmith.functions.scalars import *  # noqa: F401,F403
from barsmith.functions.timeutil import *  # noqa: F401,F403
