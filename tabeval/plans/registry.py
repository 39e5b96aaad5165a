"""Import every module that registers queries, so the registry is complete."""

from tabeval.plans import queries  # noqa: F401
from tabeval.plans import q_profile  # noqa: F401
from tabeval.plans import q_prep  # noqa: F401
from tabeval.plans import q_explain  # noqa: F401
from tabeval.plans import q_models  # noqa: F401
from tabeval.plans import q_scale  # noqa: F401
from tabeval.plans import q_sources  # noqa: F401
from tabeval.plans import q_trees  # noqa: F401
