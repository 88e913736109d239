"""Imports every query module so the registry is complete."""

from . import q_samples  # noqa: F401
from . import q_schema  # noqa: F401
from . import q_calls  # noqa: F401
from . import q_catalog  # noqa: F401
from . import q_requests  # noqa: F401
from . import q_bindings  # noqa: F401
from . import q_corpus  # noqa: F401
from . import q_artefacts  # noqa: F401
