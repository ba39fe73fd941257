"""All registered queries; importing an area registers what it holds."""

from . import answering, corpus, curation, federation, relating, scoring, search, storage  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
