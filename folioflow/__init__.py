"""Layout-aware translation of document corpora as ordinary Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from folioflow.config import AdmissionRules, Endpoint, Quota, TranslationConfig
from folioflow.plans.corpus import translate_blocks, translate_documents, translate_pages

# Functions of this package travel with the job, so workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "AdmissionRules", "Endpoint", "Quota", "TranslationConfig",
    "translate_blocks", "translate_documents", "translate_pages",
]
