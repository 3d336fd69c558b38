"""Security-log detection as Spark DataFrame transformations."""

from palisade.params import Params
from palisade.plans.pipeline import Detection, detect

__all__ = ["Detection", "Params", "detect"]
__version__ = "0.1.0"
