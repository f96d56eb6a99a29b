"""normlens: lexical-norms analytics expressed as Spark DataFrame plans."""

from normlens.spec import DEFAULT_SPEC, Band, NormSpec

__all__ = ["DEFAULT_SPEC", "Band", "NormSpec"]
