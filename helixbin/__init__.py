"""Sequence binning on Spark: banks, feature models, reduction, mixtures and iterative extraction."""

__version__ = "0.2.0"
__citation__ = "helixbin, a Spark engine for sequence binning and training-data preparation"

_PUBLIC = {
    "BankSpec": "operators.bank",
    "build": "operators.bank",
    "KmerModel": "models",
    "DistanceModel": "models",
    "WordVectorModel": "models",
    "CoverageModel": "models",
    "CodingDensityModel": "models",
    "Store": "sources.tables",
    "Extraction": "plans.pipeline",
    "characterize": "plans.pipeline",
    "extract": "plans.pipeline",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    """Public names are loaded when they are first used, so that workers import no more than they need."""
    if name in _PUBLIC:
        from importlib import import_module

        return getattr(import_module(f".{_PUBLIC[name]}", __name__), name)
    raise AttributeError(name)
