"""The engine's exceptions."""


class EngineError(ValueError):
    """Base of all errors about data or configuration."""


class DataContractError(EngineError):
    """A table breaks the contract of its schema."""


class CacheError(EngineError):
    """A cached table is missing, damaged or incompatible."""


class EvaluationDataError(EngineError):
    """Evaluation annotations break their format."""


class ConfigError(EngineError):
    """A configuration value is invalid."""
