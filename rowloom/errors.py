"""What the library raises."""


class ModelError(Exception):
    """Base of all errors of this library."""


class LanguageError(ModelError):
    """A formula that doesn't parse or isn't in the language."""


class SchemaError(LanguageError):
    """A specification with a wrong shape or name."""


class DimensionError(LanguageError):
    """A formula whose dimensions don't fit where it stands."""


class DataError(ModelError):
    """Tables that don't fit their declarations."""


class LayoutError(ModelError):
    """A saved result or archive that can't be read."""


class SinkError(ModelError):
    """A sink that can't take a construct of the model."""


class NoSolutionError(ModelError):
    """A read of a solution that isn't there."""
