"""Errors that callers may tell apart."""


class FrameloomError(Exception):
    """Any error of this package."""


class InvalidParams(FrameloomError, ValueError):
    """Parameters of a source, processor or sink that cannot be used."""


class ManifestError(FrameloomError, ValueError):
    """A manifest that cannot be parsed or breaks a rule."""


class UnknownName(FrameloomError, KeyError):
    """A name that no registry has."""


class DuplicateName(FrameloomError, ValueError):
    """A name that a registry already has."""


class SinkError(FrameloomError, OSError):
    """Frames that a sink cannot hold."""


class GeneratorNotFound(UnknownName):
    """A generator that no registry has."""


class GenerationError(FrameloomError, RuntimeError):
    """A generator that failed while it ran."""


class SerializationError(FrameloomError, ValueError):
    """Bytes or text that do not hold what they should."""


class PipelineError(FrameloomError, RuntimeError):
    """A processor that cannot take the frames it is given."""


class ConfigError(FrameloomError, ValueError):
    """A setting of a run, such as its log level, that cannot be used."""
