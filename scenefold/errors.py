"""Failure taxonomy.

Evidence that cannot support a result raises one of these; no operator falls
back to an identity transform or drops rows silently.
"""


class EvidenceError(Exception):
    """Base class of every failure raised by this package."""


class ConfigurationError(EvidenceError):
    """A setting is out of its documented range, or the session lacks one."""


class ScheduleError(EvidenceError):
    """A window schedule cannot be built from these settings."""


class BackprojectionError(EvidenceError):
    """Rasters, calibration and views do not agree."""


class StitchError(EvidenceError):
    """A seam or a loop does not carry enough geometric evidence."""


class PoseGraphError(EvidenceError):
    """A pose graph is malformed or too large for a dense solve."""


class PoseError(EvidenceError):
    """A pose solution or raster manifest violates its contract."""


class FusionError(EvidenceError):
    """Surface fusion has no usable observations."""


class BundleError(EvidenceError):
    """A scene bundle is missing, inconsistent or already present."""


class ArchitectureError(EvidenceError):
    """Plane settings or semantic evidence are invalid."""


class VideoError(EvidenceError):
    """Decoded frames do not match their cache contract."""


class ImportFormatError(EvidenceError):
    """A file does not follow the declared layout."""


class ExportError(EvidenceError):
    """An export would not fit its container."""
