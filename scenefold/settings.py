"""Default parameters. These are fixed values of the data contract."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class WindowSettings:
    size: int = 12
    overlap: int = 3


@dataclass(frozen=True)
class BackprojectionSettings:
    minimum_confidence: float = 1.0
    stride: int = 1
    radius_pixels: float = 1.0


@dataclass(frozen=True)
class DecodeSettings:
    width: int = 504
    height: int = 336
    frames_per_second: float = 8.0
    maximum_frames: int = 1800


@dataclass(frozen=True)
class KeyframeSettings:
    minimum_gap_seconds: float = 0.4
    maximum_gap_seconds: float = 0.6
    minimum_novelty: float = 0.015
    minimum_sharpness: float = 0.012


@dataclass(frozen=True)
class SeamGate:
    minimum_correspondences: int = 50
    minimum_inlier_ratio: float = 0.6
    maximum_normalized_rms: float = 1.0
    minimum_scale: float = 1e-3
    maximum_scale: float = 1e3


@dataclass(frozen=True)
class LoopSettings:
    """Revisit search in units of the median surfel radius."""

    minimum_window_gap: int = 3
    centre_distance_radii: float = 80.0
    minimum_forward_cosine: float = 0.5
    match_distance_radii: float = 4.0
    minimum_correspondences: int = 50
    minimum_inlier_ratio: float = 0.7
    maximum_rms_radii: float = 2.0
    information: float = 1.0


@dataclass(frozen=True)
class RelativeLoopSettings:
    """Revisit search of the relative profile, in scene units."""

    minimum_window_gap: int = 3
    maximum_centre_distance: float = 3.0
    minimum_forward_cosine: float = 0.3
    match_distance: float = 0.30
    minimum_pairs: int = 150
    information: float = 5.0


@dataclass(frozen=True)
class IcpSettings:
    maximum_iterations: int = 30
    maximum_distance: float = 0.10
    huber_delta: float = 0.05
    normal_radius: float = 0.15
    minimum_correspondences: int = 20
    rank_tolerance: float = 1e-3
    step_tolerance: float = 1e-7
    relative_rmse: float = 1e-6


@dataclass(frozen=True)
class PoseGraphSettings:
    maximum_iterations: int = 50
    initial_damping: float = 1e-4
    relative_cost: float = 1e-10
    difference_step: float = 1e-6
    # A capture holds at most 1,800 frames, hence at most 200 windows of 12/3.
    maximum_nodes: int = 512


@dataclass(frozen=True)
class TsdfSettings:
    voxel_size: float | None = None
    voxel_fraction: float = 0.004
    degenerate_voxel: float = 0.03
    truncation_voxels: float = 4.0
    normal_radius: float | None = None
    normal_radius_voxels: float = 2.5
    minimum_hits: int = 2
    output_radius_voxels: float = 0.6
    minimum_observations: int = 8


@dataclass(frozen=True)
class GlobalFitSettings:
    minimum_cameras: int = 6
    maximum_normalized_rms: float = 0.15


@dataclass(frozen=True)
class FrameGlobalSettings:
    minimum_scale_samples: int = 12
    maximum_held_out_error: float = 0.20
    maximum_track_error_px: float = 2.5
    minimum_frame_coverage: float = 0.85
    smoothing_radius: int = 2
    neighbour_log_error: float = 0.20
    neighbour_minimum: int = 1
    neighbour_radius: int = 2
    maximum_observations: int | None = None  # a hash sample of so many points, only on request


@dataclass(frozen=True)
class ArchitectureSettings:
    maximum_source_points: int | None = None  # a stride sample of so many points, only on request
    maximum_planes: int = 12
    plane_distance_fraction: float = 0.003
    minimum_plane_support: int = 900
    trials_per_plane: int = 256
    cell_size_fraction: float = 0.0035
    minimum_cell_support: int = 2


@dataclass(frozen=True)
class PreviewSettings:
    budget: int = 4_000_000
    grid: int = 64
    chunk_rows: int = 50_000


# Name of the hold-out split hashed with every track id. Fixed value.
TRACK_FOLD = "sha256-track-id-fold/v1"


@dataclass(frozen=True)
class CalibrationSettings:
    minimum_train: int = 12
    minimum_held_out: int = 6
    maximum_held_out_error: float = 0.20
    maximum_overlap_p95: float = 0.22
    minimum_frame_coverage: float = 0.85
    confidence_percentile: float = 40.0
    stride: int = 2
    batch_size: int = 16
    batch_overlap: int = 4
