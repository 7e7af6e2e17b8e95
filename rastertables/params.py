"""Parameters that change results, and names shared by several modules."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults, prefixes, statuses and stages of the stored tables.
RAW_PREFIX = "raw/"
PROCESSED_PREFIX = "processed/"
TILE_PREFIX = "processed/tiles/"
MASK_PREFIX = "processed/masks/"
EXPORT_PREFIX = "processed/shapefiles/"
STATUS_PREFIX = "processed/status/"
DEFAULT_BUCKET = "satellite-images"
DEFAULT_TOPIC = "raw-images"
DEFAULT_GROUP = "spark-processor"
DEFAULT_MASK_COLOR = "2d6a4f"
FINAL_STATUSES = ("processed", "empty", "skipped")
UNKNOWN_STATUS = "unknown"
DEFAULT_LEVEL = "INFO"
BACKGROUND_EPSILON = 1e-12
CORNER_TOLERANCE = 1e-10
PREVIEW_SIDE = 4096
CONTRAST_QUANTILES = (0.02, 0.98)
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
RENDER_PADDING_RATIO = 0.0015
OVERLAY_ALPHA_MULTIPLIER = 0.72
OVERLAY_ALPHA_FLOOR = 8
IMAGE_VIEW_PAD = 0.15
TILE_VIEW_PAD = 0.12
PROGRESS_STEP = 50


@dataclass(frozen=True)
class SceneParams:
    """Settings of one scene run."""

    tile_size: int = 1000
    min_valid_ratio: float = 0.08
    background_epsilon: float = BACKGROUND_EPSILON
    mask_threshold: int = 128
    min_fill_ratio: float = 0.05
    min_area: float = 0.00001
    merge_masks: bool = False
    gap_cells: int = 0
    gap_degrees: float = 0.0
    device: str = "auto"
    corner_tolerance: float = CORNER_TOLERANCE
