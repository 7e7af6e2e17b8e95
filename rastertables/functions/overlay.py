"""Colours and alpha of mask overlays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rastertables import params as P


def overlay_alpha(alpha: Column, multiplier: float = P.OVERLAY_ALPHA_MULTIPLIER) -> Column:
    """Weak alpha vanishes, the rest is dimmed and kept within a byte."""
    dimmed = F.least(F.lit(255), F.floor(alpha * F.lit(multiplier)).cast("int"))
    return F.when(alpha < P.OVERLAY_ALPHA_FLOOR, F.lit(0)).otherwise(dimmed)


def channel(color: Column, index: int) -> Column:
    """Red (0), green (1) or blue (2) of a six-digit hex colour as an integer."""
    return F.conv(F.substring(color, 2 * index + 1, 2), 16, 10).cast("int")


def standardised(grey: Column) -> list[Column]:
    """A grey byte as three standardised channels of the model input."""
    return [
        ((grey / F.lit(255.0)) - F.lit(mean)) / F.lit(std)
        for mean, std in zip(P.CHANNEL_MEAN, P.CHANNEL_STD)
    ]
