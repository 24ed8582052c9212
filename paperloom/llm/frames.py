"""Pandas frames on their way back to the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd

FrameFunction = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def plain(run: FrameFunction) -> FrameFunction:
    """``run`` without its empty frames, whose columns have no usable types."""

    def wrapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in run(frames):
            if len(frame):
                yield frame

    return wrapped
