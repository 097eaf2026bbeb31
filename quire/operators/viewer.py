"""A viewer's events, replayed: zoom, pan and choice of image after each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.geometry import viewport

#: How far events move the pan.
MOVES = {"left": (-50, 0), "right": (50, 0), "up": (0, -50), "down": (0, 50), "far_up": (0, -200), "far_down": (0, 200)}
#: How far they change the zoom.
ZOOMS = {"zoom_in": 1, "zoom_out": -1}
_STATE = "zoom int, pan_x int, pan_y int, shown int, changed boolean"


class View:
    """The state between events: numbers alone, so that it passes from batch to batch."""

    def __init__(self, container: tuple[int, int], image: tuple[int, int], images: int):
        self.container, self.image, self.images = container, image, images
        self.zoom, self.pan, self.shown = 1, [0, 0], 0

    def _seen(self, side: int) -> np.float32:
        """Pixels of the image that a side of the container shows."""
        fit = min(np.float32(c) / np.float32(i) for c, i in zip(self.container, self.image, strict=True))
        return np.float32(self.container[side]) / (fit * np.float32(self.zoom))

    def limit(self, side: int) -> int:
        """The greatest pan that a move may reach."""
        return max(0, (self.image[side] - min(int(np.floor(self._seen(side) + np.float32(0.5))), self.image[side])) // 2)

    def clamp(self) -> None:
        """Brings the pan back into the image; here the shown size is cut, not rounded."""
        for side in (0, 1):
            room = max(0, int((self.image[side] - int(self._seen(side))) / 2))
            self.pan[side] = max(-room, min(room, self.pan[side]))

    def apply(self, event: str | None) -> bool:
        """Whether the event changed something. A move is refused on an axis where it would pass the limit."""
        before = self.zoom, tuple(self.pan), self.shown
        if event in MOVES:
            for side, by in enumerate(MOVES[event]):
                if by and abs(self.pan[side] + by) <= self.limit(side):
                    self.pan[side] += by
            if tuple(self.pan) == before[1]:
                return False
        elif event in ZOOMS:
            self.zoom = max(1, self.zoom + ZOOMS[event])
            if event == "zoom_out" and self.zoom == before[0]:
                return False
        elif event in ("top", "bottom"):
            edge = self.limit(1) * (1 if event == "bottom" else -1)
            if self.pan[1] == edge:
                return False
            self.pan[1] = edge
        elif event == "reset":
            self.zoom, self.pan = 1, [0, 0]
        elif event in ("next", "previous"):
            self.shown = max(0, min(self.images - 1, self.shown + (1 if event == "next" else -1)))
            return self.shown != before[2]
        else:
            return False
        self.clamp()
        return True


def replay(events: DataFrame, by: Sequence[str], order: Sequence[str], event: str = "event", sizes: Sequence[str] = ("cw", "ch", "iw", "ih"), images: int = 1) -> DataFrame:
    """The rows with ``zoom``, ``pan_x``, ``pan_y``, ``shown``, ``changed`` and ``view``, the viewport after each event.

    Each group's events are met in order, in sorted batches that aren't gathered: the state goes from
    one to the next, so that memory holds one view whatever a group's
    length. The sizes are those of a group's first row. Unknown and null events change nothing.
    """
    schema = T.StructType([*events.schema.fields, *T._parse_datatype_string(_STATE).fields])
    keys = list(by)

    def walk(batches):
        key = view = None
        for pdf in batches:
            found = []
            for values, size, what in zip(pdf[keys].itertuples(index=False, name=None), pdf[list(sizes)].itertuples(index=False, name=None), pdf[event], strict=True):
                if view is None or values != key:
                    key, view = values, View(tuple(size[:2]), tuple(size[2:]), images)
                changed = view.apply(what)
                found.append((view.zoom, *view.pan, view.shown, changed))
            yield pdf.assign(**dict(zip(("zoom", "pan_x", "pan_y", "shown", "changed"), zip(*found, strict=True), strict=True)) if found else {})

    walked = events.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(walk, schema)
    return walked.withColumn("view", viewport(*[F.col(c) for c in (*sizes, "zoom", "pan_x", "pan_y")]))
