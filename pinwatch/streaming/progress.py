"""Figures that a stream observes of what it writes, gathered per trigger without another pass."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class ObservedFigures(StreamingQueryListener):
    """Keeps the observed metrics of one name, a dictionary for each trigger that had rows."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.figures: list[dict[str, int]] = []

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.figures.append(row.asDict())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
