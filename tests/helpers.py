"""What several tests use."""

import time


def rows_of(frame) -> list[tuple]:
    """Comparable rows of a pandas frame, columns by name."""
    def plain(v):
        if v is None or v != v:
            return "null"
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


def until(query, done, seconds: float = 60.0) -> None:
    """Wait for done() while a streaming query runs, then stop it; queries with timers go on by themselves."""
    end = time.time() + seconds
    try:
        while time.time() < end and query.isActive and not done():
            time.sleep(0.3)
    finally:
        query.stop()
