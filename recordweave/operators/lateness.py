"""Late and out-of-order events: per-period counts that late records correct, closed by a cut-off. SQL only.

Each event falls into a cell (period of happening, revision of arrival): revision 0 holds what was recorded
before the period ended, revision r >= 1 what came in the r-th day after it, both ends of the cut-off included.
Cells are counted, then summed over revisions with a window, which gives every corrected figure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from recordweave.functions.times import ZONED

CUT_OFF_DAYS = 7

_CELLS = """
SELECT id, entity_type, period,
       CASE WHEN rec_us < end_us THEN 0
            ELSE greatest(1, ((rec_us - end_us) + 86399999999) div 86400000000) END AS revision
FROM (
  SELECT id, r.entity_type, unix_micros(try_cast(r.recorded_at AS timestamp)) AS rec_us,
         at_us - pmod(at_us, 86400000000) + 86400000000 AS end_us,
         cast(date_from_unix_date(cast((at_us - pmod(at_us, 86400000000)) div 86400000000 AS int)) AS string) AS period
  FROM (
    SELECT id, min_by(struct(entity_type, recorded_at, at_precision, at), struct(seq, recorded_at)) AS r,
           unix_micros(try_cast(min_by(at, struct(seq, recorded_at)) AS timestamp)) AS at_us
    FROM {events} WHERE id IS NOT NULL AND seq IS NOT NULL GROUP BY id
  )
  WHERE r.at_precision = 'time' AND at_us IS NOT NULL AND r.at RLIKE :zoned AND r.recorded_at RLIKE :zoned
)
WHERE rec_us IS NOT NULL
"""

_TRIANGLE = """
SELECT period, revision, arrived, corrected, revision > {cut_off} AS closed,
       max(CASE WHEN revision <= {cut_off} THEN corrected END) OVER (PARTITION BY period) AS final_count
FROM (
  SELECT period, revision, arrived,
         sum(arrived) OVER (PARTITION BY period ORDER BY revision ROWS UNBOUNDED PRECEDING) AS corrected
  FROM (SELECT period, revision, count(*) AS arrived FROM {cells} GROUP BY period, revision)
)
"""

_LATE = """
SELECT c.id AS event_id, c.period, CASE WHEN t.closed THEN 'dropped' ELSE 'corrects' END AS outcome
FROM {cells} c JOIN {triangle} t ON c.period = t.period AND c.revision = t.revision
WHERE c.revision > 0
"""


def arrival_cells(events: DataFrame) -> DataFrame:
    """(id, entity_type, period, revision) of each distinct event of exact time; its first recording counts.
    Rows without id, seq, a readable time or recording time (an instant names its offset) fall in no cell."""
    return events.sparkSession.sql(_CELLS, {"zoned": ZONED}, events=events)


def arrival_triangle(cells: DataFrame, cut_off_days: int = CUT_OFF_DAYS) -> DataFrame:
    """One row per non-empty cell: arrived, corrected (the period's count after this revision), closed (the cell
    is beyond the cut-off, so it does not enter final_count), final_count (null if nothing came in time)."""
    return cells.sparkSession.sql(_TRIANGLE, cells=cells, cut_off=cut_off_days)


def late_events(events: DataFrame, cut_off_days: int = CUT_OFF_DAYS) -> DataFrame:
    """event_id, period, outcome (corrects or dropped) of every event recorded after its period ended."""
    cells = arrival_cells(events)
    return events.sparkSession.sql(_LATE, cells=cells, triangle=arrival_triangle(cells, cut_off_days))
