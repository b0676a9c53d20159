"""Gap segmentation of a stream of segments, beyond batch.

The state of a document is its last end and paragraph number.  Within a batch segments are put in order;
a segment that arrives in a later batch continues from the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from murmur.functions.rules import PARAGRAPH_GAP_S

OUT = "doc_id long, seg_idx long, start double, end double, para_idx long"


def gap_segments_stream(segments: DataFrame, gap: float = PARAGRAPH_GAP_S) -> DataFrame:
    """segments: a stream of (doc_id, seg_idx, start, end)."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches]).sort_values("seg_idx").reset_index(drop=True)
        end, para = state.get if state.exists else (None, 0)
        out = []
        for s, e in zip(rows["start"], rows["end"]):
            if end is not None and s - end >= gap:
                para += 1
            out.append(para)
            end = e
        state.update((float(end), int(para)))
        rows["para_idx"] = out
        yield rows[["doc_id", "seg_idx", "start", "end", "para_idx"]]

    return segments.groupBy("doc_id").applyInPandasWithState(step, OUT, "end double, para long", "append", GroupStateTimeout.NoTimeout)
