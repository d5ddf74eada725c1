"""Forward fill over pages that arrive in order: the last code of each dossier is keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "dossier_id long, page_num long, doc_code string"


def _fill(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, unknown = state.get if state.exists else ("", 0)
    for rows in batches:
        out = []
        for r in rows.sort_values("page_num").itertuples():
            if isinstance(r.detected_code, str) and r.detected_code:
                last = r.detected_code
            elif r.starts and last:
                unknown += 1
                last = f"unknown_{unknown}"
            out.append((key[0], r.page_num, last or "unknown"))
        yield pd.DataFrame(out, columns=["dossier_id", "page_num", "doc_code"])
    state.update((last, unknown))


def forward_fill_stream(pages: DataFrame) -> DataFrame:
    """As ``sequence.forward_fill``, on a stream with dossier_id, page_num, detected_code and starts (a page that opens a document).

    The state of a dossier is its last code and a counter, whatever its length.
    """
    return pages.groupBy("dossier_id").applyInPandasWithState(_fill, OUT, "last string, unknown long", "append", GroupStateTimeout.NoTimeout)
