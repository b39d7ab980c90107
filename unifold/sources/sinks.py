"""Writers of canonical and projected profiles."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, omit_nulls: bool = False) -> None:
    """Profiles as JSON lines, written by the executors; the form for results of any size."""
    df.write.mode("overwrite").option("ignoreNullFields", str(omit_nulls).lower()).json(path)


def write_json_array(df: DataFrame, path: str, order: str | None = None, omit_nulls: bool = False) -> int:
    """Profiles as one indented JSON array in a local file; returns their number.

    Rows are fetched partition by partition and written as they come, so the driver never holds
    them all. Nulls are kept unless ``omit_nulls``; non-ASCII characters are escaped.
    """
    rows = df.sort(order) if order else df
    body = [c for c in df.columns if c != order]
    text = rows.select(F.to_json(F.struct(*body), {"ignoreNullFields": str(omit_nulls).lower()}).alias("j"))
    target = Path(path).absolute()
    target.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with target.open("w", encoding="utf-8") as out:
        out.write("[")
        for r in text.toLocalIterator():
            entry = json.dumps(json.loads(r.j), indent=2).replace("\n", "\n  ")
            out.write(("," if n else "") + "\n  " + entry)
            n += 1
        out.write("\n]" if n else "]")
    return n
