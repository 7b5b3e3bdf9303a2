"""The boundary to binary codecs: a codec is a function of one file's bytes, its outcome a row; a failure is a row too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: What a codec gives back: kind, candidate bytes (None: no candidate), images changed, valid, why not.
Codec = Callable[[str, bytes], Iterator[tuple[str, bytes | None, int, bool, str]]]
_FACTS = "path string, idx int, kind string, size bigint, images_changed bigint, valid boolean, failed boolean, validation_reason string, sha256 string, content binary"


def candidates(files: DataFrame, codec: Codec, keep_content: bool = True) -> DataFrame:
    """Runs a codec over files (path, content) in the tasks: a row for each candidate, in order.

    A codec that raises gives one row with failed set, so one file never fails the run. The rows are the facts that the rules and
    choices of tessera.operators work on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        names = ["path", "idx", "kind", "size", "images_changed", "valid", "failed", "validation_reason", "sha256", "content"]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    for i, (kind, data, changed, valid, why) in enumerate(codec(path, content)):
                        size, sha = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                        rows.append((path, i, kind, size, changed, valid, False, why, sha, data if keep_content else None))
                except Exception as e:  # noqa: BLE001  the codec isn't ours
                    rows.append((path, len(rows), "error", None, 0, False, True, f"{type(e).__name__}: {e}"[:500], None, None))
            yield pd.DataFrame(rows, columns=names).astype({"size": "Int64"})

    return files.select("path", "content").mapInPandas(run, _FACTS)


def deflate(path: str, content: bytes) -> Iterator[tuple[str, bytes | None, int, bool, str]]:
    """A codec that needs nothing but the standard library: the content deflated, checked by inflating it again."""
    import zlib

    for level, kind in ((6, "lossless"), (9, "other")):
        data = zlib.compress(content, level)
        yield kind, data, 1, zlib.decompress(data) == content, ""
