"""ZIP containers as rows of parts, relationships as edges. The standard library reads them, one file a row, within bounds."""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of a container: parts, bytes of a part, bytes of all parts.
MOST_PARTS, MOST_PART, MOST_ALL = 10_000, 64 << 20, 512 << 20
_PARTS = "part string, size bigint, sha256 string, content binary, error string"
_EDGES = "source string, id string, type string, target string, external boolean, error string"


def _open(data: bytes) -> list[zipfile.ZipInfo]:
    infos = zipfile.ZipFile(io.BytesIO(data)).infolist()
    names = [i.filename for i in infos]
    if len(infos) > MOST_PARTS or sum(i.file_size for i in infos) > MOST_ALL or any(i.file_size > MOST_PART for i in infos):
        raise ValueError("container too large")
    if len({n.casefold() for n in names}) != len(names):
        raise ValueError("part names repeat")
    if any(n.startswith("/") or "\\" in n or ".." in n.split("/") for n in names):
        raise ValueError("unsafe part name")
    return infos


@F.udtf(returnType=_PARTS)
class ZipParts:
    """A row for each part of a container; one row with an error if it can't be read."""

    def eval(self, data: bytes):
        import hashlib

        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in _open(data):
                    content = z.read(i)
                    yield i.filename, len(content), hashlib.sha256(content).hexdigest(), content, None
        except (zipfile.BadZipFile, ValueError, OSError, TypeError) as e:
            yield None, None, None, None, str(e) or type(e).__name__


@F.udtf(returnType=_EDGES)
class Relationships:
    """A row for each relationship of a container, its target resolved against the part that has it."""

    def eval(self, data: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in _open(data):
                    folder, name = posixpath.split(i.filename)
                    if posixpath.basename(folder) != "_rels" or not name.endswith(".rels"):
                        continue
                    base = posixpath.dirname(folder)
                    for r in ElementTree.fromstring(z.read(i)):
                        target, outside = r.get("Target", ""), r.get("TargetMode") == "External"
                        full = target if outside else target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(base, target))
                        yield posixpath.join(base, name[: -len(".rels")]), r.get("Id"), r.get("Type", "").rpartition("/")[2], full, outside, None
        except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, OSError, TypeError) as e:
            yield None, None, None, None, None, str(e) or type(e).__name__


def parts(files: DataFrame, content: str = "content") -> DataFrame:
    """files (path, content) with a row for each part: path, part, size, sha256, content, error."""
    return files.select("path", F.col(content).alias("_data")).lateralJoin(ZipParts(F.col("_data").outer())).select("path", "part", "size", "sha256", "content", "error")


def relationships(files: DataFrame, content: str = "content") -> DataFrame:
    return files.select("path", F.col(content).alias("_data")).lateralJoin(Relationships(F.col("_data").outer())).select("path", "source", "id", "type", "target", "external", "error")
