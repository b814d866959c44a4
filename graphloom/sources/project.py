"""Project sources: fingerprints of files, manifests, module declarations in source lines."""

from __future__ import annotations

import re
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directories that are never part of a crate's sources (fixed values).
EXCLUDED = ("tests", "examples", "benches")
LARGE_FILE = 10_000  # lines beyond which a file is worth a warning


def line_count(text):
    """Line feeds, plus one for a last line without; 0 for empty text."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(ends + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def fingerprints(files: DataFrame) -> DataFrame:
    """id, path, hash (SHA-256 of the UTF-8 text), line_count of files with id, path and text; null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return files.select("id", "path", F.sha2(text.cast("binary"), 256).alias("hash"), line_count(text).alias("line_count"))


def parse_manifest(text: str, directory: str = "") -> dict:
    """kind (workspace or crate), name, members, dependencies (sorted, distinct), bins of a manifest.

    A workspace section takes precedence; its name is the root package's, the directory's or "workspace".  Raises
    ValueError for a manifest that is neither.
    """
    m = tomllib.loads(text)
    deps = sorted({d for k in ("dependencies", "dev-dependencies", "build-dependencies") for d in m.get(k, {})})
    name = m.get("package", {}).get("name")
    if "workspace" in m:
        return {"kind": "workspace", "name": name or directory.rstrip("/").rpartition("/")[2] or "workspace", "members": m["workspace"].get("members", []), "dependencies": deps, "bins": []}
    if name is None:
        raise ValueError("manifest has neither a workspace nor a package")
    bins = [{"name": b.get("name", name), "path": b.get("path", "src/main.rs")} for b in m.get("bin", [])]
    return {"kind": "crate", "name": name, "members": [], "dependencies": deps, "bins": bins}


def crate_targets(name: str, paths: set[str], bins: list[dict] = ()) -> list[tuple[str, str]]:
    """(name, type) of a crate's targets: library, default binary, further binaries; a library if there is none."""
    out = [(name, "Library")] if "src/lib.rs" in paths else []
    main = "src/main.rs" in paths
    out += [(name, "Binary")] if main else []
    out += [(b["name"], "Binary") for b in bins if not (main and b["path"].replace("\\", "/") == "src/main.rs")]
    return out or [(name, "Library")]


_PATH = re.compile(r'#\[\s*path\s*=\s*"([^"]+)"\s*\]')
_MOD = re.compile(r"(?:pub(?:\s*\([^)]*\))?\s+)?mod\s+([A-Za-z_][A-Za-z0-9_]*)\s*([;{])")


def module_declarations(text: str) -> list[tuple[str, bool, str | None]]:
    """(name, inline, custom path) of every ``mod`` line; a path attribute holds for the next code line only."""
    out, path, comment = [], None, False
    for line in map(str.strip, text.split("\n")):
        if comment:
            comment = "*/" not in line
            continue
        if line.startswith("/*"):
            comment = "*/" not in line
            continue
        if not line or line.startswith("//"):
            continue
        if m := _PATH.match(line):
            path = m[1]
            continue
        if m := _MOD.match(line):
            out.append((m[1], m[2] == "{", path))
            path = None
        elif not line.startswith("#["):
            path = None
    return out


def declared_modules(files: DataFrame) -> DataFrame:
    """path, ord, name, inline, custom_path: the module declarations of files with path and text."""
    schema = pa.schema([("path", pa.string()), ("ord", pa.int64()), ("name", pa.string()), ("inline", pa.bool_()), ("custom_path", pa.string())])

    def run(batches):
        for b in batches:
            rows = [(p, i, *d) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, d in enumerate(module_declarations(t or ""))]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return files.select("path", "text").mapInArrow(run, "path string, ord long, name string, inline boolean, custom_path string")
