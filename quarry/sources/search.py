"""Where a library's symbols are looked for: directories in order of priority."""

from __future__ import annotations

import site
import sysconfig
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import files

#: Directories of these names are searched in the library's own folder only.
SHARED = ("site-packages", "lib", "Lib")


def interpreter_directories() -> list[Path]:
    """The driver's standard library and installed packages."""
    found = [sysconfig.get_path("stdlib"), *site.getsitepackages(), site.getusersitepackages(), sysconfig.get_path("purelib")]
    return list(dict.fromkeys(Path(p) for p in found if p))


def directories(root: str, library: str, language: str, interpreter: bool = False) -> list[Path]:
    """Existing directories, the first that holds a symbol answers. For Python: the
    interpreter's (if asked for; executors must see the same paths), those named
    site-packages and lib below the root, the library's folder, ``src``, the root. Else: the
    library's package, all packages, the root."""
    base = Path(root)
    if language == "python":
        named = [p for name in ("site-packages", "lib") for p in sorted(base.rglob(name))]
        found = [*(interpreter_directories() if interpreter else []), *named, base / library, base / "src", base]
    else:
        found = [base / "node_modules" / library, base / "node_modules", base]
    return list(dict.fromkeys(p / library if p.name in SHARED else p for p in found if (p / library if p.name in SHARED else p).is_dir()))


def symbols_of(spark: SparkSession, root: str, library: str, language: str, interpreter: bool = False) -> DataFrame:
    """SYMBOLS rows with dir_rank and relative_path, ranked in the order of directories.

    Each file is read once, below the outermost directory that holds it, and given to every
    directory that holds it."""
    ranked = [(i, str(p.resolve())) for i, p in enumerate(directories(root, library, language, interpreter))]
    outer = [p for _, p in ranked if not any(p != q and p.startswith(q + "/") for _, q in ranked)]
    found = None
    for path in dict.fromkeys(outer):
        own = files.scan_symbols(spark, path, language)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "name string, symbol_type string, line_number int, signature string, file_path string, docstring string, parent string, ordinal int, dir_rank int, relative_path string")
    rows = files.symbols(found)
    held = F.array(*(F.struct(F.lit(i).alias("dir_rank"), F.lit(p + "/").alias("dir")) for i, p in ranked))
    each = rows.withColumn("d", F.explode(F.filter(held, lambda d: F.startswith(F.col("file_path"), d["dir"]))))
    return each.select(*rows.columns, "d.dir_rank", F.expr("substr(file_path, length(d.dir) + 1)").alias("relative_path"))
