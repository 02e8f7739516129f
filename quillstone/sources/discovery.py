"""Folders of sequencing runs: which matrices there are, of which samples, and all of them as one table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.sources.tables import market_matrix

#: The files of a matrix folder, each plain or with .gz.
PARTS = {"matrix": ("matrix.mtx",), "features": ("features.tsv", "genes.tsv"), "barcodes": ("barcodes.tsv",)}
#: Folder names that name no sample.
GENERIC = frozenset("count multi outs filtered_feature_bc_matrix raw_feature_bc_matrix filtered_gene_bc_matrices raw_gene_bc_matrices".split())


@dataclass(frozen=True)
class Candidate:
    """A matrix that can be read: its files, what it holds and whose it is."""

    path: str
    kind: str
    state: str
    sample: str
    sample_level: bool
    depth: int
    files: tuple[tuple[str, str], ...] = ()

    @property
    def rank(self) -> tuple:
        """Sample folders first, then filtered before unknown before raw, text before HDF5, what lies higher, and the name."""
        return (not self.sample_level, ("filtered", "unknown", "raw").index(self.state), self.kind != "mtx", self.depth, self.path)


def sample_of(path: str) -> tuple[str, bool]:
    """The sample that a path names, and whether its layout says so."""
    parts = [p for p in path.split("/") if p]
    low = [p.lower() for p in parts]
    if "per_sample_outs" in low and (at := low.index("per_sample_outs") + 1) < len(parts):
        return parts[at], True
    if "outs" in low and (at := low.index("outs")) > 0:
        return parts[at - 1], False
    for name in reversed(parts[:-1] if low and low[-1].endswith(".h5") else parts):
        if name.lower() not in GENERIC and not name.lower().endswith(("_filtered_feature_bc_matrix", "_raw_feature_bc_matrix")):
            return name, False
    return "sample", False


def _state(path: str) -> str:
    words = re.split(r"[^a-z0-9]+", path.lower())
    return "filtered" if "filtered" in words else "raw" if "raw" in words else "unknown"


def discover(path: str) -> tuple[list[Candidate], list[str]]:
    """Candidates below a path (a folder or an HDF5 file, local or by URI), best first, and a line on each and on what is incomplete."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.rstrip("/"))
    top = system.get_file_info(root)
    if top.type == fs.FileType.NotFound:
        return [], [f"no such path: {root}"]
    files = [top] if top.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    base = root.rsplit("/", 1)[0] if top.type == fs.FileType.File else root
    found: list[Candidate] = []
    said: list[str] = []
    folders: dict[str, dict[str, str]] = {}

    def add(place: str, kind: str, parts: tuple = ()) -> None:
        sample, level = sample_of(place)
        depth = len([p for p in place.removeprefix(base).split("/") if p])
        found.append(Candidate(place, kind, _state(place), sample, level, depth, parts))
        said.append(f"{kind} [{found[-1].state}, sample {sample!r}]: {place}")

    for f in sorted(files, key=lambda f: f.path):
        folder, name = f.path.rsplit("/", 1)
        if "feature_bc_matrix" in name.lower() and name.lower().endswith(".h5"):
            add(f.path, "h5")
        for part, names in PARTS.items():
            if name.lower().removesuffix(".gz") in names:
                folders.setdefault(folder, {}).setdefault(part, f.path)
    for folder, parts in sorted(folders.items()):
        if missing := [part for part in PARTS if part not in parts]:
            said.append(f"incomplete, without {', '.join(missing)}: {folder}")
        else:
            add(folder, "mtx", tuple(sorted(parts.items())))
    if not found and not said:
        said.append(f"no matrix below {root}")
    return sorted(found, key=lambda c: c.rank), said


def chosen(candidates: list[Candidate]) -> list[Candidate]:
    """The best candidate of each sample; those of sample folders alone where there are some."""
    layout = [c for c in candidates if c.sample_level] or candidates
    best: dict[str, Candidate] = {}
    for c in layout:
        best.setdefault(c.sample, c)
    return list(best.values())


def _h5(spark: SparkSession, candidate: Candidate) -> tuple[DataFrame, DataFrame]:
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError(f"{candidate.path}: reading HDF5 needs h5py") from e
    with h5py.File(candidate.path, "r") as f:
        m = f["matrix"]
        cells, genes = ([x.decode() for x in m[k][:]] for k in ("barcodes", "features/id"))
        symbols, indptr = [x.decode() for x in m["features/name"][:]], m["indptr"][:]
        rows = [(f"{candidate.sample}_{c}", genes[g], float(v)) for k, c in enumerate(cells) for g, v in zip(m["indices"][indptr[k] : indptr[k + 1]], m["data"][indptr[k] : indptr[k + 1]], strict=True)]
    return spark.createDataFrame(rows, "cell string, gene string, value double"), spark.createDataFrame(list(zip(genes, symbols, strict=True)), "gene string, symbol string")


def _features(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    return spark.read.text(path).select(f[0].alias("gene"), F.coalesce(F.try_element_at(f, F.lit(2)), f[0]).alias("symbol"))


def unique(features: DataFrame, order: str = "gene") -> DataFrame:
    """Adds name to features: a gene that comes again gets -1, -2 and so on, in the order of its symbols."""
    w = Window.partitionBy(order).orderBy("symbol")
    n = F.row_number().over(w) - 1
    return features.withColumn("name", F.when(n > 0, F.concat_ws("-", order, n.cast("string"))).otherwise(F.col(order)))


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cell, gene, value) of all chosen matrices below path, absent genes 0, cells as sample_barcode; and (gene, symbol), the first symbol that a sample gives."""
    candidates, said = discover(path)
    if not candidates:
        raise FileNotFoundError("; ".join(said))
    values, names = [], []
    for k, c in enumerate(chosen(candidates)):
        parts = dict(c.files)
        v, f = _h5(spark, c) if c.kind == "h5" else (market_matrix(spark, parts["matrix"], parts["features"], parts["barcodes"], c.sample), _features(spark, parts["features"]))
        values.append(v)
        names.append(f.withColumn("k", F.lit(k)))
    expr, genes = values[0], names[0]
    for v, f in zip(values[1:], names[1:], strict=True):
        expr, genes = expr.unionByName(v), genes.unionByName(f)
    first = genes.where("symbol is not null and symbol != ''").groupBy("gene").agg(F.min_by("symbol", F.struct("k", "symbol")).alias("symbol"))
    return expr, genes.select("gene").distinct().join(first, "gene", "left").withColumn("symbol", F.coalesce("symbol", "gene"))
