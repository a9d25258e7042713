"""Block cubes in .npz files, a file a camera: read as a row per frame and block, and written.

Files are listed and read by Spark, so they may lie in any of its file systems; parsing is by Arrow batches of frames.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "cam string, frame int, ts timestamp_ntz, view int, seg int, edge_corr double, br int, bc int, r double, g double, b double, valid boolean"
ENDING = "_blocks.npz"
#: Rows of an Arrow batch, about.
BATCH_ROWS = 1 << 16


def _parsed(cam: str, content: bytes) -> Iterator[pa.RecordBatch]:
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        rgb, valid, dates, corr = z["rgb"].astype(float), z["valid"], z["dates"].astype("datetime64[us]"), z["edge_corr"].astype(float)
        view = z["view"] if "view" in z.files else np.zeros(len(rgb), int)
        seg = z["seg"] if "seg" in z.files else view
    n, rows, cols = valid.shape
    step = max(1, BATCH_ROWS // max(1, rows * cols))
    for at in range(0, n, step):
        part = slice(at, at + step)
        frame, br, bc = (x.ravel() for x in np.meshgrid(np.arange(at, min(n, at + step)), np.arange(rows), np.arange(cols), indexing="ij"))
        colours = [pa.array(c, pa.float64(), from_pandas=True) for c in rgb[part].reshape(-1, 3).T]  # NaN becomes NULL
        whole = [pa.array(x.astype(np.int32)) for x in (frame, view[frame], seg[frame], br, bc)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([cam] * len(frame)), whole[0], pa.array(dates[frame]), whole[1], whole[2], pa.array(corr[frame]), whole[3], whole[4], *colours, pa.array(valid[part].ravel().astype(bool))],
            [f.split()[0] for f in SCHEMA.split(", ")])


def read_cubes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of files <cam>_blocks.npz with dates, rgb, valid, edge_corr and perhaps view, seg. Cubes without views have view 0."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*" + ENDING).load(folder).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                yield from _parsed(path.rsplit("/", 1)[-1].removesuffix(ENDING), content.as_py())

    return files.mapInArrow(rows, SCHEMA)


def cubes(blocks: DataFrame) -> DataFrame:
    """(cam, content): the file of each camera. blocks: as ``SCHEMA`` says; a camera's frames go to one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = pdf.drop_duplicates("frame").sort_values("frame")
        shape = len(frames), int(pdf["br"].max()) + 1, int(pdf["bc"].max()) + 1
        at = tuple(x.to_numpy() for x in (pdf["frame"].map(dict(zip(frames["frame"], range(len(frames))))), pdf["br"], pdf["bc"]))
        rgb, valid = np.full((*shape, 3), np.nan, np.float32), np.zeros(shape, bool)
        rgb[at], valid[at] = pdf[["r", "g", "b"]].to_numpy(float), pdf["valid"].to_numpy(bool)
        out = io.BytesIO()
        np.savez_compressed(out, dates=frames["ts"].map(lambda t: t.isoformat()).to_numpy(str), rgb=rgb, valid=valid, edge_corr=frames["edge_corr"].to_numpy(float), seg=frames["seg"].to_numpy(int), view=frames["view"].to_numpy(int))
        return pd.DataFrame({"cam": [pdf["cam"].iloc[0]], "content": [out.getvalue()]})

    return blocks.groupBy("cam").applyInPandas(one, "cam string, content binary")


def write_cubes(blocks: DataFrame, folder: str) -> None:
    """Writes each camera's file by the task that made it, complete or not at all, to a folder that pyarrow can reach."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            for cam, content in zip(b.column(0).to_pylist(), b.column(1)):
                part = f"{root}/.{cam}.{id(content)}.part"
                with system.open_output_stream(part) as out:
                    out.write(content.as_py())
                system.move(part, f"{root}/{cam}{ENDING}")
            yield pa.RecordBatch.from_arrays([b.column(0)], ["cam"])

    cubes(blocks).mapInArrow(rows, "cam string").agg(F.count("*")).collect()
