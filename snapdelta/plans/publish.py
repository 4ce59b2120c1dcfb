"""Publishing a run: delta lines, manifest, latest alias and success pointer."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.text import csv_cell, ref
from snapdelta.operators.diff import delta_counts
from snapdelta.operators.envelope import canonical_json, index_line
from snapdelta.operators.gates import split_ops
from snapdelta.plans.files import Files
from snapdelta.spec import Output


@dataclass(frozen=True)
class Manifest:
    """What a run published. Paths of data are folders of part files."""

    run_id: str
    connector_id: str
    started_at: str
    completed_at: str
    manifest_path: str
    upserts_path: str | None = None
    import_upserts_path: str | None = None
    deletes_path: str | None = None
    csv_path: str | None = None
    upserts_count: int = 0
    deletes_count: int = 0
    watermark: str | None = None

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def moment_text(moment: datetime) -> str:
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")


def _base(output: Output, connector_id: str) -> str:
    return f"{output.root.rstrip('/')}/connectors/{output.prefix.strip('/') or connector_id}"


def _write_delta(delta: DataFrame, folder: str) -> dict[str, str]:
    upserts, deletes = split_ops(delta)
    paths = {
        "upserts_path": f"{folder}/upserts.ndjson",
        "import_upserts_path": f"{folder}/upserts.index.ndjson",
        "deletes_path": f"{folder}/deletes.ndjson",
    }
    lines = (canonical_json(upserts), index_line(upserts), canonical_json(deletes))
    for path, frame in zip(paths.values(), lines):
        frame.write.mode("overwrite").text(path)
    return paths


def _write_rows(cells: DataFrame, folder: str) -> dict[str, str]:
    path = f"{folder}/rows.csv"
    writer = cells.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return {"csv_path": path}


def _copy_lines(spark, paths: dict[str, str], folder: str) -> dict[str, str]:
    """The lines of published artifacts under another folder, without computing them again."""
    copies = {name: f"{folder}/{path.rsplit('/', 1)[1]}" for name, path in paths.items()}
    for name, path in paths.items():
        spark.read.option("lineSep", "\n").schema("value string").text(path).write.mode("overwrite").option("lineSep", "\n").text(copies[name])
    return copies


def _publish(frame, write, output, manifest: Manifest) -> Manifest:
    """Data of the run, its manifest, the alias where wanted, and then the pointer.

    An alias is a folder of its own under ``latest``, so readers of the one before are not disturbed; the pointer names the
    new one once it is whole. The alias before it is kept for them, older ones are removed.
    """
    files = Files(frame.sparkSession)
    base = _base(output, manifest.connector_id)
    run = f"{base}/runs/{manifest.run_id}"
    paths = write(frame, run)
    manifest = replace(manifest, manifest_path=f"{run}/manifest.json", **paths)
    files.write(manifest.manifest_path, manifest.text())
    pointed = manifest
    if output.publish_latest_alias:
        latest = f"{base}/latest"
        before = files.names(latest)
        alias = f"{latest}/{manifest.run_id}"
        # Files with a header cannot be copied line by line, since a task may hold a file's end only.
        copied = write(frame, alias) if "csv_path" in paths else _copy_lines(frame.sparkSession, paths, alias)
        pointed = replace(manifest, manifest_path=f"{alias}/manifest.json", **copied)
        files.write(pointed.manifest_path, pointed.text())
    files.write(f"{base}/state/latest_success.json", pointed.text())
    if output.publish_latest_alias:
        last = json.loads(files.read(f"{latest}/current.json"))["run_id"] if "current.json" in before else None
        files.write(f"{latest}/current.json", json.dumps({"run_id": manifest.run_id}))
        for name in before:
            if name not in ("current.json", last, manifest.run_id):
                files.remove(f"{latest}/{name}")
    return manifest


def publish(
    delta: DataFrame,
    output: Output,
    connector_id: str,
    run_id: str,
    watermark: str | None,
    started_at: datetime,
    completed_at: datetime,
    counts: tuple[int, int] | None = None,
) -> Manifest:
    """Publish a delta of canonical documents.

    ``delta`` is read several times (three kinds of lines, and its ``counts`` of upserts and deletes where they are not given), so
    give a table that was written, as ``plans.run`` does, not the plan that computes it.
    """
    upserts, deletes = counts or delta_counts(delta).first()
    manifest = Manifest(
        run_id=run_id,
        connector_id=connector_id,
        started_at=moment_text(started_at),
        completed_at=moment_text(completed_at),
        manifest_path="",
        upserts_count=upserts,
        deletes_count=deletes,
        watermark=watermark,
    )
    return _publish(delta, _write_delta, output, manifest)


def csv_rows(rows: DataFrame) -> DataFrame:
    """Every column as the text of a CSV cell."""
    return rows.select(*[csv_cell(ref(f.name), f.dataType).alias(f.name) for f in rows.schema.fields])


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """Frames under one header: columns in first-seen order, absent ones null."""
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame, allowMissingColumns=True)
    return rows


def publish_csv(
    rows: DataFrame,
    output: Output,
    connector_id: str,
    run_id: str,
    watermark: str | None,
    started_at: datetime,
    completed_at: datetime,
) -> Manifest:
    """Publish raw rows as CSV part files, each with the header. All rows count as upserts."""
    manifest = Manifest(
        run_id=run_id,
        connector_id=connector_id,
        started_at=moment_text(started_at),
        completed_at=moment_text(completed_at),
        manifest_path="",
        upserts_count=rows.agg(F.count(F.lit(1))).first()[0],
        watermark=watermark,
    )
    return _publish(csv_rows(rows), _write_rows, output, manifest)
