"""Connector specs and the checks between their parts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from snapdelta.operators.diff import DELETE_POLICIES
from snapdelta.operators.normalize import Mapping
from snapdelta.sources.csvfiles import CsvOptions

# Modes, source types and the form of a connector name.
MODES = ("sql_pull", "rest_pull", "rest_push", "file_pull")
DATABASES = ("postgres", "mssql", "mysql", "oracle")
LAKE = "lake"
_NAME = re.compile(r"[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?")


class SpecError(ValueError):
    """The spec breaks a rule."""


@dataclass(frozen=True)
class Source:
    """Where rows come from.

    ``type`` is a database (read over JDBC), ``lake`` (tables of the session), ``file`` or ``http``
    (pages that were landed under ``path``).
    """

    type: str
    query: str | None = None
    watermark_field: str | None = None
    path: str | None = None
    glob: str | None = None
    format: str | None = None
    csv: CsvOptions | None = None
    next_cursor_path: str | None = None
    # Name of the file that begins the chain of pages, without its extension.
    first_page: str | None = None
    partition_column: str | None = None
    bounds: tuple[str, str] | None = None
    partitions: int = 1


@dataclass(frozen=True)
class Output:
    """Where artifacts go; ``root`` is a folder that all executors can reach."""

    root: str
    prefix: str = ""
    format: str = "ndjson"
    publish_latest_alias: bool = False


@dataclass(frozen=True)
class Connector:
    name: str
    mode: str
    source: Source
    output: Output
    mapping: Mapping | None = None
    schedule: str | None = None
    delete_policy: str = "auto_delete_missing"
    index: bool = True
    max_delete_ratio: float | None = field(default=None)

    def __post_init__(self):
        broken = [f"{self.name}: {part} {rule}" for part, rule in self._broken_rules()]
        if broken:
            raise SpecError("; ".join(broken))

    def _broken_rules(self):
        """Every rule that does not hold, as the part at fault and what is asked of it."""
        source, output = self.source, self.output
        choices = {
            "mode": (self.mode, MODES),
            "delete policy": (self.delete_policy, DELETE_POLICIES),
            "output format": (output.format, ("ndjson", "csv")),
        }
        types = {"sql_pull": (*DATABASES, LAKE), "rest_pull": ("http",), "rest_push": ("http",), "file_pull": ("file",)}
        if self.mode in types:
            choices["source type"] = (source.type, types[self.mode])
        if self.mode == "file_pull":
            choices["source format"] = (source.format, ("csv",))
        if not _NAME.fullmatch(self.name):
            yield "name", "takes 1 to 64 of a-z, 0-9 and inner hyphens"
        for part, (value, allowed) in choices.items():
            if value not in allowed:
                yield part, f"is {value!r}, not one of {', '.join(allowed)}"
        needed = {"sql_pull": ("query",), "rest_pull": ("path",), "file_pull": ("path", "glob", "csv")}
        for part in needed.get(self.mode, ()):
            if not getattr(source, part):
                yield f"source {part}", f"is missing for {self.mode}"
        if self.mode != "rest_push" and not self.schedule:
            yield "schedule", "is missing"
        if source.partition_column and (not source.bounds or source.partitions < 1):
            yield "source partition column", "is given without bounds or a number of partitions"
        if output.format == "ndjson" and self.mapping is None:
            yield "mapping", "is missing"
        if output.format == "csv" and (self.mode != "sql_pull" or self.index):
            yield "output format", "csv goes with sql_pull and without an index"


# Fixed names: keys of spec documents and the fields they fill.
_MAPPING_KEYS = {
    "idField": "id_field",
    "titleField": "title_field",
    "contentTemplate": "content_template",
    "uriTemplate": "uri_template",
    "mimeType": "mime_type",
    "aclUsersField": "acl_users_field",
    "aclGroupsField": "acl_groups_field",
    "metadataFields": "metadata_fields",
}
_CSV_KEYS = {
    "documentMode": "document_mode",
    "delimiter": "delimiter",
    "hasHeader": "has_header",
    "encoding": "encoding",
    "normalizeHeaders": "normalize_headers",
    "cleanErrors": "clean_errors",
}
_SOURCE_KEYS = {
    "type": "type",
    "query": "query",
    "watermarkField": "watermark_field",
    "path": "path",
    "glob": "glob",
    "format": "format",
    "paginationNextCursorJsonPath": "next_cursor_path",
    "firstPage": "first_page",
    "partitionColumn": "partition_column",
    "partitions": "partitions",
}


def _pick(raw: dict[str, Any], keys: dict[str, str]) -> dict[str, Any]:
    return {name: raw[key] for key, name in keys.items() if raw.get(key) is not None}


def connector_from(document: dict[str, Any]) -> Connector:
    """A connector out of a parsed spec document (YAML or JSON, camel-case keys)."""
    try:
        spec = document["spec"]
        source = _pick(spec["source"], _SOURCE_KEYS)
        if spec["source"].get("csv") is not None:
            source["csv"] = CsvOptions(**_pick(spec["source"]["csv"], _CSV_KEYS))
        if spec["source"].get("partitionBounds") is not None:
            low, high = spec["source"]["partitionBounds"]
            source["bounds"] = (str(low), str(high))
        mapping = None
        if spec.get("mapping"):
            picked = _pick(spec["mapping"], _MAPPING_KEYS)
            mapping = Mapping(**picked | {"metadata_fields": tuple(picked.get("metadata_fields", ()))})
        out = spec["output"]
        return Connector(
            name=document["metadata"]["name"],
            mode=spec["mode"],
            source=Source(**source),
            output=Output(
                root=out["bucket"],
                prefix=out.get("prefix", ""),
                format=out.get("format", "ndjson"),
                publish_latest_alias=out.get("publishLatestAlias", False),
            ),
            mapping=mapping,
            schedule=spec.get("schedule"),
            delete_policy=(spec.get("reconciliation") or {}).get("deletePolicy", "auto_delete_missing"),
            index=(spec.get("ingestion") or {}).get("enabled", True),
        )
    except (KeyError, TypeError) as error:
        raise SpecError(f"incomplete spec: {error}") from error


def connector_from_text(text: str) -> Connector:
    """``connector_from`` for YAML text (JSON is YAML too)."""
    try:
        import yaml
    except ImportError:
        import json

        return connector_from(json.loads(text))
    return connector_from(yaml.safe_load(text))
