"""Scenario files as a Spark data source: one partition a file, YAML or JSON lines, bad documents as rows.

    spark.dataSource.register(ScenarioFiles)
    spark.read.format("scenarios").option("format", "yaml").load(folder)

A row is a document: path, number (its place in its file, from 0), the scenario's fields, and error.
A document that doesn't parse or has a field of the wrong type is a row with its error and no fields.
A JSON file has a document a line; a broken line costs that line. A YAML file has documents between
``---`` lines, each parsed by itself, so a broken one costs no other."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, Row, StringType, StructType, _parse_datatype_string

FIELDS = "id string, initial_state struct<customer_id:string,authenticated:boolean>, user_goal string, conversation array<struct<user:string>>, expected struct<tools:array<string>,prohibited_tools:array<string>,final_outcome:string,must_not:array<string>>"
SCHEMA = f"path string, number int, {FIELDS}, error string"
FORMATS = {"json": "json", "jsonl": "json", "yaml": "yaml", "yml": "yaml"}


class ScenarioFiles(DataSource):
    """Options: path, a folder or file in any store that pyarrow opens; format, yaml or json, for files whose
    names don't tell."""

    @classmethod
    def name(cls) -> str:
        return "scenarios"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ScenarioReader(schema, self.options["path"], self.options.get("format"))


class ScenarioReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, kind: str | None):
        if kind is not None and kind not in ("yaml", "json"):
            raise ValueError(f"format is yaml or json, not {kind}")
        self.fields = StructType([f for f in schema.fields if f.name not in ("path", "number", "error")])
        self.path, self.kind = path, kind

    def partitions(self) -> list[InputPartition]:
        """The files, by name. Their names are listed here; only tasks open them."""
        from pyarrow import fs

        store, base = opened(self.path)
        if store.get_file_info(base).type == fs.FileType.File:
            return [InputPartition((self.path, self.kind or kind_of(base)))]
        found = [i for i in store.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
        known = [(f"{self.path.rstrip('/')}/{i.path[len(base.rstrip('/')) + 1 :]}", self.kind or kind_of(i.path)) for i in sorted(found, key=lambda i: i.path)]
        return [InputPartition(x) for x in known if x[1]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        path, kind = partition.value
        store, name = opened(path)
        with store.open_input_stream(name) as f:
            text = f.read().decode("utf-8", "replace")
        for number, (document, error) in enumerate(documents(text, kind)):
            if error is None:
                try:
                    yield (path, number, *fitted(document, self.fields, ""), None)
                    continue
                except ValueError as wrong:
                    error = str(wrong)
            yield (path, number, *[None] * len(self.fields), error)


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def kind_of(path: str) -> str | None:
    return FORMATS.get(path.rpartition(".")[2].lower())


def documents(text: str, kind: str) -> Iterator[tuple[object, str | None]]:
    """Each document of a file, or its error. Blank lines and empty documents are none."""
    if kind == "json":
        for line in text.split("\n"):
            if line.strip():
                try:
                    yield json.loads(line), None
                except json.JSONDecodeError as wrong:
                    yield None, f"json: {wrong.msg}"
        return
    import yaml

    parts, own = [], []
    for line in text.split("\n"):
        if line.rstrip() == "---":
            parts.append(own)
            own = []
        else:
            own.append(line)
    for part in [*parts, own]:
        body = "\n".join(part)
        if body.strip():
            try:
                yield yaml.safe_load(body), None
            except yaml.YAMLError as wrong:
                yield None, f"yaml: {getattr(wrong, 'problem', None) or type(wrong).__name__}"


def fitted(value: object, kind: DataType, at: str) -> object:
    """value in the shape of a type: missing fields are null, unknown ones are left out. ValueError names
    the place of a value of another type."""
    if value is None:
        return Row(*[None] * len(kind)) if isinstance(kind, StructType) and not at else None
    if isinstance(kind, StructType):
        if not isinstance(value, dict):
            raise ValueError(f"{at or 'document'}: not a mapping")
        return Row(*[fitted(value.get(f.name), f.dataType, f"{at}.{f.name}".lstrip(".")) for f in kind.fields])
    if isinstance(kind, ArrayType):
        if not isinstance(value, list):
            raise ValueError(f"{at}: not a list")
        return [fitted(x, kind.elementType, f"{at}[{i}]") for i, x in enumerate(value)]
    if isinstance(kind, BooleanType) and not isinstance(value, bool):
        raise ValueError(f"{at}: not true or false")
    if isinstance(kind, StringType):
        if isinstance(value, (dict, list, bool)):
            raise ValueError(f"{at}: not a text")
        return str(value)
    return value


def scenario_schema() -> StructType:
    return _parse_datatype_string(SCHEMA)
