"""The engine's functions under names that SQL can call."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import scanner

REFERENCES = "array<struct<kind: string, prefix: string, num: int, tail: string, text: string, start: int>>"


def register(spark: SparkSession, schemes: tuple[str, ...]) -> list[str]:
    """Register the stateful text functions; returns their names.

    ``references_of(text)`` gives the references outside masks, ``yaml_to_json(text)`` a
    frontmatter as JSON (null where it is none). Both take Arrow batches. What plain
    expressions say (codes, dates, paths) needs no registration.
    """

    @F.arrow_udf(REFERENCES)
    def references_of(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("prefix", pa.string()), ("num", pa.int32()), ("tail", pa.string()), ("text", pa.string()), ("start", pa.int32())]))
        found = [None if t is None else [{"kind": r.kind, "prefix": r.prefix, "num": r.num, "tail": r.tail, "text": r.text, "start": r.start} for r in scanner.references(t, schemes)] for t in texts.to_pylist()]
        return pa.array(found, kind)

    @F.arrow_udf("string")
    def yaml_to_json(texts: pa.Array) -> pa.Array:
        import json

        import yaml

        def one(t: str | None) -> str | None:
            try:
                value = yaml.safe_load(t) if t is not None else None
            except yaml.YAMLError:
                return None
            return json.dumps(value, default=str, ensure_ascii=False, sort_keys=True) if isinstance(value, dict) else None

        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    for name, f in (("references_of", references_of), ("yaml_to_json", yaml_to_json)):
        spark.udf.register(name, f)
    return ["references_of", "yaml_to_json"]
